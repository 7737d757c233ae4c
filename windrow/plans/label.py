"""Labelling a raw capture by attack scope and technique timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.scalars import parse_human_time
from windrow.operators import intervals as iv
from windrow.operators import reports as rp
from windrow.sources.events import write_labeled
from windrow.vocabulary import KNOWN_ATTACK_COMMS


def label_capture(raw: DataFrame, attack_cgroup: int, timeline: DataFrame | None, out_path: str | None = None):
    """Labelled events and the cross-check of the scope against known attack programs.

    Fails when no event lies in the attack scope: the id is then wrong.
    """
    parsed = raw.withColumn("_wall", parse_human_time(F.col("timestamp_human")))
    labeled = iv.label_events(parsed, attack_cgroup, timeline, human_time="_wall").drop("_wall")
    if labeled.where("label = 1").isEmpty():
        raise ValueError("no event matches the attack scope; check the marker")
    check = rp.label_crosscheck(labeled, KNOWN_ATTACK_COMMS)
    if out_path:
        write_labeled(labeled, out_path)
        labeled = raw.sparkSession.read.parquet(out_path)
    return labeled, check
