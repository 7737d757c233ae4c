"""The ordered and joined queries again, by the plans meant for large inputs.

Small tables would go through one chunk and a broadcast; here orders are cut into eight chunks, and
no timeline may be broadcast, so the comparison with SQL covers these plans too.
"""

from __future__ import annotations

from checks import evaluation, relational, sequences
from windrow.storage import BROADCAST_SETTING, CHUNKS_SETTING

CHUNKS = 8
IN_CHUNKS = [
    "count_windows", "process_windows", "bigram_counts", "dominant_technique", "attack_bursts", "asof_forward", "latency_stats",
    "roc_points", "alert_cooldown", "process_cooldown", "stratified_folds",
]
UNBROADCAST = ["technique_interval_join", "alert_first_match"]

QUERIES, ORACLE = {}, {}


def _with_setting(fn, name, value):
    def run(spark, sf):
        spark.conf.set(name, value)
        try:
            return fn(spark, sf)
        finally:
            spark.conf.unset(name)

    return run


for _names, _setting, _value, _suffix in (
    (IN_CHUNKS, CHUNKS_SETTING, str(CHUNKS), "chunked"), (UNBROADCAST, BROADCAST_SETTING, "0", "shuffled"),
):
    for _name in _names:
        _home = next(m for m in (relational, sequences, evaluation) if _name in m.QUERIES)
        QUERIES[f"{_name}_{_suffix}"] = _with_setting(_home.QUERIES[_name], _setting, _value)
        ORACLE[f"{_name}_{_suffix}"] = _home.ORACLE[_name]
