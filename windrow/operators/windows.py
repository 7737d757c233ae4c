"""Count-based sliding windows as bags of token and critical-pair counts.

Events are numbered, cut into panes of ``gcd(W, S)`` events, counted per pane
and feature, and each pane is then added to the windows that cover it. All of
that runs inside the numbering's own partitions; one shuffle by window merges
the few windows that cross a chunk edge.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.scalars import int_div
from windrow.operators.ordered import CHUNK, ordered_scan
from windrow.schema import EVENT_ORDER
from windrow.vocabulary import UNATTRIBUTED, Vocabulary

# Feature number of a token outside the vocabulary: it fills a slot, counts nothing.
UNKNOWN = -1
# Marks the entries that count techniques rather than tokens.
TECHNIQUE = -2


def window_keys(per_pid: bool, session_key: str | None = "session_id") -> list[str]:
    return ([session_key] if session_key else []) + (["pid"] if per_pid else [])


def number_events(
    events: DataFrame,
    vocab: Vocabulary,
    *,
    keys: list[str],
    order: list[str] = EVENT_ORDER,
    token_col: str = "syscall_name",
    carry: list[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """Slim, numbered events: keys, order, ``token``, ``prev_token``, ``seq``, ``n_total``.

    Tokens are stored as vocabulary indexes (NULL if unknown) before the shuffle.
    ``carry`` names further columns to take along (label, technique, comm, ...).
    """
    cols = list(dict.fromkeys([*keys, *order, *carry]))
    slim = vocab.with_index(events, token_col, "token").select(*cols, "token")
    return ordered_scan(
        slim, keys, order, seq="seq", total="n_total", lags={"prev_token": "token"},
        chunks=chunks, keep_chunk=True,
    )


def live_phase(window: int, stride: int) -> int:
    """First window start of a scorer that fires when ``count % S == 0``."""
    return -window % stride


def _window_range(
    window: int, stride: int, phase: int, fresh: str | None = None, pane: int | None = None
) -> tuple[Column, Column, Column]:
    """Pane of an event and the first and last window holding that pane.

    ``fresh`` names a column with a position; windows that end before it are left out. ``pane`` is a
    divisor of window and stride, their greatest one by default.
    """
    g = pane or gcd(window, stride)
    per_window, per_stride = window // g, stride // g
    pane = int_div(F.col("seq") - phase, g)
    first = F.greatest(F.lit(0).cast("long"), int_div(F.col("pane") - per_window + per_stride, per_stride))
    if fresh:
        least = F.col(fresh) - phase - window + stride
        first = F.greatest(first, F.when(least > 0, int_div(least, stride)).otherwise(0))
    last = F.least(
        int_div(F.col("pane"), per_stride),
        int_div(F.col("n_total") - phase - window, stride),
    )
    return pane, first, last


def _spread(panes: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per (pane row, window holding it)."""
    return (
        panes.withColumns({"_k0": first, "_k1": last})
        .where("_k0 <= _k1")
        .withColumn("window_id", F.explode(F.sequence("_k0", "_k1")))
        .drop("_k0", "_k1")
    )


def shared_pane(shapes: list[tuple[int, int]]) -> int:
    """The largest pane of which every (window, stride) is a multiple."""
    return gcd(*[n for shape in shapes for n in shape])


def pane_counts(
    numbered: DataFrame, vocab: Vocabulary, pane: int, *, keys: list[str], ngram: int = 1, phase: int = 0,
    time_col: str = "timestamp_ns", techniques: bool = False, fresh: str | None = None, least: int = 0,
) -> DataFrame:
    """Features counted per pane of ``pane`` events, from which windows of any multiple are added up.

    One row per pane and feature (``UNKNOWN`` and ``TECHNIQUE`` are features here); ``edge`` marks pairs
    whose left token lies in the pane before. Groups of under ``least`` events are left out.
    """
    ends = ["n_total", fresh] if fresh else ["n_total"]
    attack = (F.col("label") == 1).cast("long") if "label" in numbered.columns else F.lit(0).cast("long")
    none, no, zero = F.lit(None).cast("string"), F.lit(False), F.lit(0).cast("long")

    def entry(feature, edge=no, attack=zero, technique=none):
        return F.struct(
            feature.alias("feature"), edge.alias("edge"), attack.alias("attack"), technique.alias("technique")
        )

    entries = [entry(F.coalesce(F.col("token"), F.lit(UNKNOWN)), attack=attack)]
    if ngram >= 2:
        feature = vocab.pair_feature(F.col("prev_token"), F.col("token"))
        # A pair belongs to its right token; at a pane's start it reaches back over the edge.
        edge = F.col("seq") - phase == F.col("pane") * pane
        entries.append(F.when(feature.isNotNull(), entry(feature, edge=edge)))
    if techniques:
        named = _named_technique()
        entries.append(F.when(named.isNotNull(), entry(F.lit(TECHNIQUE), technique=named)))

    what = ["feature", "technique"] if techniques else ["feature"]
    return (
        numbered.where(F.col("seq") >= phase)
        .where(F.col("n_total") >= phase + least)
        .withColumn("pane", int_div(F.col("seq") - phase, pane))
        .select(*keys, CHUNK, "pane", *ends, "seq", F.col(time_col).alias("ts"), F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(*keys, CHUNK, "pane", *ends, "e.edge", *[f"e.{c}" for c in what])
        .agg(
            F.count(F.lit(1)).alias("cnt"), F.sum("e.attack").alias("attack"), F.max("ts").alias("ts"),
            *([F.min("seq").alias("seq")] if techniques else []),
        )
    )


def windows_of_panes(
    panes: DataFrame, pane: int, *, keys: list[str], window: int, stride: int, min_attack: int = 1, min_attack_frac: float = 0.0,
    phase: int = 0, fresh: str | None = None,
) -> DataFrame:
    """Windows (see ``bag_windows``) added up from the panes of ``pane_counts``."""
    if window % pane or stride % pane:
        raise ValueError(f"panes of {pane} events do not make up windows of {window} at a stride of {stride}")
    techniques = "technique" in panes.columns
    what = ["feature", "technique"] if techniques else ["feature"]
    merged = [
        F.sum("cnt").alias("cnt"), F.sum("attack").alias("attack"), F.max("ts").alias("ts"),
        *([F.min("seq").alias("seq")] if techniques else []),
    ]
    _, first, last = _window_range(window, stride, phase, fresh, pane)
    # A pair whose left token lies before the window's first pane is outside it.
    inside = ~(F.col("edge") & (F.col("pane") == F.col("window_id") * (stride // pane)))
    partial = _spread(panes, first, last).where(inside).groupBy(*keys, CHUNK, "window_id", *what).agg(*merged)
    rank = F.when(F.col("feature") == TECHNIQUE, F.struct(F.col("cnt"), -F.col("seq"))) if techniques else None
    best = [F.coalesce(F.max_by("technique", rank), F.lit(UNATTRIBUTED)).alias("technique")] if techniques else []
    return (
        partial.repartition(*keys, "window_id")
        .groupBy(*keys, "window_id", *what)
        .agg(*merged)
        .groupBy(*keys, "window_id")
        .agg(
            F.sum("attack").alias("attack_events"),
            F.max("ts").alias("close_ts"),
            F.map_from_entries(
                F.collect_list(F.when(F.col("feature") >= 0, F.struct("feature", "cnt")))
            ).alias("bag"),
            *best,
        )
        .select(
            *keys,
            "window_id",
            (F.col("window_id") * stride + phase).alias("start_seq"),
            (F.col("window_id") * stride + phase + window - 1).alias("end_seq"),
            "close_ts",
            "attack_events",
            window_label(F.col("attack_events"), window, min_attack, min_attack_frac).alias("label"),
            "bag",
            *(["technique"] if techniques else []),
        )
    )


def bag_windows(
    numbered: DataFrame,
    vocab: Vocabulary,
    *,
    keys: list[str],
    window: int = 20,
    stride: int = 10,
    ngram: int = 1,
    min_attack: int = 1,
    min_attack_frac: float = 0.0,
    phase: int = 0,
    time_col: str = "timestamp_ns",
    techniques: bool = False,
    fresh: str | None = None,
) -> DataFrame:
    """One row per complete window.

    Columns: keys, ``window_id``, ``start_seq``, ``end_seq``, ``close_ts``,
    ``attack_events``, ``label`` and ``bag``, a map of feature number -> count
    that leaves zeros out (it is empty for a window of unknown tokens).
    Groups shorter than ``window`` and trailing events give no window. A window
    is attack when its attack events reach both ``min_attack`` and
    ``min_attack_frac * window``. ``techniques`` adds the dominant ``technique``
    (see ``dominant_technique``) from the same pass. ``fresh`` names a column: only
    windows that end at or after its position are built.
    """
    pane = gcd(window, stride)
    panes = pane_counts(
        numbered, vocab, pane, keys=keys, ngram=ngram, phase=phase, time_col=time_col, techniques=techniques, fresh=fresh, least=window)
    return windows_of_panes(
        panes, pane, keys=keys, window=window, stride=stride, min_attack=min_attack, min_attack_frac=min_attack_frac, phase=phase,
        fresh=fresh)


def _named_technique() -> Column:
    """The technique of an attack event that has one."""
    return F.when((F.col("label") == 1) & (F.coalesce("technique", F.lit("")) != ""), F.col("technique"))


def window_label(attack_events: Column, window: int, min_attack: int = 1, min_attack_frac: float = 0.0) -> Column:
    """1 when both bounds are reached (inclusive), else 0."""
    hit = (attack_events >= min_attack) & (attack_events >= F.lit(min_attack_frac * window))
    return F.when(hit, 1).otherwise(0)


def long_features(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window_id, feature_idx, cnt) rows of the non-zero counts."""
    return windows.select(*keys, "window_id", F.explode("bag").alias("feature_idx", "cnt"))


def close_times(
    numbered: DataFrame, *, keys: list[str], window: int, stride: int, phase: int = 0, carry: list[str] = ()
) -> DataFrame:
    """The event that completes each window; needs no aggregate and no shuffle."""
    at = F.col("seq") - phase - (window - 1)
    return numbered.where((at >= 0) & (F.pmod(at, F.lit(stride)) == 0)).select(
        *keys, int_div(at, stride).alias("window_id"), F.col("timestamp_ns").alias("close_ts"), *carry
    )


def window_members(numbered: DataFrame, *, keys: list[str], window: int, stride: int, phase: int = 0) -> DataFrame:
    """(event, window) pairs: event ``seq`` lies in every window covering it."""
    pane, first, last = _window_range(window, stride, phase)
    return _spread(numbered.where(F.col("seq") >= phase).withColumn("pane", pane), first, last).drop("pane")


def dominant_technique(
    numbered: DataFrame, *, keys: list[str], window: int, stride: int, phase: int = 0
) -> DataFrame:
    """The most common technique among a window's attack events.

    Ties go to the technique seen first in the window; a window without a named
    technique gives ``unattributed``.
    """
    pane, first, last = _window_range(window, stride, phase)
    counts = [F.sum("cnt").alias("cnt"), F.min("first_seq").alias("first_seq")]
    panes = (
        numbered.where(F.col("seq") >= phase)
        .where(F.col("n_total") >= phase + window)
        .withColumns({"pane": pane, "technique": _named_technique()})
        .groupBy(*keys, CHUNK, "pane", "n_total", "technique")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("seq").alias("first_seq"))
    )
    rank = F.when(F.col("technique").isNotNull(), F.struct(F.col("cnt"), -F.col("first_seq")))
    return (
        _spread(panes, first, last)
        .groupBy(*keys, CHUNK, "window_id", "technique")
        .agg(*counts)
        .repartition(*keys, "window_id")
        .groupBy(*keys, "window_id", "technique")
        .agg(*counts)
        .groupBy(*keys, "window_id")
        .agg(F.coalesce(F.max_by("technique", rank), F.lit(UNATTRIBUTED)).alias("technique"))
    )


def early_windows(numbered: DataFrame, *, keys: list[str], window: int, risky: list[int], least: int = 3) -> DataFrame:
    """Windows scored before the buffer is full: one per risky token in a key's head.

    The head is the first ``window - 1`` events of a key, so a group collected
    here never exceeds that. Gives ``end_seq`` and the buffer's token indexes.
    """
    head = (
        numbered.where(F.col("seq") < window - 1)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("seq", "token"))).alias("head"))
    )
    tokens = F.transform("head", lambda h: h["token"])
    ends = F.filter("head", lambda h: (h["seq"] >= least - 1) & h["token"].isin(risky))
    return (
        head.select(*keys, tokens.alias("tokens"), F.explode(F.transform(ends, lambda h: h["seq"])).alias("end_seq"))
        .select(*keys, "end_seq", F.slice("tokens", F.lit(1), (F.col("end_seq") + 1).cast("int")).alias("tokens"))
    )


def bag_of(tokens: Column, vocab: Vocabulary, ngram: int) -> Column:
    """Map of feature -> count for one array of token indexes."""
    found = tokens
    if ngram >= 2:
        pairs = F.transform(
            F.arrays_zip(tokens.alias("l"), F.slice(tokens, F.lit(2), F.size(tokens)).alias("r")),
            lambda z: vocab.pair_feature(z["l"], z["r"]),
        )
        found = F.concat(tokens, pairs)
    found = F.array_compact(found)
    return F.map_from_entries(
        F.transform(
            F.array_distinct(found),
            lambda f: F.struct(f, F.size(F.filter(found, lambda x: x == f)).cast("long")),
        )
    )


def top_features(windows: DataFrame, keys: list[str], weights: str, n: int = 5) -> DataFrame:
    """The ``n`` heaviest features of each window, positive weights only.

    A window holds at most as many entries as the vocabulary has features, so
    sorting its own array is enough; ties go to the lower feature number.
    """
    entries = F.filter(F.map_entries(weights), lambda e: e["value"] > 0)
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("f"))))
    return windows.select(
        *keys, "window_id", F.posexplode(F.slice(ranked, 1, n)).alias("pos", "e")
    ).select(*keys, "window_id", (F.col("pos") + 1).alias("rank"), F.col("e.f").alias("feature_idx"), (-F.col("e.w")).alias("weight"))
