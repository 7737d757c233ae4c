"""Near-duplicate texts by ProbMinHash signatures, banding, exact verification and components.

A text is its set of five-word shingles, weighted by 1 or by their number. Every shingle is a
Poisson process whose arrivals fall into the registers of the signature; a register keeps the
shingle that came first, and a shingle's process ends once its next arrival is later than the last
register's. Two texts agree in a register with the probability Jaccard similarity of their weights,
which for weights of 1 is the Jaccard similarity of the sets. Bands of registers give buckets.

Verification is exact, on the shingle sets. First each bucket's members are compared with one
leader. Then buckets that still hold texts of different components are compared in full, in blocks
of bounded size; no pairs are listed, a block gives at most one link per member. Only texts that
share a bucket are ever read a second time.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import discard, key_columns, ship, written
from windrow.llm.components import connected_components
from windrow.llm.groups import runs_of, single_column
from windrow.llm.tokens import GOLDEN, draw_key, release_encoders, scramble, slices, text_column, word_hashes

SHINGLE = 5
BANDS, ROWS = 25, 5
REGISTERS = 128
# Registers that agree are binomial: at 0.8, five deviations of 128 registers are 0.18.
SLACK = 0.18
CELL = 512
GROUPS = 1 << 20
MULTIPLIERS = scramble(np.arange(101, 101 + SHINGLE, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every five-word shingle in order, and n+1 offsets; fewer words are one shingle."""
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    ends = np.repeat(offsets[1:], counts)
    place = np.arange(len(words))
    start = (place + SHINGLE <= ends) | (place == np.repeat(offsets[:-1], counts))
    first, end = place[start], ends[start]
    total = np.zeros(len(first), np.uint64)
    for i in range(SHINGLE):
        at = first + i
        total += np.where(at < end, words[np.minimum(at, len(words) - 1)] * MULTIPLIERS[i], np.uint64(i)) if len(words) else 0
    per_text = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    return scramble(total), np.concatenate([[0], np.cumsum(per_text)])


def signatures(hashes: np.ndarray, offsets: np.ndarray, weighted: bool) -> np.ndarray:
    """Texts x registers: the hash of the shingle that arrived first; 0 for texts without shingles."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    weight = None
    if weighted and len(hashes):
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])])
        at = np.flatnonzero(new)
        weight = np.diff(np.append(at, len(hashes))).astype(float)
        hashes, of = hashes[at], of[at]
    first = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    time = np.zeros(len(hashes))
    arrival = 0
    while len(hashes):
        arrival += 1
        draw = scramble(hashes + draw_key(arrival))
        step = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53)
        time = time + (step if weight is None else step / weight)
        register = of * REGISTERS + (draw & np.uint64(REGISTERS - 1)).astype(np.int64)
        early = np.flatnonzero(time < first[register])
        np.minimum.at(first, register[early], time[early])
        won = early[time[early] == first[register[early]]]
        winner[register[won]] = hashes[won]
        last = first.reshape(n, REGISTERS).max(axis=1)
        live = np.flatnonzero(time < last[of])
        hashes, of, time = hashes[live], of[live], time[live]
        weight = None if weight is None else weight[live]
    return winner.reshape(n, REGISTERS)


def sign(docs: DataFrame, weighted: bool) -> DataFrame:
    """doc_id, k1, k2, rid, bands and sig (a byte per register) of every row with a text."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")

    def run(batches: Iterable[pa.RecordBatch]):
        release_encoders()
        part, seen = TaskContext.get().partitionId(), 0
        factors = scramble(np.arange(1, ROWS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
        for batch in batches:
            bands, sigs = [], []
            for piece in slices(text_column(batch.column(1)), 1_000_000):
                hashes, offsets = shingles(piece)
                winner = signatures(hashes, offsets, weighted)
                mixed = scramble(winner)
                band = (mixed[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS) * factors).sum(axis=2, dtype=np.uint64)
                band = scramble(band + np.arange(BANDS, dtype=np.uint64) * GOLDEN).view(np.int64)
                some = np.diff(offsets) > 0
                bands += [b if ok else b[:0] for b, ok in zip(band, some)]
                sigs += [s.tobytes() for s in (mixed >> np.uint64(56)).astype(np.uint8)]
            rid = (np.int64(part) << np.int64(33)) + np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), batch.column(3), pa.array(rid), pa.array(bands, pa.list_(pa.int64())),
                pa.array(sigs, pa.binary())], names=["doc_id", "k1", "k2", "rid", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *key_columns(text))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, rid long, bands array<long>, sig binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """v and its sorted shingle hashes, for the texts of ``nodes`` (k1, k2, v)."""
    text = F.col("text").cast("string")
    group = F.pmod("k1", F.lit(GROUPS))
    # At most GROUPS rows.
    groups = F.broadcast(nodes.select(group.alias("g")).distinct())
    rows = docs.select(text.alias("text"), *key_columns(text)).where("k1 IS NOT NULL").withColumn("g", group)
    rows = rows.join(groups, "g", "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            sets = []
            for piece in slices(text_column(batch.column(1)), 1_000_000):
                hashes, offsets = shingles(piece)
                sets += [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["v", "shingles"])

    return rows.join(nodes, ["k1", "k2"]).select("v", "text").mapInArrow(run, "v long, shingles binary")


def _likely(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether agreeing register bytes allow the similarity; a byte agrees by chance once in 256."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256) >= similarity - SLACK


def leader_links(members: DataFrame, leaders: DataFrame, sigs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: members whose similarity with their bucket's leader is high enough."""
    pairs = members.join(leaders, "bucket").where("v <> leader").select("v", "leader").distinct()
    both = pairs.join(sigs, "v").join(sigs.select(F.col("v").alias("leader"), F.col("sig").alias("leader_sig")), "leader")

    def likely(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
            yield batch.select(["leader", "v"]).filter(pa.array(_likely(a, b, similarity)))

    pairs = written(both.select("leader", "v", "sig", "leader_sig").mapInArrow(likely, "leader long, v long"), "pairs")
    # A leader with many members is compared cell by cell; its own set goes to each cell.
    cells = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    placed = pairs.join(cells, "leader").select("leader", F.pmod(F.xxhash64("v"), F.col("cells")).cast("int").alias("cell"), "v")
    placed = placed.union(cells.select("leader", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("leader").alias("v")))
    rows = placed.join(sets, "v").select("leader", "cell", "v", "shingles").repartition("leader", "cell").sortWithinPartitions("leader", "cell")

    def verify(batches: Iterable[pa.RecordBatch]):
        for table in runs_of(batches, 2):
            leader = table.column("leader")[0].as_py()
            v = np.asarray(single_column(table, "v"))
            sets_ = [np.frombuffer(x, np.uint64) for x in single_column(table, "shingles").to_pylist()]
            own = [s for s, x in zip(sets_, v.tolist()) if x == leader]
            if not own:
                continue
            found = []
            for x, s in zip(v.tolist(), sets_):
                if x != leader:
                    at = np.minimum(np.searchsorted(own[0], s), len(own[0]) - 1)
                    shared = int((own[0][at] == s).sum())
                    if shared >= similarity * (len(s) + len(own[0]) - shared):
                        found.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([leader] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(verify, "a long, b long")


def _cut(rows: DataFrame, similarity: float, carry: list[str]) -> DataFrame:
    """Buckets' rows by pairs of cells of about CELL members, sorted by block."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    cut = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("v"), F.col("cells")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cut = cut.select("bucket", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "v", "label", *carry)
    return cut.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def _open_pairs(table: pa.Table) -> np.ndarray:
    """Pairs of rows of a block with different labels, of different cells if it has two."""
    label, own = (np.asarray(single_column(table, c)) for c in ("label", "own"))
    apart = label[:, None] != label[None, :]
    if table.column("low")[0].as_py() != table.column("high")[0].as_py():
        apart &= own[:, None] != own[None, :]
    return apart


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of every two sets, exactly, by products of incidence columns."""
    m = len(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    values, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = counts[code] > 1
    of, code = of[use], np.cumsum(counts > 1)[code[use]] - 1
    total, width = np.zeros((m, m)), int((counts > 1).sum())
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    for at in range(0, width, 4096):
        a, b = np.searchsorted(code, [at, at + 4096])
        part = np.zeros((m, min(4096, width - at)), np.float32)
        part[of[a:b], code[a:b] - at] = 1
        total += part @ part.T
    return total


def _joining(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Of links between whole numbers those that join two parts not joined before: fewer than there are numbers."""
    parent, used = {}, []

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            used.append(i)
    return used


def bucket_links(members: DataFrame, labels: DataFrame, sigs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between texts of different labels in the same bucket, enough to join all such."""
    labelled = members.join(labels, "v", "left").withColumn("label", F.coalesce("root", "v")).drop("root")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    open_rows = written(labelled.join(mixed, "bucket"), "open")

    def likely(batches: Iterable[pa.RecordBatch]):
        for table in runs_of(batches, 3):
            sig = np.frombuffer(b"".join(single_column(table, "sig").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            apart = _open_pairs(table)
            keep = np.zeros(len(sig), bool)
            for i in np.flatnonzero(apart.any(axis=1)).tolist():
                keep[i] = (_likely(sig[i], sig, similarity) & apart[i]).any()
            yield from table.select(["bucket", "v", "label"]).filter(pa.array(keep)).to_batches()

    near = _cut(open_rows.join(sigs, "v"), similarity, ["sig"]).mapInArrow(likely, "bucket long, v long, label long")
    near = written(near.distinct(), "near")

    def verify(batches: Iterable[pa.RecordBatch]):
        for table in runs_of(batches, 3):
            v = np.asarray(single_column(table, "v"))
            apart = _open_pairs(table)
            if not apart.any():
                continue
            sets_ = [np.frombuffer(x, np.uint64) for x in single_column(table, "shingles").to_pylist()]
            shared = _shared(sets_)
            size = np.array([len(s) for s in sets_], float)
            linked = apart & (shared >= similarity * (size[:, None] + size[None, :] - shared))
            # Rows of one label are joined already: fewer links than the block has labels do.
            a, b = np.nonzero(np.triu(linked))
            label = np.asarray(single_column(table, "label"))
            at = _joining(label[a], label[b])
            yield pa.RecordBatch.from_arrays([pa.array(v[a[at]]), pa.array(v[b[at]])], names=["a", "b"])

    return _cut(near.join(sets, "v"), similarity, ["shingles"]).mapInArrow(verify, "a long, b long")


def classes(docs: DataFrame, similarity: float = 0.8, weighted: bool = False) -> DataFrame:
    """doc_id, k1, k2, class_root of every row: rows of one class are equal or linked texts.

    Texts link at a Jaccard similarity of ``similarity`` or more of their five-word shingle sets
    (A-Z lower-cased; a text of one to four words is one shingle); classes are the components.
    Equal texts are one class whatever they hold. A text without words links with no other text. A
    NULL text is a class of its own row, with NULL keys and class_root. Doc ids may be NULL or
    repeat. Only doc_id and text are read. An empty table gives no rows. ``weighted`` counts
    repeated shingles in the signatures; verification stays with the sets.
    """
    signed = written(sign(docs, weighted), "signed")
    nodes = written(signed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("rid").alias("v"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    placed = nodes.select("v", F.explode("bands").alias("bucket"))
    order = F.struct(F.xxhash64("v").alias("h"), "v")
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    members = written(placed.join(shared.select("bucket", F.col("first.v").alias("leader")), "bucket"), "members")
    candidates = members.select("v").distinct()
    sigs = written(nodes.join(candidates, "v", "left_semi").select("v", "sig", "k1", "k2"), "candidates")
    sets = written(shingle_sets(docs, sigs.select("k1", "k2", "v")), "sets")
    sigs = sigs.select("v", "sig")
    rows = members.select("bucket", "v")
    leaders = members.where("v = leader").select("bucket", "leader")
    first = written(leader_links(rows, leaders, sigs, sets, similarity), "links")
    labels = written(connected_components(first), "labels")
    # Leaders have met all of their bucket already.
    rest = members.where("v <> leader").select("bucket", "v")
    second = written(bucket_links(rest, labels, sigs, sets, similarity), "links")
    roots = connected_components(first.union(second)).withColumnRenamed("v", "node")
    known = nodes.join(roots, nodes["v"] == roots["node"], "left").select(
        "k1", "k2", F.coalesce("root", "v").alias("class_root"))
    known = written(known, "classes")
    keyed = signed.select("doc_id", F.coalesce("k1", "rid").alias("k1"), "k2", "rid")
    out = keyed.join(known, ["k1", "k2"], "left").select("doc_id", F.when(F.col("k2").isNotNull(), F.col("k1")).alias("k1"), "k2", "rid", "class_root")
    out = written(out, "classed")
    discard(sets, sigs, first, second, signed)
    return out


def keep_one(docs: DataFrame, similarity: float = 0.8, weighted: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``deduplicate`` keeps, one of each class, with all their columns.

    Of rows equal in doc_id and text one stays; rows with NULL text all stay.
    """
    text = F.col("row.text").cast("string")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    k1, k2 = key_columns(text)
    # The doc id is part of the key, so that copies of one text are spread.
    doc = F.struct(F.col("row.doc_id").cast("long").alias("id"))
    rows = packed.where(F.col("row.text").isNotNull()).select("row", k1, k2, doc.alias("doc"))
    best = deduplicate(docs, similarity, weighted).where("kept AND k2 IS NOT NULL").select(
        "k1", "k2", F.struct(F.col("doc_id").alias("id")).alias("doc"))
    chosen = rows.join(best, ["k1", "k2", "doc"], "left_semi").dropDuplicates(["k1", "k2", "doc"])
    return chosen.select("row.*").union(packed.where(F.col("row.text").isNull()).select("row.*"))


def deduplicate(docs: DataFrame, similarity: float = 0.8, weighted: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    class_id is the smallest doc_id of the class (NULL if all are); kept marks one row of each
    class, that of the smallest doc_id (a row with an id before one without). NULL texts are
    classes of one row.
    """
    found = classes(docs, similarity, weighted)
    own = F.struct(F.coalesce(F.col("class_root"), F.col("rid")).alias("r"), F.col("class_root").isNull().alias("single"))
    found = found.withColumn("class", own)
    per = found.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "rid"))["rid"].alias("best"))
    # A table of its own, so that the join is free to split a class with very many rows.
    per = written(per, "classes")
    return found.join(per, "class").select(
        "doc_id", "class_id", "class_size", (F.col("rid") == F.col("best")).alias("kept"), "k1", "k2")
