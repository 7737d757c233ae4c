"""Token ids on disk: frequency ranks in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus, most frequent first, so that common ones need one byte.
Four values share a control byte of four 2-bit lengths; control bytes and data bytes are kept
apart, and a 256-row table of lengths and offsets decodes them in whole arrays.

A written set is a folder in any store that Spark writes to:

* ``blocks``: rows (range, block, inside, docs, tokens, doc_ids, count_control, count_data, control,
  data); documents ascend by doc_id within a block, blocks by (range, block). ``inside`` is the number
  of ids before the block in its range, ``count_*`` code the number of ids of each document,
  ``control`` and ``data`` the ranks of all its ids.
* ``ranks``: (rank, id).
* ``index``: (range, start), ids in all ranges before.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import discard, partition_offsets, ship, written
from windrow.llm.tokens import binary_rows, draw_key, encoded_slices, encoder, give_back, release_encoders, scramble
from windrow.storage import broadcast_rows

BLOCK_TOKENS = 500_000
# Ranges of doc ids by the quantiles of all ids; a partition of the shuffle holds a few whole ranges.
RANGES_PER_PARTITION = 4
PARTITION_BYTES = 64_000_000
SORTED = "range int, block int, inside long, docs int, tokens long, doc_ids array<long>, counts binary, width int, ids binary"
BLOCK = (
    "range int, block int, inside long, docs int, tokens long, doc_ids array<long>, count_control binary, count_data binary, "
    "control binary, data binary"
)
# By control byte: the four lengths, where each value starts within its group, and the group's bytes.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
OFFSETS = (np.cumsum(LENGTHS, axis=1) - LENGTHS).astype(np.uint8)
GROUP = LENGTHS.sum(axis=1).astype(np.int64)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of whole numbers below 2**32."""
    values = np.ascontiguousarray(values, "<u4")
    n = len(values)
    length = np.ones(-(-n // 4) * 4, np.uint8)
    for top in (0xFF, 0xFFFF, 0xFFFFFF):
        length[:n] += values > top
    four = (length - 1).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    length = length[:n]
    ends = np.cumsum(length, dtype=np.int64)
    at, total = ends - length, int(ends[-1]) if n else 0
    data = np.zeros(total + 4, np.uint8)
    # High bytes first: where a value is shorter, the next value's own bytes follow and replace them.
    for byte in range(int(length.max(initial=1)) - 1, -1, -1):
        data[at + byte if byte else at] = (values >> np.uint32(8 * byte)).astype(np.uint8)
    return control.tobytes(), data[:total].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    codes = np.frombuffer(control, np.uint8)
    group = GROUP[codes]
    at = ((np.cumsum(group) - group)[:, None] + OFFSETS[codes]).ravel()[:n]
    length = LENGTHS[codes].ravel()[:n]
    # The padding of the last group reads behind the data.
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(16, np.uint8)])
    out = raw.take(at).astype(np.uint32)
    for byte in range(1, int(length.max(initial=1))):
        out |= (raw.take(at + byte) * (length > byte)).astype(np.uint32) << np.uint32(8 * byte)
    return out


def _ranges(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Partitions of the sort, leading ranges of NULL ids, and quantiles of the others, which steer balance only.

    Partitions follow from the bytes of text; ranges of NULL ids from their share of the rows.
    """
    size = rows.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size[0] // PARTITION_BYTES))
    count = partitions * RANGES_PER_PARTITION
    nameless = round(count * size[2] / max(size[1], 1))
    if count - nameless < 2:
        return partitions, nameless, np.zeros(0, np.int64)
    shares = F.array(*[F.lit(i / (count - nameless)) for i in range(1, count - nameless)])
    found = rows.agg(F.percentile_approx("doc_id", shares, 50_000)).first()[0]
    return partitions, nameless, np.array(found or [], np.int64)


def sorted_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Blocks of documents with their ids, in ascending order of doc_id over (range, block).

    Rows with one doc id are in an order drawn from where they were read; when an id fills several
    quantiles its rows are dealt over those ranges by that draw, and so are rows without an id over
    the first ranges.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partitions, nameless, bounds = _ranges(rows)

    def run(batches: Iterable[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer)
        for batch, flat, offsets in (x for b in batches for x in encoded_slices(coder, b, 1)):
            n = batch.num_rows
            width = 2 if max(end_id, int(flat.max(initial=0))) < 1 << 16 else 4
            ends = offsets + np.arange(n + 1)
            ids = np.empty(int(ends[-1]), f"<u{width}")
            last = ends[1:] - 1
            inner = np.ones(len(ids), bool)
            inner[last] = False
            ids[inner] = flat
            ids[last] = end_id
            known = np.asarray(batch.column(0).is_valid())
            doc_id = np.asarray(batch.column(0).fill_null(0), np.int64)
            draw = (scramble(np.arange(seen, seen + n, dtype=np.uint64) + draw_key(part)) >> np.uint64(33)).astype(np.int64)
            low = np.where(known, nameless + np.searchsorted(bounds, doc_id, side="left"), 0)
            high = np.where(known, nameless + np.searchsorted(bounds, doc_id, side="right"), max(nameless - 1, 0))
            at = low + (draw * (high - low + 1) >> 31)
            yield pa.RecordBatch.from_arrays([
                pa.array(at.astype(np.int32)), batch.column(0), pa.array(draw), pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(seen, seen + n)), pa.array(np.full(n, width, np.int32)), binary_rows(ids, ends[1:]),
            ], names=["range", "doc_id", "draw", "read_part", "read_row", "width", "ids"])
            seen += n

    def gather(batches: Iterable[pa.RecordBatch]):
        release_encoders()
        now, block, inside, doc_ids, ids, size = None, 0, 0, [], [], 0

        def close():
            wide = max(w for w, _ in ids)
            parts = [x if w == wide else np.frombuffer(x, f"<u{w}").astype(f"<u{wide}").tobytes() for w, x in ids]
            counts = np.array([len(x) // wide for x in parts], "<u8")
            return pa.RecordBatch.from_arrays([
                pa.array([now], pa.int32()), pa.array([block], pa.int32()), pa.array([inside], pa.int64()),
                pa.array([len(parts)], pa.int32()), pa.array([size], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([counts.tobytes()], pa.binary()), pa.array([wide], pa.int32()), pa.array([b"".join(parts)], pa.binary()),
            ], names=[c.split()[0] for c in SORTED.split(", ")])

        for batch in batches:
            for at, doc_id, width, row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if ids and (at != now or size >= BLOCK_TOKENS):
                    yield close()
                    block, inside = (block + 1, inside + size) if at == now else (0, 0)
                    doc_ids, ids, size = [], [], 0
                now = at
                doc_ids.append(doc_id)
                ids.append((width, row))
                size += len(row) // width
        if ids:
            yield close()
        give_back()

    order = ["range", "doc_id", "draw", "read_part", "read_row"]
    coded = rows.mapInArrow(
        run, "range int, doc_id long, draw long, read_part int, read_row long, width int, ids binary")
    ordered = coded.repartition(partitions, "range").sortWithinPartitions(*order)
    return ordered.select("range", "doc_id", "width", "ids").mapInArrow(gather, SORTED)


def id_counts(blocks: DataFrame) -> DataFrame:
    """How often each id occurs in the whole corpus; tasks count before anything is shuffled."""

    def count(batches: Iterable[pa.RecordBatch]):
        release_encoders()
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for width, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.bincount(np.frombuffer(raw.as_buffer(), f"<u{width}"), minlength=len(total))
                found[:len(total)] += total
                total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return blocks.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text and write the set described above to ``path``.

    NULL and empty texts are the end id alone. Documents ascend by doc_id, NULL ids first; rows
    with one id follow a draw from where they were read. Other columns are not read. An empty
    table gives an empty set. Texts are encoded and shuffled once; the sorted ids are a table of
    their own until they are counted and coded, and its shuffle files go when it is written.
    """
    spark = docs.sparkSession
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        blocks = written(sorted_ids(docs, tokenizer, end_id), "ids", compression="zstd")
    finally:
        spark.conf.set(cleanup, before)
    # One row per id of the tokenizer's vocabulary.
    counted = id_counts(blocks).collect()
    ranked = sorted(counted, key=lambda r: (-r["n"], r["id"]))
    id_of = np.array([r["id"] for r in ranked], np.int64)
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(id_of)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")

    def code(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            counts = [encode_values(np.frombuffer(x, "<u8")) for x in batch.column(6).to_pylist()]
            ids = [
                encode_values(rank_of[np.frombuffer(raw.as_buffer(), f"<u{width}")])
                for width, raw in zip(batch.column(7).to_pylist(), batch.column(8))
            ]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i in range(6)], *[pa.array([x[k] for x in pair], pa.binary()) for pair in (counts, ids) for k in (0, 1)],
            ], names=[c.split()[0] for c in BLOCK.split(", ")])
            give_back()

    blocks.mapInArrow(code, BLOCK).write.parquet(f"{path}/blocks", compression="zstd")
    discard(blocks)
    made = spark.read.parquet(f"{path}/blocks").groupBy("range").agg(F.sum("tokens").alias("n"))
    partition_offsets(made, "range", "n").select("range", F.col("before").alias("start")).write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of every document of a written set."""
    ship(spark)
    # One row per id of the vocabulary.
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranks], "<u4")
    # One row a range; beyond the bound for broadcasts Spark chooses the join.
    index = spark.read.parquet(f"{path}/index")
    index = F.broadcast(index) if index.count() <= broadcast_rows(spark) else index
    blocks = spark.read.parquet(f"{path}/blocks").join(index, "range").withColumn("start", F.col("start") + F.col("inside"))

    def run(batches: Iterable[pa.RecordBatch]):
        release_encoders()
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                counts = decode_values(row["count_control"], row["count_data"], row["docs"]).astype(np.int64)
                ids = id_of[decode_values(row["control"], row["data"], row["tokens"])]
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - counts), pa.array(counts),
                    binary_rows(ids, ends),
                ], names=["doc_id", "start", "n_tokens", "ids"])
            give_back()

    return blocks.select("docs", "tokens", "doc_ids", "count_control", "count_data", "control", "data", "start").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")
