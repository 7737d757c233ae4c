"""Best-fit decreasing packing of token sequences into windows of fixed size, for any corpus size.

Overlong documents are cut into full windows and a rest. Best-fit decreasing then looks at lengths
alone, so it is run over the histogram of piece lengths, at most one row per token of the window: all
pieces of one length and all windows of one fill state move in one step. A segment tree indexed by
remaining capacity finds the tightest open windows that still take a length. The outcome is a list
of runs, "pieces ``rank`` onward of length L go to windows ``w`` onward", which every task applies
to the pieces it holds once their rank among all pieces of their length is known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from windrow.llm.common import discard, ship, written
from windrow.llm.tokens import encoded_slices, encoder, ragged

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank_in_part long, ids binary"
)
RANK_BITS = 44


class CapacityTree:
    """Segment tree over remaining capacities 0..size; leaves hold ranges of open windows."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.filled = [0] * (2 * self.width)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.width
        while node:
            self.filled[node] += by
            node >>= 1

    def put(self, capacity: int, first: int, count: int) -> None:
        self.ranges[capacity].append((first, count))
        self._change(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._change(capacity, -1)
        return self.ranges[capacity].pop()

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of at least ``length`` with an open window."""
        node = length + self.width
        if self.filled[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.filled[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.filled[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, pieces per window, first window, offset) placing every piece.

    ``counts`` is the number of pieces by length. Equal to best-fit decreasing piece by piece:
    after a piece went into the tightest window, that window is the tightest for the next equal
    piece while it still fits, so windows of one state fill up one after the other.
    """
    tree, opened, runs = CapacityTree(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = tree.take(room)
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, each, first, capacity - room))
                tree.put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                runs.append((length, rank, left, first + full, capacity - room))
                tree.put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < count:
                tree.put(room, first + full, count - full)
    return np.array(runs, np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """Pieces of at most ``capacity`` ids, each with its rank among pieces of its length in its part."""
    ship(docs.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        coder = encoder(tokenizer)
        for batch, flat, offsets in (x for b in batches for x in encoded_slices(coder, b, 1)):
            ids = np.insert(flat, offsets[1:], end_id).astype("<u4")
            sizes = np.diff(offsets) + 1
            pieces = -(-sizes // capacity)
            of = np.repeat(np.arange(len(sizes)), pieces)
            start = ragged(np.zeros(len(sizes), np.int64), pieces) * capacity
            length = np.minimum(capacity, sizes[of] - start)
            begin = (np.cumsum(sizes) - sizes)[of] + start
            raw = memoryview(ids.tobytes())
            spans = [raw[4 * a:4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
            order = np.argsort(length, kind="stable")
            by_length = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.searchsorted(by_length, by_length)
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(of)), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(sizes[of]),
                pa.array(np.full(len(of), part, np.int32)), pa.array(rank),
                pa.array([bytes(s) for s in spans] if keep_ids else [None] * len(of), pa.binary()),
            ], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Reads ``doc_id`` and ``text`` only; other columns do not matter. A NULL or empty text is the
    end id alone. Doc ids may be NULL or repeat: every row is packed by itself. An empty table
    gives no rows. Ties (equal lengths) follow the order of the input's parts. Windows never mix
    up pieces: a sequence's pieces have offsets from 0 without gaps. ``ids`` (little-endian 32-bit)
    is NULL unless ``keep_ids``.
    """
    pieces = written(cut_pieces(docs, tokenizer, end_id, capacity, keep_ids), "pieces")
    # At most one row per length, so at most ``capacity`` rows.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = best_fit_runs(counts, capacity)
    keys = (runs[:, 0] << RANK_BITS) | runs[:, 1]
    order = np.argsort(keys)
    keys, runs = keys[order], runs[order]

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank_in_part")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids")

    def place(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            length, rank = (np.asarray(batch.column(i), np.int64) for i in (2, 5))
            run = np.searchsorted(keys, (length << RANK_BITS) | rank, side="right") - 1
            nth = rank - runs[run, 1]
            each = runs[run, 2]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i in range(5)], pa.array(runs[run, 3] + nth // each),
                pa.array(runs[run, 4] + nth % each * length), batch.column(6),
            ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return ranked.mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def fill_sequences(packed: DataFrame) -> DataFrame:
    """The windows themselves, from pieces packed with ``keep_ids``: sequence_id, n_tokens, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
