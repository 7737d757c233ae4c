"""Repeated passages removed by relative Lempel-Ziv parsing.

The reference is made of blocks of words, cut from all documents at places that their own content
picks: in every window of ``window`` words the block with the smallest hash is one, so any two
occurrences of a window hold the same block at the same place in it. The index names for each block
its first owner, the document with the smallest id and the place there. A document is then parsed
greedily from left to right: a factor starts at a block, copies from the block's owner and goes on
while the next block continues the same stretch of the same owner. A factor of at least ``window``
words is a duplicate span. Windows that reach over the ends of factors, and those of owners they may
be copies of, are checked by their own hashes over all documents.

No window escapes. If it lies in a factor, an earlier document has it. If its smallest block is in no
other document, neither is the window. Else it is checked by hash, and so it is in the first document
that holds it: there it lies in no factor, as that would be copied from an earlier one, and its
smallest block is the same, so it is known elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import discard, key_columns, ship, written
from windrow.llm.tokens import give_back, run_hashes, runs, slices, text_bytes, text_column
from windrow.llm.words import byte_set, sliding, window_hashes

BLANK = byte_set(0x20, (0x09, 0x0D))
# Text cut at a time: its bytes and words take some fifty times its size, in every worker of an executor.
CUT_BYTES = 500_000
EARLIER, OWN, UNKNOWN = 1, 2, 0
_KEYS = ["doc_id", "k1", "k2"]


class _Cut:
    """The words of a run of texts and the blocks picked among them."""

    def __init__(self, texts: pa.Array, window: int, block: int):
        self.raw, offsets = text_bytes(texts)
        self.first, self.last = runs(~BLANK[self.raw], offsets)
        self.word_ends = np.searchsorted(self.first, offsets)  # n+1 offsets of the texts in words
        self.hashes = run_hashes(self.raw, self.first, self.last)
        self.window, self.block = window, block
        n = len(self.hashes)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.word_ends))
        # Window starts whose window ends in the same text.
        self.starts = np.zeros(n, bool)
        if n >= window:
            self.starts[:n - window + 1] = self.text[window - 1:] == self.text[:n - window + 1]
        self.places, self.blocks = self._pick()

    def _pick(self):
        span = self.window - self.block + 1  # blocks in a window
        grams = window_hashes(self.hashes, self.block, 1)
        if len(grams) < span:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = np.maximum(grams, np.uint64(1))
        least = sliding(grams, span, np.minimum)
        least[~self.starts[:len(least)]] = 0  # no window here
        self.least = least
        padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        most = sliding(padded, span, np.maximum)
        places = np.flatnonzero(most[:len(grams)] == grams)
        return places, grams[places]

    def smallest(self, starts: np.ndarray) -> np.ndarray:
        """For windows at ``starts``, which of the picked blocks is the smallest one in it."""
        values, rank = np.unique(self.blocks, return_inverse=True)
        code = rank * (len(self.hashes) + 1) + self.places
        order = np.argsort(code)
        wanted = np.searchsorted(values, self.least[starts]) * (len(self.hashes) + 1) + starts
        return order[np.searchsorted(code[order], wanted)]


def _parse(cut: _Cut, state, source, shift):
    """Duplicate spans of factors (first word, word behind the last) and window starts to be checked.

    One entry per picked block: what the index says of its owner, which document that is and how
    far from this place its first occurrence lies.
    """
    places, n = cut.places, len(cut.hashes)
    if not len(places):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    text = cut.text[places]
    goes_on = (state[1:] == EARLIER) & (state[:-1] == EARLIER) & (source[1:] == source[:-1]) & (shift[1:] == shift[:-1])
    goes_on &= (text[1:] == text[:-1]) & (places[1:] - places[:-1] <= cut.block)
    factor = np.concatenate([[0], np.cumsum(~goes_on)])
    heads = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    tails = np.append(heads[1:], len(places)) - 1
    begin, end = places[heads], places[tails] + cut.block
    long = (state[heads] == EARLIER) & (end - begin >= cut.window)
    spans = np.stack([begin[long], end[long]], 1)

    starts = np.flatnonzero(cut.starts)
    asked = state[cut.smallest(starts)] != UNKNOWN
    before = np.searchsorted(places, starts, side="right") - 1  # the block that starts here or before
    at = factor[np.maximum(before, 0)]
    copied = (before >= 0) & (state[np.maximum(before, 0)] == EARLIER) & (end[at] >= starts + cut.window)
    return spans, starts[asked & ~copied]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def duplicate_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, k1, k2, spans: stretches of words that an earlier document repeats, by document.

    ``spans`` has [first word, word behind the last]; spans may overlap. k1 and k2 are the text's
    content key. Documents without spans have no row.
    """
    spark = docs.sparkSession
    ship(spark)
    block = window // 2 + 1
    texts = docs.select("doc_id", *key_columns(F.col("text")), "text").where("text IS NOT NULL")

    def blocks_of(batches):
        for batch in batches:
            at = 0
            for part in slices(text_column(batch.column(3)), CUT_BYTES):
                cut = _Cut(part, window, block)
                text = cut.text[cut.places]
                rows = pa.array(at + text)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(rows) for i in range(3)],
                     pa.array((cut.places - cut.word_ends[text]).astype(np.int32)), _signed(cut.blocks)],
                    names=[*_KEYS, "place", "block"])
                at += len(part)
            give_back()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = written(texts.mapInArrow(blocks_of, f"doc_id {id_type}, k1 long, k2 long, place int, block long"), "blocks")
    # NULL ids come last; two of them are as equal as any other repeated id.
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"))
    order = F.struct(rank.alias("rank"), F.col("k1"), F.col("k2"), F.col("place"))
    index = found.groupBy("block").agg(F.min(order).alias("first"), F.max(rank).alias("latest"))
    index = written(index.where("first.rank < latest").select(
        "block", F.col("first.rank").alias("owner"), F.xxhash64("first.rank", "first.k1", "first.k2").alias("source"),
        F.col("first.place").alias("source_place")), "index")
    known = found.join(index, "block").select(
        *_KEYS, "place", F.when(F.col("owner") < rank, F.lit(EARLIER)).otherwise(F.lit(OWN)).alias("state"),
        "source", (F.col("source_place") - F.col("place")).alias("shift"))
    per_text = known.groupBy(*_KEYS).agg(F.collect_set(F.struct("place", "state", "source", "shift")).alias("known"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in _KEYS]
    joined = texts.alias("t").join(per_text.alias("p"), same[0] & same[1] & same[2]).select("t.*", "p.known")

    def parse(batches):
        for batch in batches:
            at = 0
            for part in slices(text_column(batch.column(3)), CUT_BYTES):
                yield _parsed(batch.slice(at, len(part)), part)
                at += len(part)
            give_back()

    def _parsed(batch, part):
        cut = _Cut(part, window, block)
        lists = batch.column(4)
        sizes = np.asarray(lists.value_lengths(), np.int64)
        entries = lists.flatten()
        place = np.asarray(entries.field(0), np.int64) + np.repeat(cut.word_ends[:-1], sizes)
        to = np.searchsorted(cut.places, place)
        n = len(cut.places)
        state, source, shift = np.zeros(n, np.int8), np.zeros(n, np.int64), np.zeros(n, np.int64)
        state[to], source[to], shift[to] = (np.asarray(entries.field(i)) for i in (1, 2, 3))
        spans, checked = _parse(cut, state, source, shift)
        full = [window_hashes(cut.hashes, window, key) for key in (2, 3)]
        span_text, window_text = cut.text[spans[:, 0]] if len(spans) else np.zeros(0, np.int64), cut.text[checked]
        row = np.concatenate([span_text, window_text])
        base = cut.word_ends[row]
        begin = np.concatenate([spans[:, 0], checked]) - base
        end = np.concatenate([spans[:, 1], checked + window]) - base
        nothing = pa.nulls(len(spans), pa.int64())
        w = [pa.concat_arrays([nothing, _signed(f[checked])]) for f in full]
        rows = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [*[batch.column(i).take(rows) for i in range(3)], pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), *w],
            names=[*_KEYS, "begin", "end", "w1", "w2"])

    parsed = written(joined.mapInArrow(
        parse, f"doc_id {id_type}, k1 long, k2 long, begin int, end int, w1 long, w2 long"), "factors")
    windows = parsed.where("w1 IS NOT NULL")
    held = windows.groupBy("w1", "w2").agg(F.min(rank).alias("owner"), F.max(rank).alias("latest"))
    held = written(held.where("owner < latest").select("w1", "w2", "owner"), "windows")
    repeated = windows.join(held, ["w1", "w2"]).where(F.col("owner") < rank)
    spans = parsed.where("w1 IS NULL").select(*_KEYS, "begin", "end").union(repeated.select(*_KEYS, "begin", "end"))
    out = written(spans.groupBy(*_KEYS).agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    discard(found, index, parsed, held)
    return out


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """All columns of ``docs`` as ``row``, with kept_text, n_words and n_removed.

    Words are runs of characters other than blanks (space, tab, line breaks). A word goes if a window
    of ``window`` consecutive words that covers it also starts in a document with a smaller doc_id;
    what is kept is joined by one space. Windows are those of the input. NULL and empty texts have no
    words; texts shorter than a window lose none. Rows with one doc_id are not earlier than each
    other; a NULL doc_id comes after all others. Clashing column names stay inside ``row``.
    """
    ship(docs.sparkSession)
    spans = duplicate_spans(docs, window).alias("s")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # The text is read from its place in the row, which is all that moves.
    names = docs.columns if "text" in docs.columns else [c.lower() for c in docs.columns]
    place = names.index("text")
    whole = docs.select(row, F.col("doc_id"), *key_columns(F.col("text"))).alias("t")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _KEYS]
    joined = whole.join(spans, same[0] & same[1] & same[2], "left").select("t.row", "s.spans")
    schema = f"row {whole.schema['row'].dataType.simpleString()}, kept_text string, n_words long, n_removed long"

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(text_column(batch.column(0).field(place)), CUT_BYTES):
                kept, words, removed = _kept(part, batch.column(1).slice(at, len(part)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), kept, pa.array(words), pa.array(removed)],
                    names=["row", "kept_text", "n_words", "n_removed"])
                at += len(part)
            give_back()

    def _kept(texts, lists):
        raw, offsets = text_bytes(texts)
        first, last = runs(~BLANK[raw], offsets)
        ends = np.searchsorted(first, offsets)
        sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        entries = lists.flatten()
        base = np.repeat(ends[:-1], sizes)
        edge = np.zeros(len(first) + 1, np.int64)
        np.add.at(edge, np.asarray(entries.field(0), np.int64) + base, 1)
        np.add.at(edge, np.asarray(entries.field(1), np.int64) + base, -1)
        gone = np.cumsum(edge)[:-1] > 0
        gone_before = np.concatenate([[0], np.cumsum(gone)])
        removed = gone_before[ends[1:]] - gone_before[ends[:-1]]
        words = np.diff(ends)
        stays = ~gone
        # Kept words with one space behind each but the last of a text.
        a, b = first[stays], last[stays]
        text = np.repeat(np.arange(len(texts)), words)[stays]
        lengths = b - a + 1
        last_of = np.ones(len(a), bool)
        last_of[:-1] = text[1:] != text[:-1]
        lengths[last_of] -= 1
        stops = np.cumsum(lengths)
        where = np.repeat(a - (stops - lengths), lengths) + np.arange(int(stops[-1]) if len(stops) else 0)
        data = raw[np.minimum(where, max(len(raw) - 1, 0))] if len(where) else np.zeros(0, np.uint8)
        spaces = (stops - 1)[~last_of]
        data[spaces] = 32
        per_text = np.bincount(text, weights=lengths, minlength=len(texts)).astype(np.int64)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(per_text, out=at[1:])
        kept = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(data))
        return kept.cast(pa.string()), words.astype(np.int64), removed.astype(np.int64)

    return joined.mapInArrow(run, schema)
