"""Token ids by a tokenizers file, and word hashes, for whole Arrow columns of texts.

Most texts repeat the same words, so an ``Encoder`` hands every different word to the tokenizer
once and puts documents together from the ids kept. Words are cut where white space begins after
other characters, and where an ASCII mark follows an ASCII letter or digit; no tokenizer used here
joins characters across such places, so the ids are those of the whole text. Texts with unusual white space take a slower cut, or go to the tokenizer whole.
"""

from __future__ import annotations

import ctypes
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words kept, and bytes of text put together at a time: the arrays of a slice are some thirty times its size.
CACHED_WORDS = 1_200_000
SLICE_BYTES = 500_000
CUT = re.compile(r"\s*\S+|\s+")
# Slices between two calls that give freed memory back, as every page given back is faulted in again.
SLICES_KEPT = 8
# White space that is no single byte: what follows a lead byte of UTF-8.
WIDE_BLANKS = {
    0xC2: [[(0x85, 0x85)], [(0xA0, 0xA0)]],
    0xE1: [[(0x9A, 0x9A), (0x80, 0x80)]],
    0xE2: [[(0x80, 0x80), (0x80, 0x8A)], [(0x80, 0x80), (0xA8, 0xA9)], [(0x80, 0x80), (0xAF, 0xAF)], [(0x81, 0x81), (0x9F, 0x9F)]],
    0xE3: [[(0x80, 0x80), (0x80, 0x80)]],
}
# Python counts these as white space, the tokenizers' patterns do not.
DOUBTFUL = re.compile("[\x1c-\x1f]")
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This process's encoder for a tokenizer file, kept with its words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, as workers live on between tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def release_encoders() -> None:
    """Give back the words kept by encoders and hash tables; called where a worker turns to other work."""
    _ENCODERS.clear()
    _Powers.up = _Powers.down = np.ones(1, np.uint64)
    give_back()


def text_column(column) -> pa.Array:
    """An Arrow column as one array of strings, NULL as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array, most: int | None = None):
    """Runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    most = SLICE_BYTES if most is None else most
    lengths = np.asarray(pc.binary_length(texts), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def encoded_slices(coder: "Encoder", batch: pa.RecordBatch, column: int):
    """Runs of a batch's rows with the ids of their texts and the offsets in them, a few MB at a time."""
    at = 0
    for part in slices(text_column(batch.column(column))):
        flat, offsets = coder.encode(part)
        yield batch.slice(at, len(part)), flat, offsets
        at += len(part)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


def binary_rows(values: np.ndarray, stops: np.ndarray) -> pa.Array:
    """One binary value for each run of ``values`` that ends before a stop, over the same memory."""
    offsets = np.zeros(len(stops) + 1, np.int32)
    offsets[1:] = stops * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


class Encoder:
    """Ids of whole texts, put together from the ids of their words.

    Words met before are found by a 64-bit hash in a table of whole arrays, so a slice of texts costs
    a few passes over its bytes; only new words go through Python and the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that hold a token of these go to the tokenizer whole, as it may join what stands around it.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        # Their first two bytes, in either case.
        self.added_starts = sorted({tuple(f.encode()[:2]) for t in added for f in (t.lower(), t.upper()) if len(f.encode()) > 1})
        self.calls = 0
        self.mark, self.mark_id = self._find_mark()
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _has_added(self, text: str) -> bool:
        return self.added is not None and self.added.search(text) is not None

    def _find_mark(self):
        """A string that always becomes one token of its own between two words, if there is one."""
        left, right = self._ids("ab"), self._ids(" cd")
        for mark in ("\n", " 0 "):
            both = self._ids("ab" + mark + " cd")
            if len(both) == len(left) + 1 + len(right) and both[: len(left)] == left and both[len(left) + 1:] == right:
                return mark, both[len(left)]
        return None, None

    def _forget(self):
        self.count = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths, self.hits = (np.zeros(1 << 14, np.int32) for _ in range(2))
        self.others: dict[str, int] = {}  # pieces of texts with unusual white space
        self._new_table(1 << 16)

    def _new_table(self, size: int):
        self.slot_keys, self.slot_words, self.filled = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0

    def _forget_rare(self):
        """Keep the words that were met at least twice, while they fill half the room at most."""
        held = np.flatnonzero(self.slot_keys)
        held = held[self.hits[self.slot_words[held]] >= 2]
        if len(held) > CACHED_WORDS // 2:
            return self._forget()
        kept, keys = self.slot_words[held], self.slot_keys[held]
        lengths, hits = self.lengths[kept].astype(np.int64), self.hits[kept]
        ids = self.flat[ragged(self.starts[kept], lengths)]
        self._forget()
        if len(kept):
            at = self._keep(lengths, ids)
            self.hits[at] = hits
            self._insert(keys, at)

    def _keep(self, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        first, n = self.count, len(lengths)
        while len(self.starts) < first + n:
            self.starts, self.lengths, self.hits = map(_doubled, (self.starts, self.lengths, self.hits))
        while len(self.flat) < self.used + len(ids):
            self.flat = _doubled(self.flat)
        self.lengths[first:first + n] = lengths
        self.starts[first:first + n] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.count += n
        return np.arange(first, first + n)

    def _insert(self, keys: np.ndarray, words: np.ndarray) -> None:
        """Put new keys, all different, into free slots."""
        if 2 * (self.filled + len(keys)) > len(self.slot_keys):
            old = self.slot_keys > 0
            held, at = self.slot_keys[old], self.slot_words[old]
            self._new_table(1 << int(2 * (len(held) + len(keys))).bit_length())
            keys, words = np.concatenate([held, keys]), np.concatenate([at, words])
        self.filled += len(keys)
        mask = np.uint64(len(self.slot_keys) - 1)
        slot = keys & mask
        while len(keys):
            free = self.slot_keys[slot] == 0
            self.slot_keys[slot[free]] = keys[free]
            won = self.slot_keys[slot] == keys
            self.slot_words[slot[won]] = words[won]
            keys, words, slot = keys[~won], words[~won], (slot[~won] + np.uint64(1)) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the words with these keys, -1 for new ones."""
        mask = np.uint64(len(self.slot_keys) - 1)
        slot = keys & mask
        there = self.slot_keys[slot]
        out = np.where(there == keys, self.slot_words[slot], -1).astype(np.int64)
        left = np.flatnonzero((there != keys) & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + np.uint64(1)) & mask
            there = self.slot_keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.slot_words[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on]
        return out

    def _learn(self, words: list[str], plain: bool = False) -> np.ndarray:
        """Encode words not met before; simple ones many at a time, with marks between them.

        ``plain`` says that no word has white space but one space in front. Returns their places.
        """
        if self.mark is None:
            together = np.zeros(len(words), bool)
        elif plain and self.mark == "\n":
            together = np.ones(len(words), bool)
        else:
            bare = self.mark.strip(" ")
            together = np.array([bare not in w and _plain(w) and not self._has_added(w) for w in words], bool)
        place = np.full(len(words), -1, np.int64)
        at = np.flatnonzero(together)
        groups = [at[i:i + 48] for i in range(0, len(at), 48)]
        for i in range(0, len(groups), 256):
            part = groups[i:i + 256]
            encoded = self.tokenizer.encode_batch_fast(
                [self.mark.join([words[k] for k in g.tolist()]) for g in part], add_special_tokens=False)
            # One mark between two words, and one put behind every group.
            ids = np.fromiter(chain.from_iterable(e.ids + [self.mark_id] for e in encoded), np.int32)
            cuts = np.flatnonzero(ids == self.mark_id)
            stops = np.cumsum([len(e) + 1 for e in encoded])
            words_in = np.diff(np.searchsorted(cuts, stops), prepend=0)
            right = words_in == [len(g) for g in part]
            if right.any():
                lengths = np.diff(cuts, prepend=-1) - 1
                inner = ids != self.mark_id
                if not right.all():
                    inner &= np.repeat(right, np.diff(stops, prepend=0))
                    lengths = lengths[np.repeat(right, words_in)]
                place[np.concatenate([g for g, good in zip(part, right) if good])] = self._keep(lengths, ids[inner])
        single = np.flatnonzero(place < 0)
        for i in range(0, len(single), 4096):
            part = single[i:i + 4096]
            encoded = self.tokenizer.encode_batch_fast([words[k] for k in part.tolist()], add_special_tokens=False)
            ids = [np.array(e.ids, np.int32) for e in encoded]
            place[part] = self._keep(np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids))
        return place

    def _other(self, pieces: list[str]) -> np.ndarray:
        """Places of pieces of a text with unusual white space."""
        new = [w for w in dict.fromkeys(pieces) if w not in self.others]
        if new:
            self.others.update(zip(new, self._learn(new).tolist()))
        return np.array([self.others[w] for w in pieces], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (int32), and n+1 offsets of the texts in them."""
        ids, counts = [], []
        for part in slices(texts):
            if self.count > CACHED_WORDS:
                self._forget_rare()
            flat, per_text = self._encode_slice(part)
            ids.append(flat)
            counts.append(per_text)
            self.calls += 1
            if self.calls % SLICES_KEPT == 0:
                give_back()
        offsets = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=offsets[1:])
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), offsets

    def _unusual(self, raw: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """By text, whether its white space is more than single spaces and line breaks between words.

        Texts that may hold an added token count as well.
        """
        # In bytes that wrap around: 9 to 13 but the line feed, and 0x1C to 0x1F.
        odd = raw - np.uint8(9) < 5
        odd &= raw != 10
        odd |= raw - np.uint8(0x1C) < 4
        odd[1:] |= cut[1:] & cut[:-1]
        for lead, table in WIDE_BLANKS.items():
            at = np.flatnonzero(raw[:-2] == lead) if len(table[0]) == 2 else np.flatnonzero(raw[:-1] == lead)
            for rest in table:
                hit = np.ones(len(at), bool)
                for i, (low, high) in enumerate(rest):
                    hit &= (raw[at + 1 + i] >= low) & (raw[at + 1 + i] <= high)
                odd[at[hit]] = True
        for one, two in self.added_starts:
            at = np.flatnonzero(raw[:-1] == one)
            odd[at[raw[at + 1] == two]] = True
        begins = offsets[:-1]
        filled = offsets[1:] > begins
        at = np.flatnonzero(odd)
        out = np.zeros(len(filled), bool)
        out[np.searchsorted(offsets, at, side="right") - 1] = True
        out[filled] |= cut[begins[filled]] | cut[offsets[1:][filled] - 1]
        return out

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        raw, offsets = text_bytes(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        cut = (raw == 32) | (raw == 10)
        slow = self._unusual(raw, offsets, cut)
        first, last = runs(~cut, offsets, marks_after_words(raw))
        text = np.repeat(np.arange(n), np.diff(np.searchsorted(first, offsets)))
        if slow.any():
            usual = ~slow[text]
            first, last, text = first[usual], last[usual], text[usual]
        # A word after a space is another word than one at the start of a line or behind a word.
        inner = first != offsets[text]
        before = raw[first - 1]
        broken = inner & (before == 10)
        spaced = inner & (before == 32)
        keys = run_hashes(raw, first, last)
        keys[spaced] = scramble(keys[spaced] + GOLDEN)
        keys = np.maximum(keys, np.uint64(1))
        word = self._find(keys)
        new = np.flatnonzero(word < 0)
        if len(new):
            fresh, at, back = np.unique(keys[new], return_index=True, return_inverse=True)
            at = new[at]
            strings = run_strings(raw, first[at], last[at]).to_pylist()
            place = self._learn([" " + w if s else w for w, s in zip(strings, spaced[at].tolist())], plain=True)
            self._insert(fresh, place)
            word[new] = place[back]
        # Line breaks inside a text are words of their own.
        where = np.arange(len(word)) + np.cumsum(broken)
        sequence = np.empty(len(word) + int(broken.sum()), np.int64)
        sequence[where] = word
        if broken.any():
            sequence[where[broken] - 1] = self._other(["\n"])[0]
        per_text = np.bincount(text, minlength=n) + np.bincount(text[broken], minlength=n)
        if slow.any():
            sequence, per_text = self._put_slow(texts, slow, sequence, per_text)
        np.add.at(self.hits, sequence, np.int32(1))
        self.hits[sequence] = np.minimum(self.hits[sequence], 1 << 30)
        lengths = self.lengths.take(sequence).astype(np.int64)
        ids = self.flat.take(ragged(self.starts.take(sequence), lengths))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.cumsum(per_text)
        return ids, ends[stops] - ends[stops - per_text]

    def _put_slow(self, texts, slow, sequence, per_text):
        stops = np.cumsum(per_text)
        out, done, counts = [], 0, per_text.copy()
        for i in np.flatnonzero(slow).tolist():
            text = texts[i].as_py()
            if not text:
                pieces = []
            elif DOUBTFUL.search(text) or self._has_added(text):
                pieces = [text]
            else:
                pieces = CUT.findall(text)
            out += [sequence[done:stops[i]], self._other(pieces) if pieces else np.zeros(0, np.int64)]
            done, counts[i] = int(stops[i]), len(pieces)
        return np.concatenate([*out, sequence[done:]]), counts


def _doubled(values: np.ndarray) -> np.ndarray:
    """The values with as much room again, which takes no memory before it is used."""
    out = np.zeros(2 * len(values), values.dtype)
    out[:len(values)] = values
    return out


def _plain(word: str) -> bool:
    """No white space at the ends but one space in front, which is what the text had there."""
    first = word[1:2] if word[0] == " " else word[0]
    return bool(first) and not first.isspace() and not word[-1].isspace()


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, np.uint8)
WORD[48:58] = WORD[97:123] = 1
WORD[128:] = 1
# Words and, as a class of their own, runs of ASCII punctuation.
WORD_OR_MARKS = WORD.copy()
WORD_OR_MARKS[33:127][WORD[33:127] == 0] = 2
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw_key(i: int) -> np.uint64:
    """The ``i``-th of a fixed sequence of 64-bit numbers."""
    return np.uint64(i * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


BYTE_VALUES = scramble(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            size = max(n, 1 << 19)
            cls.up, cls.down = (np.full(size, b, np.uint64) for b in (BASE, INVERSE))
            cls.up[0] = cls.down[0] = 1
            np.multiply.accumulate(cls.up, out=cls.up)
            np.multiply.accumulate(cls.down, out=cls.down)
        return cls.up[:n], cls.down[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and n+1 offsets."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, classes=WORD) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z lower-cased, and n+1 offsets of the texts in them.

    A word is a run of bytes of one class other than 0.
    """
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    raw = LOWER[raw]
    kind = classes[raw]
    cut = kind[1:] != kind[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    cut[edges - 1] = True
    begins = kind > 0
    ends = begins.copy()
    begins[1:] &= cut
    ends[:-1] &= cut
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _Powers.of(len(raw))
    sums = np.cumsum(BYTE_VALUES[raw] * up, dtype=np.uint64)
    value = sums[last] - sums[first] + BYTE_VALUES[raw[first]] * up[first]
    hashes = scramble(value * down[first] + (last - first).astype(np.uint64) * GOLDEN)
    return hashes, np.searchsorted(first, offsets)


def marks_after_words(raw: np.ndarray) -> np.ndarray:
    """Whether an ASCII mark stands here and an ASCII letter or digit before it."""
    # In bytes that wrap around: letters in either case, digits, and what else is from 33 to 126.
    word = (raw | np.uint8(32)) - np.uint8(97) < 26
    word |= raw - np.uint8(48) < 10
    out = raw - np.uint8(33) < 94
    out &= ~word
    out[1:] &= word[:-1]
    out[:1] = False
    return out


def runs(inside: np.ndarray, offsets: np.ndarray, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First places of the maximal runs of flagged bytes and the places behind them.

    No run crosses a text, and one begins at every flagged byte that ``split`` holds.
    """
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] if split is None else ~inside[:-1] | split[1:]
    ends[:-1] &= ~inside[1:] if split is None else ~inside[1:] | split[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def run_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every run."""
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.take(BYTE_VALUES, raw, out=sums[1:], mode="clip")
    sums[1:] *= up[:-1]
    np.cumsum(sums, out=sums)
    return scramble((sums.take(last) - sums.take(first)) * down.take(first) + (last - first).astype(np.uint64) * GOLDEN)


def run_strings(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The runs as Arrow strings."""
    lengths = last - first
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = raw[ragged(first, lengths)]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
