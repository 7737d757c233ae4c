"""Documents scored by masked pseudo-likelihood under a bidirectional window network.

Every token is predicted from the two before and the two after it; a document's score is the sum
of the conditional log-probabilities. The network is one hidden layer over the neighbours'
embeddings and a softmax over token classes; a token's share of its class's count does the rest, so
the probabilities of all tokens sum to 1. Frequent tokens are classes of their own, the others
share classes of about equal count by frequency rank.

Counts come from the whole corpus. Training masks each position of every document in one of the
rounds, which a hash of the text and the place picks: a task runs mini-batches over its documents from the shared weights, and
the tasks' weights are averaged, each by the number of positions it trained on. So training data,
like counts, grow with the corpus, and a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import ship, written
from windrow.llm.tokens import binary_rows, encoded_slices, encoder, release_encoders

SIDE = 2
HIDDEN = 16
CLASSES = 128
OWN_CLASS = 96
INPUTS = 1024
ROUNDS = 3
MASK = 16
BATCH = 4096
RATE = 0.01
CHUNK = 1024
SCORED = 2048
HASHED = 16384
TOKENS_AT_ONCE = 1_000_000
PIECE = 4096


@dataclass
class Vocabulary:
    """By token id: input row, class, and log share of the class's count. Row INPUTS is no token."""

    row: np.ndarray
    cls: np.ndarray
    log_share: np.ndarray


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """Rows and classes by frequency rank; unseen ids count half a time."""
    weight = np.maximum(counts, 0.5)
    order = np.lexsort((np.arange(len(weight)), -weight))
    rank = np.empty(len(weight), np.int64)
    rank[order] = np.arange(len(weight))
    tail = weight[order][OWN_CLASS:]
    before = np.cumsum(tail) - tail
    bands = CLASSES - OWN_CLASS
    cls_of_rank = np.concatenate([
        np.arange(min(OWN_CLASS, len(weight))), OWN_CLASS + np.minimum(bands - 1, before * bands / max(tail.sum(), 1)).astype(np.int64)])
    cls = cls_of_rank[rank]
    total = np.bincount(cls, weight, CLASSES)
    # Rare tokens share the last rows, by rank.
    row = np.where(rank < INPUTS - 64, rank, INPUTS - 64 + rank % 64)
    return Vocabulary(row.astype(np.int16), cls.astype(np.int32), np.log(weight / total[cls]).astype(np.float32))


def initial_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "embed": (rng.standard_normal((2 * SIDE, INPUTS + 1, HIDDEN)) * 0.1).astype(np.float32),
        "bias": np.zeros(HIDDEN, np.float32),
        "out": (rng.standard_normal((HIDDEN, CLASSES)) * 0.1).astype(np.float32),
        "out_bias": np.zeros(CLASSES, np.float32),
    }


def contexts(rows: np.ndarray, counts: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """The input rows around every token, or those in ``places``, a row per neighbour; INPUTS outside the text."""
    n, stops = len(rows), np.cumsum(counts)
    padded = np.full(n + 2 * SIDE, INPUTS, rows.dtype)
    padded[SIDE:SIDE + n] = rows
    out = np.empty((2 * SIDE, n if places is None else len(places)), rows.dtype)
    for i, d in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        shifted = padded[SIDE + d:SIDE + d + n].copy()
        # The first places of a text have nothing that far before them, the last ones nothing behind. An edge
        # that passes over a short text meets places of the next one which are as near to its own edge.
        for k in range(abs(d)):
            edge = stops - counts + k if d < 0 else stops - 1 - k
            shifted[edge[(edge >= 0) & (edge < n)]] = INPUTS
        out[i] = shifted if places is None else shifted.take(places)
    return out


def _tables(w: dict) -> list[np.ndarray]:
    """Every neighbour's table of input rows; the first one has the bias."""
    return [w["embed"][0] + w["bias"], *w["embed"][1:]]


def _hidden(w: dict, around: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """The hidden layer, and a column of ones for the classes' bias."""
    tables = tables or _tables(w)
    h = tables[0].take(around[0], axis=0)
    for i in range(1, 2 * SIDE):
        h += tables[i].take(around[i], axis=0)
    # tanh x = 2 / (1 + exp -2x) - 1, as numpy's exp is the faster one; where that is infinite, -1 is right.
    h *= -2
    with np.errstate(over="ignore"):
        np.exp(h, out=h)
    h += 1
    np.divide(2, h, out=h)
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    np.subtract(h, 1, out=out[:, :-1])
    return out


def log_probabilities(w: dict, v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-probability of every token given its neighbours; texts of ``counts`` ids one after the other."""
    around, cls, tables, (layer, high) = contexts(v.row.take(ids), counts), v.cls.take(ids), _tables(w), _layer(w)
    out, room, ones = np.empty(len(ids), np.float64), np.empty((SCORED, layer.shape[1]), layer.dtype), np.ones(layer.shape[1], layer.dtype)
    for at in range(0, len(ids), SCORED):
        p = _logits(layer, high, _hidden(w, around[:, at:at + SCORED], tables), room)
        own = p.ravel().take(_places(cls[at:at + SCORED], p))
        out[at:at + SCORED] = own - np.log(np.exp(p, out=p) @ ones)
    out += v.log_share.take(ids)
    return out


def _places(cls: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Where every row's own class is in the flat scores."""
    return np.arange(0, p.size, p.shape[1]) + cls


def _layer(w: dict) -> tuple[np.ndarray, bool]:
    """The classes' weights over their bias, and whether a score can pass 80, as hidden values are within 1."""
    return np.vstack([w["out"], w["out_bias"]]), bool((np.abs(w["out"]).sum(axis=0) + w["out_bias"]).max() > 79)


def _logits(layer: np.ndarray, high: bool, h: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Class scores of a chunk, in memory that all chunks share."""
    p = np.matmul(h, layer, out=room[:len(h)])
    return np.minimum(p, 80, out=p) if high else p


def gradients(w: dict, around: np.ndarray, cls: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean negative log-probability of the classes, and its value.

    A few hundred positions are worked on at a time, so that their class scores stay in the cache.
    """
    n, loss = len(cls), 0.0
    h, (layer, high) = _hidden(w, around), _layer(w)
    both = np.zeros_like(layer.T)
    room, ones = np.empty((CHUNK, layer.shape[1]), layer.dtype), np.ones(layer.shape[1], layer.dtype)
    back = np.empty((n, len(w["out"])), h.dtype)
    turned = np.ascontiguousarray(w["out"].T)
    for at in range(0, n, CHUNK):
        part, mine = h[at:at + CHUNK], cls[at:at + CHUNK]
        p = _logits(layer, high, part, room)
        flat, places = p.ravel(), _places(mine, p)
        own = flat.take(places)
        # A product with ones adds up faster than a sum by rows.
        sums = np.exp(p, out=p) @ ones
        loss += float((np.log(sums) - own).sum())
        # The gradient by the scores is p over its row's sum and n: the narrow factors take that share, not p.
        flat[places] -= sums
        share = (1 / (sums * n))[:, None]
        np.multiply(p @ turned, share, out=back[at:at + CHUNK])
        both += p.T @ (part * share)
    back *= 1 - np.square(h[:, :-1])
    embed, pairs = np.zeros_like(w["embed"]), np.result_type(back.dtype, np.complex64)
    for i in range(2 * SIDE):
        order = np.argsort(around[i].astype(np.int16), kind="stable")
        rows = around[i].take(order)
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        # Two columns at a time, as the parts of complex numbers.
        embed[i, rows[heads]] = np.add.reduceat(back.take(order, axis=0).view(pairs), heads, axis=0).view(back.dtype)
    return {"embed": embed, "bias": np.ones(n, back.dtype) @ back, "out": np.ascontiguousarray(both[:, :-1].T), "out_bias": both[:, -1].copy()}, loss / max(n, 1)


class Adam:
    def __init__(self, w: dict):
        self.w, self.t = {k: x.copy() for k, x in w.items()}, 0
        self.m, self.s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.t += 1
        # A Python number keeps the arrays' 32 bits.
        rate = float(RATE * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t))
        for k, x in self.w.items():
            m, s, change = self.m[k], self.s[k], g[k] - self.m[k]
            m += np.multiply(change, 0.1, out=change)
            np.multiply(g[k], g[k], out=change)
            change -= s
            s += np.multiply(change, 0.001, out=change)
            np.sqrt(s, out=change)
            change += 1e-8
            np.divide(m, change, out=change)
            x -= np.multiply(change, rate, out=change)


def id_kind(tokenizer: str) -> str:
    """The narrower little-endian type that holds every id of a tokenizer file."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab().values(), default=0) < 1 << 16 else "<u4"


def _texts(batches: Iterable[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their ids one after the other, and the ids' number by row."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        # In ids; the values of a batch lie one after the other.
        data, ends = column.buffers()[2], ends // np.dtype(kind).itemsize
        ids, counts, start = np.frombuffer(data, kind, ends[-1]) if data else np.zeros(0, kind), np.diff(ends), 0
        while start < len(counts):
            stop = max(start + 1, int(np.searchsorted(ends[1:], ends[start] + TOKENS_AT_ONCE, side="right")))
            yield batch.slice(start, stop - start), ids[ends[start]:ends[stop]], counts[start:stop]
            start = stop


def token_rows(docs: DataFrame, tokenizer: str, kind: str) -> DataFrame:
    """doc_id and the ids of every text, each of them a ``kind``; NULL and empty texts have none.

    One row of every batch also has ``seen``: how often each id occurs in the batch, as 64-bit numbers.
    """
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]):
        coder = encoder(tokenizer)
        for whole in batches:
            seen, made = np.zeros(0, np.int64), None
            for batch, flat, offsets in encoded_slices(coder, whole, 1):
                if made is not None:
                    yield rows_of(*made, None)
                found = np.bincount(flat, minlength=len(seen))
                found[:len(seen)] += seen
                seen, made = found, (batch.column(0), binary_rows(flat.astype(kind), offsets[1:]))
            if made is not None:
                yield rows_of(*made, seen.astype("<i8").tobytes())

    def rows_of(doc_ids, ids, seen):
        return pa.RecordBatch.from_arrays(
            [doc_ids, ids, pa.array([seen] + [None] * (len(ids) - 1), pa.binary())], names=["doc_id", "ids", "seen"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids binary, seen binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus; one number per id of the vocabulary reaches the driver."""

    def count(batches: Iterable[pa.RecordBatch]):
        release_encoders()
        total = np.zeros(0, np.int64)
        for seen in (np.frombuffer(x, "<i8") for b in batches for x in b.column(0).to_pylist()):
            found = np.zeros(max(len(total), len(seen)), np.int64)
            found[:len(total)] = total
            found[:len(seen)] += seen
            total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    rows = tokens.select("seen").where(F.col("seen").isNotNull()).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (np.asarray(rows.column(c), np.int64) for c in ("id", "n"))
    counts = np.zeros(max(int(ids.max(initial=0)) + 1, OWN_CLASS), np.int64)
    counts[ids] = n
    return counts


def _flatten(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def _unflatten(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def parts_of(ids: np.ndarray, counts: np.ndarray, parts: int) -> np.ndarray:
    """A part from 0 to ``parts`` - 1 for every position, by a hash of its text and its place."""
    ends = np.cumsum(counts)
    whole = np.ascontiguousarray(ids, "<u4")
    text = np.array([zlib.crc32(whole[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())], np.uint64)
    # Text's hash and place in one number: places are counted on from where the text begins.
    mixed = np.repeat((text << np.uint64(32)) - (ends - counts).astype(np.uint64), counts)
    out, places, room = np.empty(len(mixed), np.int64), np.arange(min(HASHED, len(mixed)), dtype=np.uint64), np.empty(HASHED, np.uint64)
    for at in range(0, len(mixed), HASHED):
        x = mixed[at:at + HASHED]
        x += places[:len(x)]
        x += np.uint64(at)
        for _ in range(2):
            x ^= np.right_shift(x, np.uint64(31), out=room[:len(x)])
            x *= np.uint64(0x9E3779B97F4A7C15)
        x >>= np.uint64(40)
        out[at:at + HASHED] = x.astype(np.uint32) % np.uint32(parts)
    return out


def train(tokens: DataFrame, v: Vocabulary, rounds: int = ROUNDS, mask: int = MASK, seed: int = 1, kind: str = "<u4") -> dict:
    """Weights after ``rounds`` rounds, which mask every position of all documents once between them.

    Positions fall into ``mask`` parts, and every round takes its share of the parts.
    """
    shape = initial_weights(seed)
    weights = shape

    def one_round(r: int, start: dict):
        def run(batches: Iterable[pa.RecordBatch]):
            adam, used, held = Adam(start), 0, []
            wanted = np.arange(mask) * rounds // mask == r

            def learn(parts):
                # A position's neighbours side by side, as they are picked in any order.
                around = np.ascontiguousarray(np.concatenate([p[0] for p in parts], axis=1).T)
                cls = np.concatenate([p[1] for p in parts])
                order = np.random.default_rng([seed, r, used]).permutation(len(cls))
                for at in range(0, len(cls), BATCH):
                    pick = order[at:at + BATCH]
                    adam.step(gradients(adam.w, around.take(pick, axis=0).T, cls.take(pick))[0])
                return len(cls)

            for _, ids, counts in _texts(batches, kind):
                masked = np.flatnonzero(wanted.take(parts_of(ids, counts, mask)))
                held.append((contexts(v.row.take(ids), counts, masked), v.cls.take(ids.take(masked))))
                if sum(len(p[1]) for p in held) >= 64 * BATCH:
                    used += learn(held)
                    held = []
            if held:
                used += learn(held)
            flat = _flatten(adam.w) * used
            if used:
                cut = [flat[i:i + PIECE] for i in range(0, len(flat), PIECE)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(len(cut)), pa.int32()), pa.array([used] * len(cut), pa.int64()),
                    pa.array([c.tobytes() for c in cut], pa.binary())], names=["piece", "used", "sums"])

        return run

    def add(key, table):
        sums = np.sum([np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist()], axis=0)
        used = pc.sum(table.column("used")).as_py()
        return pa.table({"piece": [key[0].as_py()], "used": [used], "sums": [sums.tobytes()]},
                        schema=pa.schema([("piece", pa.int32()), ("used", pa.int64()), ("sums", pa.binary())]))

    for r in range(rounds):
        made = tokens.select("ids").mapInArrow(one_round(r, weights), "piece int, used long, sums binary")
        # The same few pieces from every task; salted first, so a piece is added up by many tasks.
        schema = "piece int, used long, sums binary"
        salted = made.withColumn("salt", F.spark_partition_id() % 64)
        part = salted.groupBy("piece", "salt").applyInArrow(add, schema)
        summed = part.groupBy("piece").applyInArrow(add, schema).orderBy("piece").collect()
        if summed:
            weights = _unflatten(np.concatenate([np.frombuffer(x["sums"], np.float64) / x["used"] for x in summed]), shape)
    return weights


def score(tokens: DataFrame, weights: dict, v: Vocabulary, kind: str = "<u4") -> DataFrame:
    """doc_id, n_tokens, log_likelihood, per_token of every row of ``tokens``."""

    def run(batches: Iterable[pa.RecordBatch]):
        for rows, ids, counts in _texts(batches, kind):
            of = np.repeat(np.arange(len(counts)), counts)
            total = np.bincount(of, log_probabilities(weights, v, ids, counts), len(counts)) if len(ids) else np.zeros(len(counts))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts), pa.array(total)], names=["doc_id", "n_tokens", "log_likelihood"])

    scored = tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double")
    return scored.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def score_documents(docs: DataFrame, tokenizer: str, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """Score of every document under the network trained on all of them.

    NULL and empty texts have no tokens, log-likelihood 0 and no score per token. Doc ids may be
    NULL or repeat; rows with one text get one score. Other columns are not read. An empty table
    gives no rows. Texts are scored whole: a slice boundary never cuts one.
    """
    kind = id_kind(tokenizer)
    # Read five times: a little more room for less time.
    tokens = written(token_rows(docs, tokenizer, kind), "tokens", compression="snappy")
    v = vocabulary(count_ids(tokens))
    return score(tokens, train(tokens, v, rounds, seed=seed, kind=kind), v, kind)
