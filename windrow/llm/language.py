"""Language identification that allows for several languages in one text.

Every word of a text is taken to come from one of the text's languages; a language gives a word the
product of its letter triples' probabilities. Expectation-maximisation estimates the shares of the
languages in the text. The set of languages is chosen by likelihood less a penalty for each language
beyond the first, among sets that grow by EM over all languages and by each language's own gain.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import discard, ship, with_computed, written
from windrow.llm.tokens import LOWER, ragged, release_encoders, slices, text_bytes, text_column

GRAMS = 1 << 16
BLOCK = 256
CELLS = 4_000_000
ROUNDS = 12
PENALTY = 3.0
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True


def word_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed triples of all words' letters (with the space around), first triple of each word, and
    the text of each word."""
    raw, offsets = text_bytes(texts)
    # A space stands between texts, so no triple reaches from one into the next.
    line = np.insert(LOWER[raw], offsets[:-1], 32) if len(texts) else raw
    line = np.append(line, 32)
    inside = LETTERS[line]
    line = np.where(inside, line, np.uint8(32)).astype(np.uint32)
    middle = np.flatnonzero(inside)
    two = line[:-1] * np.uint32(65_599) + line[1:]
    three = (two[:-1] * np.uint32(65_599) + line[2:]) * np.uint32(0x9E3779B1)
    grams = (three >> np.uint32(13) & np.uint32(GRAMS - 1))[middle - 1]
    first = np.flatnonzero(~inside[middle - 1])
    starts = offsets[:-1] + np.arange(len(texts))
    return grams, first, np.searchsorted(starts, middle[first], side="right") - 1


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # gram, language

    @staticmethod
    def _mixture(like, first, of, cols):
        """Shares of the languages ``cols`` of each text and its log likelihood under them."""
        like = np.take_along_axis(like, cols[of], axis=1)
        words = np.diff(np.append(first, len(of)))[:, None]
        share = np.full(cols.shape, 1 / cols.shape[1])
        for _ in range(ROUNDS):
            part = like * share[of]
            part /= part.sum(axis=1, keepdims=True)
            share = np.add.reduceat(part, first, axis=0) / words
        return share, np.add.reduceat(np.log((like * share[of]).sum(axis=1)), first)

    @staticmethod
    def _everything(like, first, of, best, needed):
        """Shares by EM over all languages, and a bound on the log likelihood of any mixture.

        The likelihood is concave in the shares, so at any of them no mixture is better by more than
        words * log(max g), g being the factors by which EM is about to change the shares. A text
        whose bound falls to ``needed`` takes no further rounds.
        """
        n, width = len(first), like.shape[1]
        ends = np.append(first[1:], len(of))
        words = ends - first
        share = np.full((n, width), 0.1 / max(width - 1, 1))
        share[np.arange(n), best] = 0.9
        bound = np.full(n, np.inf)
        rows, now, start, at = np.arange(n), like, first, of
        for _ in range(ROUNDS):
            mix = (now * share[rows][at]).sum(axis=1)
            factor = np.add.reduceat(now / mix[:, None], start, axis=0) / words[rows, None]
            reach = np.add.reduceat(np.log(mix), start) + words[rows] * np.log(factor.max(axis=1))
            bound[rows] = np.minimum(bound[rows], reach)
            share[rows] *= factor
            left = bound[rows] > needed[rows]
            if not left.all():
                now, rows = now[left[at]], rows[left]
                at = np.repeat(np.arange(len(rows)), words[rows])
                start = np.cumsum(words[rows]) - words[rows]
            if not len(rows):
                break
        return share, bound

    @staticmethod
    def _own_gains(like, first, of, mix):
        """What each language would add to the log likelihood next to the mixture ``mix``."""
        ratio = like / mix[:, None]
        words = np.diff(np.append(first, len(of)))[:, None]
        share = np.full((len(first), like.shape[1]), 0.5)
        for _ in range(ROUNDS):
            part = share[of] * ratio
            share = np.add.reduceat(part / (part + 1 - share[of]), first, axis=0) / words
        return np.add.reduceat(np.log(share[of] * ratio + 1 - share[of]), first, axis=0)

    def halfway(self) -> np.ndarray:
        """By language, the log-probability of a triple halfway between what the language's own
        triples have on average, over all learned documents, and a flat model of all triples."""
        own = np.array([float(np.exp(x, dtype=np.float64) @ x) for x in self.log_probability.T])
        return (own - np.log(GRAMS)) / 2

    def infer(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the chosen languages of each text (0 for the others), and the number of words."""
        return self.measure(texts)[:2]

    def measure(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares and words as of ``infer``, and the support of each text: its log likelihood under
        the mixture over that of triples at ``halfway``, below 0 for what no learned language explains.

        The best single language stands where no mixture can pay for a second one. Elsewhere sets
        grow in two ways, in the order of EM over all languages and by the language with the largest
        own gain next to the set so far, both until no larger set can be better; the best set seen
        then loses the languages that do not pay.
        """
        n, width = len(texts), len(self.languages)
        grams, begin, of = word_grams(texts)
        shares = np.zeros((n, width))
        if not len(begin):
            return shares, np.zeros(n, np.int64), np.zeros(n)
        log_like = np.empty((len(begin), width), np.float32)
        for at in range(0, width, 16):
            log_like[:, at:at + 16] = np.add.reduceat(self.log_probability[:, at:at + 16][grams], begin, axis=0)
        words = np.bincount(of, minlength=n)
        alone = np.stack([np.bincount(of, log_like[:, i], n) for i in range(width)], axis=1)
        best = alone.argmax(axis=1)
        shares[np.arange(n), best] = 1.0
        cost = PENALTY * np.log(words + 1)
        top = log_like.max(axis=1)
        floor = np.bincount(of, top, n)
        value = alone[np.arange(n), best] - floor
        triples = np.bincount(of, np.diff(np.append(begin, len(grams))), n)

        def support():
            fit = value + floor + np.maximum((shares > 0).sum(axis=1) - 1, 0) * cost
            return fit - triples * (shares @ halfway)

        halfway = self.halfway()
        rows = np.flatnonzero((words > 0) & (value + cost < 0))
        if width == 1 or not len(rows):
            return shares, words, support()
        keep = np.zeros(n, bool)
        keep[rows] = True
        keep = keep[of]
        like = np.exp(np.maximum(log_like[keep] - top[keep, None], np.float32(-60))).astype(np.float64)

        def part_of(chosen):
            """Words of the texts ``chosen`` (places in ``rows``) with the first word and the text of each."""
            count = words[rows[chosen]]
            start = np.cumsum(count) - count
            return like[ragged(first[chosen], count)], start, np.repeat(np.arange(len(chosen)), count)

        def try_sets(chosen, cols, found=None):
            """Take the sets ``cols`` where they are better than the best so far."""
            part, fit = found or self._mixture(*part_of(chosen), cols)
            at = rows[chosen]
            fit = fit - (cols.shape[1] - 1) * cost[at]
            better = fit > value[at]
            at = at[better]
            shares[at], value[at] = 0.0, fit[better]
            shares[at[:, None], cols[better]] = part[better]
            return better

        first = np.cumsum(words[rows]) - words[rows]
        every = np.arange(len(rows))
        everything, bound = self._everything(*part_of(every), best[rows], (value + cost)[rows])
        bound = np.minimum(bound, 0)
        order = np.argsort(-everything, axis=1, kind="stable")
        for size in range(2, width + 1):
            live = np.flatnonzero(bound - (size - 1) * cost[rows] > value[rows])
            if not len(live):
                break
            try_sets(live, order[live, :size])
        grown, weight = best[rows][:, None], np.ones((len(rows), 1))
        for size in range(2, width + 1):
            live = np.flatnonzero(bound - (size - 1) * cost[rows] > value[rows])
            if not len(live):
                break
            mine, start, at = part_of(live)
            mix = (np.take_along_axis(mine, grown[live][at], axis=1) * weight[live][at]).sum(axis=1)
            gain = self._own_gains(mine, start, at, mix)
            np.put_along_axis(gain, grown[live], -np.inf, axis=1)
            cols = np.concatenate([grown[live], gain.argmax(axis=1)[:, None]], axis=1)
            found = self._mixture(mine, start, at, cols)
            try_sets(live, cols, found)
            # A text that is no longer live never is again: its value only rises, the bound only falls.
            grown, weight = (np.concatenate([x, np.zeros((len(rows), 1), x.dtype)], axis=1) for x in (grown, weight))
            grown[live], weight[live] = cols, found[0]
        sizes = (shares[rows] > 0).sum(axis=1)
        for size in range(sizes.max(), 2, -1):
            live = np.flatnonzero((shares[rows] > 0).sum(axis=1) == size)
            if not len(live):
                continue
            cols = np.flatnonzero(shares[rows[live]] > 0).reshape(len(live), size) % width
            for out in range(size):
                try_sets(live, np.delete(cols, out, axis=1))
        return shares, words, support()


def fit(docs: DataFrame, usable) -> Model:
    """Triple counts by language over all texts that ``usable`` allows.

    ``usable`` is a condition on ``docs``; rows with NULL text or lang are never learned from. The
    model takes 256 KB a language, here and in each worker; counts are held for ``BLOCK`` languages
    at a time.
    """
    ship(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]):
        release_encoders()
        counts: dict[str, np.ndarray] = {}

        def flush():
            for lang, total in counts.items():
                g = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(total[g])], names=["lang", "g", "n"])
            counts.clear()

        for batch in batches:
            langs = batch.column(1)
            for lang in langs.unique().to_pylist():
                if lang not in counts and len(counts) == BLOCK:
                    yield from flush()
                rows = pc.equal(langs, lang)
                total = counts.setdefault(lang, np.zeros(GRAMS, np.int64))
                for part in slices(text_column(batch.column(0).filter(rows)), 2_000_000):
                    total += np.bincount(word_grams(part)[0], minlength=GRAMS)
        yield from flush()

    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull())
    names = sorted(r["lang"] for r in rows.select(F.col("lang").cast("string").alias("lang")).distinct().collect())
    counted = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(
        count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    if len(names) > BLOCK:
        counted = written(counted, "grams")
    log_probability = np.empty((GRAMS, len(names)), np.float32)
    for start in range(0, len(names), BLOCK):
        block = names[start:start + BLOCK]
        found = (counted if len(names) <= BLOCK else counted.where(F.col("lang").between(block[0], block[-1]))).toArrow()
        at = {name: i for i, name in enumerate(block)}
        table = np.full((GRAMS, len(block)), 0.5)
        column = np.array([at[x] for x in found.column("lang").to_pylist()], np.int64)
        table[np.asarray(found.column("g"), np.int64), column] += np.asarray(found.column("n"))
        log_probability[:, start:start + BLOCK] = np.log(table / table.sum(axis=0))
    if len(names) > BLOCK:
        discard(counted)
    return Model(names, log_probability)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the document's columns) with lang_pred, score, languages, shares and support.

    score is the share of lang_pred, the largest; languages and shares list the chosen set, largest
    first; support is that of ``Model.measure``. A text that is NULL or has no letter, and every text of
    a model without languages, is ``und`` with score and support 0 and no languages. Equal shares go to the language first by name. A text
    counts in full, however long. Only ``text`` is read.
    """

    def infer(text):
        texts = text_column(text)
        pred, score, names, shares, support = [], [], [], [], []
        for part in slices(texts, min(1_000_000, CELLS // len(model.languages))):
            share, words, fit = model.measure(part)
            order = np.argsort(-share, axis=1, kind="stable")
            for i, value in enumerate(part.to_pylist()):
                if not words[i] or not LETTER.search(value):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    names.append([])
                    shares.append([])
                    support.append(0.0)
                    continue
                chosen = order[i, :np.count_nonzero(share[i])].tolist()
                pred.append(model.languages[chosen[0]])
                score.append(min(1.0, float(share[i, chosen[0]])))
                names.append([model.languages[j] for j in chosen])
                shares.append([float(share[i, j]) for j in chosen])
                support.append(float(fit[i]))
        return [
            pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())),
            pa.array(shares, pa.list_(pa.float64())), pa.array(support, pa.float64())]

    if not model.languages:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        return docs.select(
            row, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.array().cast("array<string>").alias("languages"), F.array().cast("array<double>").alias("shares"), F.lit(0.0).alias("support"))
    return with_computed(
        docs, [], infer,
        "lang_pred string, score double, languages array<string>, shares array<double>, support double")


def keep_identified(docs: DataFrame, model: Model, least_share: float, least_support: float | None = None) -> DataFrame:
    """The rows of ``docs`` with a language that holds ``least_share`` of the text, with all their columns.

    With ``least_support``, also only those whose support is no lower: 0 asks the learned languages to
    explain a text better than halfway to a flat model, a lower value is a margin for short texts.
    """
    found = identify(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_share))
    if least_support is not None:
        found = found.where(F.col("support") >= least_support)
    return found.select("row.*")
