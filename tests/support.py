"""Small event logs and plain-Python versions of the operators' rules."""

from __future__ import annotations

import random
from collections import Counter

from windrow.vocabulary import Vocabulary

VOCAB = Vocabulary.of(["a", "b", "c", "d"], ["b", "c"])
TOKENS = ["a", "b", "c", "d", "??"]
SCHEMA = "event_id long, timestamp_ns long, pid long, tid long, uid long, comm string, syscall_name string, session_id int, label int, technique string"


def log(n, seed=0, pids=3, sessions=2, tie_share=0.3, hot_pid=0.5, tokens=TOKENS, step=10):
    """A log with equal times, a busy process, and sessions that share process ids."""
    rnd = random.Random(seed)
    rows, ts = [], 1_700_000_000_000_000_000
    for i in range(n):
        if rnd.random() > tie_share:
            ts += rnd.randint(1, step)
        pid = 1 if rnd.random() < hot_pid else rnd.randint(1, pids)
        label = int(rnd.random() < 0.3)
        technique = rnd.choice(["t1", "t2", "t3", ""]) if label else ""
        rows.append((i, ts, pid, pid * 10 + rnd.randint(0, 2), pid % 3, f"app{pid}", rnd.choice(tokens),
                     1 + (i >= n // 2 and sessions > 1), label, technique))
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def grouped(rows, per_pid):
    """Events of each key in the engine's total order."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        out.setdefault((r[7], r[2]) if per_pid else (r[7],), []).append(r)
    return out


def count_bag(tokens, vocab=VOCAB, ngram=2):
    index = {t: i for i, t in enumerate(vocab.tokens)}
    pairs = {p: len(vocab.tokens) + i for i, p in enumerate(vocab.pairs())}
    bag = Counter(index[t] for t in tokens if t in index)
    if ngram >= 2:
        bag.update(pairs[p] for p in zip(tokens, tokens[1:]) if p in pairs)
    return dict(bag)


def plain_windows(rows, w, s, per_pid=False, ngram=2, phase=0, min_attack=1, frac=0.0):
    """{key + (window_id,): (bag, attack events, label, close time, technique)} by a plain loop."""
    out = {}
    for key, events in grouped(rows, per_pid).items():
        for k, start in enumerate(range(phase, len(events) - w + 1, s)):
            part = events[start:start + w]
            attack = sum(e[8] for e in part)
            named = Counter(e[9] for e in part if e[8] == 1 and e[9])
            out[key + (k,)] = (
                count_bag([e[6] for e in part], ngram=ngram), attack, int(attack >= min_attack and attack >= frac * w),
                part[-1][1], named.most_common(1)[0][0] if named else "unattributed",
            )
    return out


def fold_cooldown(times, cooldown):
    fired = []
    for t in sorted(set(times)):
        if not fired or t - fired[-1] >= cooldown:
            fired.append(t)
    return fired
