import random

import numpy as np
import pandas as pd

from windrow.streaming import buffers


def test_many_processes_advance_in_one_call():
    """One call a batch gives what a loop over every process gives."""
    rnd, place, buffer, seen = random.Random(1), None, {}, {}
    for batch in range(4):
        rows = [(rnd.choice("abc"), rnd.randint(0, 300), batch * 1000 + rnd.randint(0, 900), i, rnd.randint(-1, 3)) for i in range(900)]
        frame = pd.DataFrame(rows, columns=["session", "pid", "t", "id", "token"])
        at, end, tokens, after = buffers.advance(place, frame, ["session", "pid"], ["t", "id"], 5, 2, np.array([3]))
        got = {i: (e, tuple(w)) for i, e, w in zip(at["id"], end, tokens)}
        want = {}
        for session, pid, _, i, token in sorted(rows, key=lambda r: (r[2], r[3])):
            key = (session, pid)
            buffer[key], n = [*buffer.get(key, []), token][-5:], seen.get(key, 0)
            if n >= 4 or (token == 3 and n >= 1):
                want[i] = (n, tuple(buffer[key]))
            seen[key] = n + 1
        assert got == want
        place = buffers.unpack(buffers.pack(after.drop(columns="touched")))
        assert {(r.session, r.pid): r.seen for r in place.itertuples()} == seen
        assert all(list(r.tail) == buffer[r.session, r.pid][-4:] for r in place.itertuples())
