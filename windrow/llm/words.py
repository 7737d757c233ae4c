"""Sets of bytes, and hashes and extremes of neighbouring values, in whole arrays."""

from __future__ import annotations

import numpy as np

from windrow.llm.tokens import _Powers, draw_key, scramble

# Text handled at a time; a word takes some twenty numbers while a run of texts is cut.
CUT_BYTES = 2_000_000


def byte_set(*parts) -> np.ndarray:
    """A table of 256 flags; parts are byte values or inclusive pairs of them."""
    table = np.zeros(256, bool)
    for part in parts:
        low, high = part if isinstance(part, tuple) else (part, part)
        table[low:high + 1] = True
    return table


def window_hashes(values: np.ndarray, width: int, key: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring values, by the place of the first."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(scramble(values + draw_key(key)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return scramble((sums[width:] - sums[:-width]) * down[:n])


def sliding(values: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` (minimum or maximum) of every ``width`` neighbouring values, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = fold(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return fold(out[:-rest], out[rest:]) if rest else out
