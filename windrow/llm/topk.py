"""The exact k largest rows of a large table, found by counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16


def k_th(rows: DataFrame, keys: list[str], k: int) -> list[int] | None:
    """Lower bound, key by key, of the k largest rows in the order of ``keys`` (longs, descending).

    Counts rows by 16 more bits a round, at most 65,536 groups, and follows the group that holds
    the k-th row; it stops as soon as a group ends at k. None when k reaches all rows; rows equal
    in all keys stand or fall together.
    """
    if k >= rows.count():
        return None
    left, bound = k, []
    for c in keys:
        low = -(1 << 63)
        for shift in range(64 - BITS, -1, -BITS):
            here = rows
            for known, value in zip(keys, bound):
                here = here.where(F.col(known) == value)
            if shift + BITS < 64:
                here = here.where(F.shiftright(c, shift + BITS) == (low >> (shift + BITS)))
            groups = here.groupBy(F.shiftright(c, shift).alias("g")).count().collect()
            for r in sorted(groups, key=lambda r: -r["g"]):
                if left <= r["count"]:
                    break
                left -= r["count"]
            low = r["g"] << shift
            if left == r["count"]:
                return [*bound, low]
        bound.append(low)
    return bound


def at_least(keys: list[str], bound: list[int] | None) -> Column:
    """True for rows from the bound of ``k_th`` upward."""
    if bound is None:
        return F.lit(True)
    out = F.lit(True)
    for c, value in reversed(list(zip(keys, bound))):
        out = (F.col(c) > value) | ((F.col(c) == value) & out)
    return out
