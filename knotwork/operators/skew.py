"""Many-to-one joins that a hot key cannot slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys can hold more than this share of all rows, and at least so many rows
#: make a key worth splitting.
HOT_KEYS, HOT_ROWS = 1000, 1000


def lookup(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, most: int, how: str = "inner") -> DataFrame:
    """Join of ``rows``, inner or left, with the one row at most that ``table`` has for each key.

    ``count`` is a column of ``table``, dropped here: how many of the ``total`` rows hold the
    key, ``most`` at most. Keys above ``total / HOT_KEYS`` rows are fewer than ``HOT_KEYS``, so
    these few rows of ``table`` are broadcast and their rows stay where they are; all others are
    shuffled.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if most <= limit:
        return rows.join(table.drop(count), on, how)
    hot, rest = table.where(F.col(count) > limit).drop(count), table.where(F.col(count) <= limit).drop(count)
    split = rows.join(F.broadcast(hot), on)
    return split.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how).select(split.columns))
