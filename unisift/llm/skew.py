"""Joins in which a single key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in SHARE of the rows, so there are fewer than SHARE hot keys at any size.
SHARE = 1024
#: With no more rows than this a caller may do without: they fit in any task.
PLAIN = 1 << 20


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner", plain: int = 0) -> DataFrame:
    """`rows` joined by `key` ("inner" or "left") with `table`, without its column `count`.

    `table` has each key once, and in `count` how many of the rows have it; `total` is the sum of these counts or more.
    Entries of hot keys, fewer than SHARE, are broadcast, so rows of a hot key stay in the tasks that they're in. All other
    keys meet by a shuffle. With `plain` rows or fewer in all, all keys do; each broadcast costs memory of the driver.
    """
    if total <= plain:
        return rows.join(table.drop(count), key, how)
    hot = F.col(count) * SHARE > total
    few = F.broadcast(table.where(hot).drop(count))
    others = rows.join(few.select(key), key, "left_anti")
    return rows.join(few, key).unionByName(others.join(table.where(~hot).drop(count), key, how))
