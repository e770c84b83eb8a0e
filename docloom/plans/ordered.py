"""Rows in an order, from an offset on, at most so many: a top-k, or for deep pages rows lined up in tasks and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Offset and limit together up to which each task holds that many rows and one task merges them.
TOP = 10_000
_TASK = 33  # bits of the place within a task


def keyed(df: DataFrame, keys: list[tuple[Column, bool]]) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with its sort keys (column, descending) as columns, so that none is computed again for each comparison; the order by them; their names."""
    names = [f"_by{i}" for i in range(len(keys))]
    by = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, (_, down) in zip(names, keys, strict=True)]
    return df.select("*", *[k.alias(n) for n, (k, _) in zip(names, keys, strict=True)]), by, names


def ordered(df: DataFrame, keys: list[tuple[Column, bool]], offset: int = 0, limit: int | None = None) -> DataFrame:
    """``df`` in the order of ``keys``, absent and null lowest, without its first ``offset`` rows and at most ``limit`` (None: all).

    A deep page is written in order by range, once; the tasks' counts tell where
    it begins and ends, and only that span is read back.
    """
    rows, by, names = keyed(df, keys)
    if offset + (limit or 0) <= TOP or (limit is None and not offset):
        rows = rows.orderBy(*by)
        rows = rows.offset(offset) if offset else rows
        return (rows if limit is None else rows.limit(limit)).drop(*names)
    lined = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop(*names)
    held = written(lined.withColumn("_at", F.monotonically_increasing_id()))
    counts = [(r["task"], r["count"]) for r in held.groupBy(F.shiftright("_at", _TASK).alias("task")).count().orderBy("task").collect()]

    def at(place: int) -> int:
        """Where the row at a place of the whole order stands; behind all rows if there are fewer."""
        for task, n in counts:
            if place < n:
                return (task << _TASK) + place
            place -= n
        return (1 << 63) - 1

    span = F.col("_at") >= at(offset)
    if limit is not None:
        span = span & (F.col("_at") < at(offset + limit))
    page = held.where(span).orderBy("_at")
    return (page.limit(limit) if limit is not None and limit <= TOP else page).drop("_at")
