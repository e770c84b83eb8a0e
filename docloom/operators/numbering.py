"""Gapless numbers in an order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

_IN_TASK = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], base: int, name: str = "id", path: str | None = None) -> DataFrame:
    """``df`` with ``base`` + 1, + 2, ... in ``order``.

    Rows are range-partitioned and sorted, and written with their task and their
    place in it; then each task's rows are numbered behind those of the tasks
    before (one count for each task goes to the driver).
    """
    lined = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(lined.withColumn("_task", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))), path)
    before, offsets = base, {}
    for r in held.groupBy("_task").count().orderBy("_task").collect():
        offsets[r["_task"]], before = before, before + r["count"]
    starts = df.sparkSession.createDataFrame(list(offsets.items()), "_task int, _before long")
    return held.join(F.broadcast(starts), "_task").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_task", "_place", "_before")
