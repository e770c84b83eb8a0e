"""Search of an operation log: id, name, status and more columns; case-blind substring predicates, order, page."""

from __future__ import annotations

import time as clock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import ordered

LIMIT, MOST = 100, 1000


def search(log: DataFrame, *, contains: dict[str, str] | None = None, equals: dict | None = None, least: dict | None = None, most: dict | None = None, since=None, until=None, time: str = "ts", order: str = "event_id", descending: bool = True, offset: int = 0, limit: int = LIMIT) -> DataFrame:
    """Operations that meet all predicates, newest first by default; a page holds at most 1000."""
    df = log
    for c, text in (contains or {}).items():
        df = df.where(F.lower(F.col(c)).contains(text.lower()))
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == v)
    for c, v in (least or {}).items():
        df = df.where(F.col(c) >= v)
    for c, v in (most or {}).items():
        df = df.where(F.col(c) <= v)
    if since is not None:
        df = df.where(F.col(time) >= F.lit(since))
    if until is not None:
        df = df.where(F.col(time) < F.lit(until))
    return ordered(df, [(F.col(order), descending)], offset, min(limit if limit > 0 else LIMIT, MOST))


def metrics(log: DataFrame, group: str, value: str, failed) -> DataFrame:
    """Counters by operation: calls, failures, mean and largest value."""
    return log.groupBy(group).agg(F.count(F.lit(1)).alias("calls"), F.sum(failed.cast("long")).alias("failures"), F.avg(value).alias("mean_value"), F.max(value).alias("most_value"))


LATEST = 60


def snapshot(log: DataFrame, group: str, value: str, failed, order: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(counters by operation, the latest operations): what a dashboard shows."""
    return metrics(log, group, value, failed), search(log, order=order, limit=LATEST)


def runtime(spark: SparkSession) -> dict[str, int]:
    """Figures of the session: work that is running, executors and their memory."""
    sc = spark.sparkContext
    tracker, jsc = sc.statusTracker(), sc._jsc.sc()
    memory = jsc.getExecutorMemoryStatus()
    return {"active_jobs": len(tracker.getActiveJobsIds()), "active_stages": len(tracker.getActiveStageIds()), "executors": memory.size(), "parallelism": sc.defaultParallelism, "uptime_ms": int(clock.time() * 1000) - jsc.startTime()}
