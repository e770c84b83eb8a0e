"""Reads of an append-only change log: seq, path, change_time, deleted, and the document's columns.

Latest-change reads are aggregates (``max_by``), which combine on the map side:
a path that changes all the time is one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, *, path: str = "path", seq: str = "seq") -> DataFrame:
    """The last change of each path, tombstones included."""
    rest = [c for c in log.columns if c != path]
    got = log.groupBy(path).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return got.select(path, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def as_of(log: DataFrame, time, **kw) -> DataFrame:
    """Documents alive at ``time``: the latest change up to then, without tombstones."""
    return latest(log.where(F.col("change_time") <= F.lit(time)), **kw).where(~F.col("deleted"))


def point_as_of(log: DataFrame, path: str, time) -> DataFrame:
    return as_of(log.where(F.col("path") == path), time)


def live(log: DataFrame, **kw) -> DataFrame:
    return latest(log, **kw).where(~F.col("deleted"))


def since_seq(log: DataFrame, seq: int) -> DataFrame:
    """The latest change of each path behind ``seq``, with the place of its first change there."""
    rest = [c for c in log.columns if c != "path"]
    got = log.where(F.col("seq") > seq).groupBy("path").agg(F.min("seq").alias("first_seq"), F.max_by(F.struct(*rest), F.col("seq")).alias("_r"))
    return got.select("path", "first_seq", *[F.col(f"_r.`{c}`").alias(c) for c in rest]).orderBy("first_seq")


def point_since_seq(log: DataFrame, path: str, seq: int) -> DataFrame:
    return since_seq(log.where(F.col("path") == path), seq)


def since_time(log: DataFrame, time) -> DataFrame:
    """Latest state, tombstones kept, of paths whose last change is behind ``time``."""
    return latest(log).where(F.col("change_time") > F.lit(time))


def current_seq(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))


def diff(log: DataFrame, matches, from_seq: int, to_seq: int) -> DataFrame:
    """What a watch of ``matches`` (a Column) sends between two positions: CHANGE, REMOVE or DELETE by path.

    One pass over the changes up to ``to_seq``: the state before is the latest
    change up to ``from_seq``, the state after the latest of all.
    """
    rest = [c for c in log.columns if c != "path"]
    row, hit = F.struct(*rest), F.coalesce(matches, F.lit(False)) & ~F.col("deleted")
    old = F.col("seq") <= from_seq
    got = (
        log.where(F.col("seq") <= to_seq)
        .withColumn("_hit", hit)
        .groupBy("path")
        .agg(F.coalesce(F.max_by("_hit", F.when(old, F.col("seq"))), F.lit(False)).alias("_was"), F.max_by("_hit", F.col("seq")).alias("_is"), F.max("seq").alias("_last"), F.max_by(row, F.col("seq")).alias("_r"))
        .where(F.col("_last") > from_seq)
    )
    kind = F.when(F.col("_is"), "CHANGE").when(F.col("_was") & F.col("_r.deleted"), "DELETE").when(F.col("_was"), "REMOVE")
    return got.withColumn("change", kind).where("change is not null").select("path", "change", *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def diff_time(log: DataFrame, matches, since) -> DataFrame:
    """``diff`` between a moment and the end of the log."""
    rest = [c for c in log.columns if c != "path"]
    row, hit = F.struct(*rest), F.coalesce(matches, F.lit(False)) & ~F.col("deleted")
    old = F.col("change_time") <= F.lit(since)
    got = (
        log.withColumn("_hit", hit)
        .groupBy("path")
        .agg(F.coalesce(F.max_by("_hit", F.when(old, F.col("seq"))), F.lit(False)).alias("_was"), F.max_by("_hit", F.col("seq")).alias("_is"), F.max("change_time").alias("_last"), F.max_by(row, F.col("seq")).alias("_r"))
        .where(F.col("_last") > F.lit(since))
    )
    kind = F.when(F.col("_is"), "CHANGE").when(F.col("_was") & F.col("_r.deleted"), "DELETE").when(F.col("_was"), "REMOVE")
    return got.withColumn("change", kind).where("change is not null").select("path", "change", *[F.col(f"_r.`{c}`").alias(c) for c in rest])
