"""Exact nearest neighbours: distances as JVM expressions, top-k by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import values as V
from ..plans.model import Nearest
from ..sources.database import PATH

EUCLIDEAN, COSINE, DOT = "euclidean", "cosine", "dot"


def vector_of(c, field: str) -> Column:
    """A vector field as array<double>; null where it is none."""
    if c.dynamic:
        v = c.value(field)["key"]
        return F.when(v["rank"] == V.VECTOR, F.transform(v["items"], lambda x: x["num"]))
    return c.typed(field)[0].cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, query: tuple[float, ...], measure: str) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    if measure == EUCLIDEAN:
        return F.sqrt(F.aggregate(F.zip_with(a, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    if measure == DOT:
        return dot(a, q)
    if measure == COSINE:
        norms = F.sqrt(dot(a, a)) * F.lit(sum(float(x) * float(x) for x in query) ** 0.5)
        similarity = F.least(F.greatest(dot(a, q) / F.nullif(norms, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
        return F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - similarity)
    raise InvalidArgument(f"{measure} is no distance measure")


def find_nearest(df: DataFrame, n: Nearest, c) -> DataFrame:
    """The ``limit`` rows nearest to the query vector; rows without a vector of its size are skipped, ties go by path."""
    near = n.measure == DOT
    with_distance = df.withColumn("_v", vector_of(c, n.field)).where(F.size("_v") == len(n.query)).withColumn("_d", distance(F.col("_v"), n.query, n.measure))
    if n.threshold is not None:
        with_distance = with_distance.where(F.col("_d") >= n.threshold if near else F.col("_d") <= n.threshold)
    top = with_distance.orderBy(F.desc("_d") if near else F.asc("_d"), PATH).limit(n.limit).drop("_v")
    return top.withColumnRenamed("_d", n.result_field) if n.result_field else top.drop("_d")
