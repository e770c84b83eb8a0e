"""Lookups by key and listings of a hierarchy.

Requested keys come as a small DataFrame of a checked size (a request holds at
most ``MOST_KEYS``); beyond it Spark picks the join by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.database import PATH

MOST_KEYS = 1_000
PAGE = 300


def keys_frame(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The request: each path once, with its place."""
    once = list(dict.fromkeys(paths))
    frame = spark.createDataFrame(list(enumerate(once)), f"place long, {PATH} string")
    return F.broadcast(frame) if len(once) <= MOST_KEYS else frame


def batch_get(docs: DataFrame, request: DataFrame) -> DataFrame:
    """Every requested path in order, with ``found`` and the document's columns (null if missing)."""
    hits = docs.join(request.select(PATH), PATH, "left_semi").withColumn("_hit", F.lit(True))
    return request.join(hits, PATH, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def lookup(docs: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found documents, missing paths)."""
    return docs.join(request.select(PATH), PATH, "left_semi"), request.select(PATH).distinct().join(docs.select(PATH), PATH, "left_anti")


def list_documents(docs: DataFrame, page_size: int = PAGE, token: str | None = None) -> DataFrame:
    """A page of documents by path; the token is the last path of the page before."""
    rest = docs if token is None else docs.where(F.col(PATH) > token)
    return rest.orderBy(PATH).limit(page_size)


def next_token(page: DataFrame, page_size: int = PAGE) -> str | None:
    row = page.agg(F.count(F.lit(1)).alias("n"), F.max(PATH).alias("last")).first()
    return row["last"] if row["n"] == page_size else None


def with_missing(live: DataFrame, below: DataFrame, parent: str, collection: str) -> DataFrame:
    """Paths of a collection, and those that exist only as ancestors of other documents."""
    prefix = f"{parent}/{collection}" if parent else collection
    depth = prefix.count("/") + 2
    ancestors = below.where(F.col(PATH).startswith(prefix + "/") & (F.size(F.split(PATH, "/")) > depth)).select(F.array_join(F.slice(F.split(PATH, "/"), 1, depth), "/").alias(PATH)).distinct()
    missing = ancestors.join(live.select(PATH), PATH, "left_anti").withColumn("missing", F.lit(True))
    return live.select(PATH).withColumn("missing", F.lit(False)).unionByName(missing)


def collection_ids(all_docs: DataFrame, parent: str = "") -> DataFrame:
    """Distinct ids of the collections directly below ``parent``."""
    depth = (parent.count("/") + 1 if parent else 0) + 1
    below = all_docs.where(F.col(PATH).startswith(parent + "/")) if parent else all_docs
    return below.select(F.element_at(F.split(PATH, "/"), depth).alias("collection")).distinct().orderBy("collection")


def dereference(docs: DataFrame, field: str, target) -> DataFrame:
    """Documents beside those that a reference field names (a left join; the columns of the target as a struct ``<field>_document``).

    The id in the reference is compared with the target's key column where that
    is known, so that neither side computes paths of all its documents.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in target.df.columns])
    if target.parts is not None and target.prefix is not None:
        key = target.parts[-1][1]
        right = target.df.select(key.cast("string").alias("_id"), columns.alias(f"{field}_document"))
        own = F.substring_index(field, "/", -1)
        inside = F.substring_index(field, "/", target.prefix.count("/") + 1) == target.prefix
        left = docs.withColumn("_id", F.when(inside & (F.size(F.split(field, "/")) == target.prefix.count("/") + 2), own))
        return left.join(right, "_id", "left").drop("_id")
    right = target.df.select(F.col(PATH).alias("_path"), columns.alias(f"{field}_document"))
    return docs.join(right, docs[field] == right["_path"], "left").drop("_path")
