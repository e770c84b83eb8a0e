"""Index definitions, field-index rows, and table statistics."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound
from ..functions import values as V
from ..sources.database import PATH


def parse_index_config(text: str) -> list[dict]:
    """The indexes of a config file: kind, ancestor, and (property, direction) pairs; ids from the definition."""
    out: list[dict] = []
    for line in text.splitlines():
        bare = line.split("#")[0].strip()
        key, _, value = bare.removeprefix("- ").partition(":")
        key, value = key.strip(), value.strip().strip("\"'")
        if key == "kind":
            out.append({"kind": value, "ancestor": False, "properties": []})
        elif key == "ancestor" and out:
            out[-1]["ancestor"] = value.lower() in ("yes", "true")
        elif key == "name" and out:
            out[-1]["properties"].append((value, "asc"))
        elif key == "direction" and out and out[-1]["properties"]:
            out[-1]["properties"][-1] = (out[-1]["properties"][-1][0], value.lower())
    for d in out:
        d["id"] = hashlib.md5(json.dumps([d["kind"], d["ancestor"], d["properties"]], separators=(",", ":")).encode()).hexdigest()[:16]
    return out


def get_index(indexes: list[dict], index_id: str) -> dict:
    """One index by its id."""
    for d in indexes:
        if d["id"] == index_id:
            return d
    raise NotFound(f"index {index_id}")


def index_frame(spark: SparkSession, indexes: list[dict]) -> DataFrame:
    """A row for each index: id, kind, ancestor, and its properties as text."""
    rows = [(d["id"], d["kind"], d["ancestor"], ", ".join(f"{n} {x}" for n, x in d["properties"])) for d in indexes]
    return spark.createDataFrame(rows, "index_id string, kind string, ancestor boolean, properties string")


def field_index(docs: DataFrame) -> DataFrame:
    """Index rows of a dynamic collection: one for each scalar, one for each scalar element of an array, one marker for maps and empty arrays."""
    each = docs.select(PATH, F.explode("fields").alias("field", "value")).select(PATH, "field", F.col("value.key").alias("k"))
    scalar = each.where(~F.col("k.rank").isin(V.ARRAY, V.MAP)).select(PATH, "field", F.lit(False).alias("in_array"), F.col("k.rank").alias("rank"))
    marker = each.where((F.col("k.rank") == V.MAP) | ((F.col("k.rank") == V.ARRAY) & (F.size("k.items") == 0))).select(PATH, "field", F.lit(False).alias("in_array"), F.lit(None).cast("int").alias("rank"))
    element = each.where(F.col("k.rank") == V.ARRAY).select(PATH, "field", F.explode("k.items").alias("x")).where(F.col("x.rank") < V.ARRAY).select(PATH, "field", F.lit(True).alias("in_array"), F.col("x.rank").alias("rank"))
    return scalar.unionByName(marker).unionByName(element)


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts by table."""
    frames = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from."""
    spark = df.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    each = [path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in each)
