"""The JSON wire form of documents: every value is an object with one tag.

``decode`` and ``encode`` are from_json / to_json plans for all types of values;
array elements and the fields of nested maps are decoded one level down, deeper
ones keep their JSON.  ``encode`` writes typed columns, ``encode_fields`` dynamic
documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.paths import path_key

#: One tagged value, parsed once; nested values stay JSON text.
PARSED = (
    "booleanValue string, integerValue string, doubleValue string, timestampValue string, stringValue string, bytesValue string, referenceValue string, "
    "geoPointValue struct<latitude: double, longitude: double>, arrayValue struct<values: array<string>>, mapValue struct<fields: map<string, string>>"
)
VECTOR_MARK = '{"stringValue":"__vector__"}'


def parsed(raw: Column) -> Column:
    """The JSON text of a value beside its parts, so that each text is parsed once."""
    return F.struct(raw.alias("raw"), F.from_json(raw, PARSED).alias("p"))


def _ranked(x: Column) -> Column:
    """A parsed value with its rank and the text of its number."""
    p = x["p"]
    rank = F.lit(V.NULL)
    for tag, r in (("mapValue", V.MAP), ("arrayValue", V.ARRAY), ("geoPointValue", V.GEO), ("referenceValue", V.REFERENCE), ("bytesValue", V.BYTES), ("stringValue", V.STRING), ("timestampValue", V.TIMESTAMP), ("doubleValue", V.NUMBER), ("integerValue", V.NUMBER), ("booleanValue", V.BOOLEAN)):
        rank = F.when(p[tag].isNotNull(), F.lit(r)).otherwise(rank)
    rank = F.when(p["mapValue"]["fields"]["__type__"] == VECTOR_MARK, V.VECTOR).otherwise(rank)
    return F.struct(x["raw"].alias("raw"), p.alias("p"), rank.alias("rank"), F.coalesce(p["integerValue"], p["doubleValue"]).alias("digits"))


def _known(x: Column) -> Column:
    """A ranked value with its number, and the texts of a vector's numbers."""
    n = x["digits"]
    number = F.when(n.isNotNull(), F.when(n == "NaN", 0.0).when(n == "Infinity", F.lit(float("inf"))).when(n == "-Infinity", F.lit(float("-inf"))).otherwise(n.try_cast("double")))
    numbers = F.when(x["rank"] == V.VECTOR, F.from_json(x["p"]["mapValue"]["fields"]["value"], PARSED)["arrayValue"]["values"])
    return F.struct(*[x[k].alias(k) for k in ("raw", "p", "rank", "digits")], number.alias("number"), numbers.alias("numbers"))


#: What is used several times is worked out in a step before: expressions in lambdas are not shared.
STEPS = (parsed, _ranked, _known)


def _leaf(x: Column) -> dict[str, Column]:
    """The fields of a value's key from what is known of it."""
    p, n = x["p"], x["digits"]
    return {
        "rank": x["rank"],
        "real": F.when(p["booleanValue"].isNotNull(), (p["booleanValue"] == "true").cast("int")).when(n.isNotNull(), F.when(n == "NaN", 0).otherwise(1)),
        "num": x["number"],
        "exact": F.when(n.isNotNull(), F.coalesce(p["integerValue"].try_cast("long"), F.when(n != "NaN", V._exact(x["number"], False)))),
        "ts": p["timestampValue"].cast("timestamp"),
        "text": p["stringValue"],
        "bin": F.unbase64(p["bytesValue"]),
        "ref": F.when(p["referenceValue"].isNotNull(), path_key(F.regexp_extract(p["referenceValue"], r"^(?:projects/[^/]+/databases/[^/]+/documents/)?(.*)$", 1))),
        "lat": p["geoPointValue"]["latitude"],
        "lng": p["geoPointValue"]["longitude"],
    }


def _item(name: Column, x: Column) -> Column:
    deep = F.when(x["p"]["arrayValue"].isNotNull() | x["p"]["mapValue"].isNotNull(), x["raw"])
    return F.struct(name.alias("name"), *[c.alias(k) for k, c in _leaf(x).items()], deep.alias("json"))


def _entries(entries: Column, step: Callable[[Column], Column]) -> Column:
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), step(e["value"]).alias("value")))


def _value_of(x: Column) -> Column:
    """What is known of a value (``STEPS``) as a dynamic value."""
    top, p = _leaf(x), x["p"]
    each = lambda texts: F.transform(reduce(F.transform, STEPS, texts), lambda y: _item(F.lit(""), y))
    none = F.array().cast(V.ITEMS)
    entries = F.map_entries(p["mapValue"]["fields"])
    for step in STEPS:
        entries = _entries(entries, step)
    items = (
        F.when(x["rank"] == V.ARRAY, F.coalesce(each(p["arrayValue"]["values"]), none))
        .when(x["rank"] == V.MAP, F.coalesce(F.array_sort(F.transform(entries, lambda e: _item(e["key"], e["value"]))), none))
        .when(x["rank"] == V.VECTOR, F.coalesce(each(x["numbers"]), none))
    )
    key = F.struct(*[c.alias(k) for k, c in top.items()], F.when(x["rank"] == V.VECTOR, F.size(x["numbers"])).alias("size"), items.alias("items"))
    return F.struct(key.alias("key"), p["integerValue"].try_cast("long").alias("int"), x["raw"].alias("json")).cast(V.VALUE)


def value(raw: Column) -> Column:
    """One tagged JSON value as a dynamic value."""
    return F.element_at(F.transform(reduce(F.transform, STEPS, F.array(raw)), _value_of), 1)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in even parts for all cores: a scan is split by bytes and row groups, and the wire form takes far longer than reading."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _values(fields: Column, step: Callable[[Column], Column]) -> Column:
    return F.transform_values(fields, lambda _, x: step(x))


def decode(df: DataFrame, column: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """``name`` and ``fields`` of documents in wire form, one JSON text a row, beside the columns in ``keep``."""
    raw = F.from_json(F.get_json_object(F.col(column), "$.fields"), "map<string,string>")
    fields = F.coalesce(raw, F.create_map().cast("map<string,string>"))
    for step in (*STEPS, _value_of):
        fields = _values(fields, step)
    return df.select(*keep, F.get_json_object(F.col(column), "$.name").alias("name"), fields.alias("fields"))


def _quoted(c: Column) -> Column:
    """A string as JSON text."""
    return F.btrim(F.to_json(F.array(c)), F.lit("[]"))


def _instant(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _tag(name: str, shown: Column) -> Column:
    return F.concat(F.lit('{"' + name + '":'), shown, F.lit("}"))


def _array(each: Column) -> Column:
    return F.concat(F.lit('{"arrayValue":{"values":['), F.concat_ws(",", each), F.lit("]}}"))


def _map(fields: Column) -> Column:
    return F.concat(F.lit('{"mapValue":{"fields":{'), fields, F.lit("}}}"))


def _vector(numbers: Column) -> Column:
    values = _array(F.transform(numbers, lambda x: F.to_json(F.struct(x.alias("doubleValue")))))
    return _map(F.concat(F.lit('"__type__":{"stringValue":"__vector__"},"value":'), values))


def tagged(c: Column, kind: T.DataType, role: str | None = None) -> Column:
    """A typed column as one tagged value; ``role``: reference (a path), geo (a struct of lat and lng) or vector (an array of numbers)."""
    if role == "reference":
        out = _tag("referenceValue", _quoted(c))
    elif role == "geo":
        lat, lng = (c[f.name].cast("double") for f in kind.fields[:2])
        out = _tag("geoPointValue", F.to_json(F.struct(lat.alias("latitude"), lng.alias("longitude"))))
    elif role == "vector":
        out = _vector(c.cast("array<double>"))
    elif isinstance(kind, T.BooleanType):
        out = _tag("booleanValue", c.cast("string"))
    elif isinstance(kind, T.IntegralType):
        out = _tag("integerValue", _quoted(c.cast("string")))
    elif isinstance(kind, T.NumericType):
        out = F.to_json(F.struct(c.cast("double").alias("doubleValue")))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = _tag("timestampValue", _quoted(_instant(c)))
    elif isinstance(kind, T.StringType):
        out = _tag("stringValue", _quoted(c))
    elif isinstance(kind, T.BinaryType):
        out = _tag("bytesValue", _quoted(F.base64(c)))
    elif isinstance(kind, T.ArrayType):
        out = _array(F.transform(c, lambda x: tagged(x, kind.elementType)))
    elif isinstance(kind, T.StructType):
        out = _map(F.concat_ws(",", *[F.when(c[f.name].isNotNull(), F.concat(_quoted(F.lit(f.name)), F.lit(":"), tagged(c[f.name], f.dataType))) for f in kind.fields]))
    else:
        raise TypeError(f"{kind.simpleString()} is no type of values")
    return F.when(c.isNull(), F.lit('{"nullValue":null}')).otherwise(out)


def _document(name: Column, fields: Column) -> Column:
    return F.concat(F.lit('{"name":'), _quoted(name), F.lit(',"fields":{'), fields, F.lit("}}"))


def encode(df: DataFrame, name: Column, columns: list[str], *, roles: dict[str, str] | None = None, nulls: frozenset[str] = frozenset()) -> Column:
    """Typed columns of a DataFrame as a wire document; null columns are left out, but for those in ``nulls``."""
    parts = []
    for c in columns:
        shown = F.concat(_quoted(F.lit(c)), F.lit(":"), tagged(F.col(f"`{c}`"), df.schema[c].dataType, (roles or {}).get(c)))
        parts.append(shown if c in nulls else F.when(F.col(f"`{c}`").isNotNull(), shown))
    return _document(name, F.concat_ws(",", *parts))


def _of_leaf(k: Column) -> Column:
    """The wire form of a leaf of a dynamic value; null for arrays, maps and vectors."""
    number = F.when(k["real"] == 0, F.lit(float("nan"))).otherwise(k["num"])
    path = F.array_join(F.transform(k["ref"], lambda s: F.when(s["kind"] == 0, F.concat(F.lit("__id"), s["number"].cast("string"), F.lit("__"))).otherwise(s["text"])), "/")
    kinds = [
        (V.NULL, F.lit('{"nullValue":null}')), (V.BOOLEAN, _tag("booleanValue", F.when(k["real"] == 1, "true").otherwise("false"))), (V.NUMBER, F.to_json(F.struct(number.alias("doubleValue")))), (V.TIMESTAMP, _tag("timestampValue", _quoted(_instant(k["ts"])))),
        (V.STRING, _tag("stringValue", _quoted(k["text"]))), (V.BYTES, _tag("bytesValue", _quoted(F.base64(k["bin"])))), (V.REFERENCE, _tag("referenceValue", _quoted(path))),
        (V.GEO, _tag("geoPointValue", F.to_json(F.struct(k["lat"].alias("latitude"), k["lng"].alias("longitude"))))),
    ]
    out = F.lit(None).cast("string")
    for rank, shown in kinds:
        out = F.when(k["rank"] == rank, shown).otherwise(out)
    return out


def encode_value(v: Column) -> Column:
    """A dynamic value in wire form: as it came, or from its parts."""
    key = v["key"]
    items = F.transform(key["items"], lambda x: F.coalesce(x["json"], _of_leaf(x)))
    named = F.transform(key["items"], lambda x: F.concat(_quoted(x["name"]), F.lit(":"), F.coalesce(x["json"], _of_leaf(x))))
    numbers = F.transform(key["items"], lambda x: x["num"])
    made = F.when(v["int"].isNotNull(), _tag("integerValue", _quoted(v["int"].cast("string")))).when(key["rank"] == V.ARRAY, _array(items)).when(key["rank"] == V.MAP, _map(F.concat_ws(",", named))).when(key["rank"] == V.VECTOR, _vector(numbers)).otherwise(_of_leaf(key))
    return F.coalesce(v["json"], made)


def encode_fields(name: Column, fields: Column) -> Column:
    """A dynamic document in wire form (fields named by a path of several segments are parts of others)."""
    tops = F.filter(F.map_entries(fields), lambda e: ~F.contains(e["key"], F.lit(".")))
    return _document(name, F.concat_ws(",", F.transform(tops, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), encode_value(e["value"])))))
