"""Dynamic values: a tagged form with one total order over all types.

A value is a struct ``key`` (all that order and equality look at), its exact
integer, and its canonical JSON.  Spark orders structs field by field with nulls
first, so a struct that starts with the rank of the type and then has one field
for each kind of payload sorts across types by plain comparison: no UDF.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import path_key

#: Ranks of the types in the total order (fixed values).
NULL, BOOLEAN, NUMBER, TIMESTAMP, STRING, BYTES, REFERENCE, GEO, ARRAY, VECTOR, MAP = range(11)

_LEAF = "rank:int,real:int,num:double,exact:bigint,ts:timestamp,text:string,bin:binary,ref:array<struct<kind:int,number:bigint,text:string>>,lat:double,lng:double"
LEAF = f"struct<{_LEAF}>"
KEY = f"struct<{_LEAF},size:int,items:array<struct<name:string,{_LEAF},json:string>>>"
VALUE = f"struct<key:{KEY},int:bigint,json:string>"
ITEMS = f"array<struct<name:string,{_LEAF},json:string>>"


@dataclass(frozen=True)
class Ref:
    path: str


@dataclass(frozen=True)
class Geo:
    lat: float
    lng: float


@dataclass(frozen=True)
class Vector:
    values: tuple[float, ...]


def rank_of(v: Any) -> int:
    for kinds, rank in (((bool,), BOOLEAN), ((int, float), NUMBER), ((dt.datetime, dt.date), TIMESTAMP), ((str,), STRING), ((bytes, bytearray), BYTES), ((Ref,), REFERENCE), ((Geo,), GEO), ((list, tuple), ARRAY), ((Vector,), VECTOR), ((dict,), MAP)):
        if isinstance(v, kinds):
            return rank
    if v is None:
        return NULL
    raise TypeError(f"{type(v).__name__} is no value type")


def canonical(v: Any) -> str:
    """The wire form of a value, with sorted keys: JSON that tells all types apart."""

    def plain(x):
        r = rank_of(x)
        if r == NUMBER and isinstance(x, float):
            return {"doubleValue": x if math.isfinite(x) else "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"}
        if r == VECTOR:
            return plain({"__type__": "__vector__", "value": [float(y) for y in x.values]})
        tag = {
            NULL: lambda: ("nullValue", None), BOOLEAN: lambda: ("booleanValue", x), NUMBER: lambda: ("integerValue", str(x)), TIMESTAMP: lambda: ("timestampValue", x.isoformat()), STRING: lambda: ("stringValue", x),
            BYTES: lambda: ("bytesValue", base64.b64encode(bytes(x)).decode()), REFERENCE: lambda: ("referenceValue", x.path), GEO: lambda: ("geoPointValue", {"latitude": x.lat, "longitude": x.lng}),
            ARRAY: lambda: ("arrayValue", {"values": [plain(y) for y in x]}), MAP: lambda: ("mapValue", {"fields": {k: plain(x[k]) for k in sorted(x)}}),
        }[r]
        return dict([tag()])

    return json.dumps(plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _exact(c: Column, integer: bool) -> Column:
    """Tells integers apart that are one double (beyond 53 bits); for a double its whole part, so that equal numbers are equal."""
    if integer:
        return c.cast("long")
    inside = (c < F.lit(float(1 << 63))) & (c >= F.lit(-float(1 << 63)))
    return F.when(inside, c.cast("long")).when(c >= 0, F.lit((1 << 63) - 1)).when(c < 0, F.lit(-(1 << 63)))


def _leaf_fields(v: Any, rank: int) -> dict[str, Column]:
    none = {"real": "int", "num": "double", "exact": "bigint", "ts": "timestamp", "text": "string", "bin": "binary", "ref": "array<struct<kind:int,number:bigint,text:string>>", "lat": "double", "lng": "double"}
    got = {k: F.lit(None).cast(t) for k, t in none.items()}
    if rank == BOOLEAN:
        got["real"] = F.lit(int(v))
    elif rank == NUMBER:
        nan = isinstance(v, float) and math.isnan(v)
        got["real"], got["num"] = F.lit(0 if nan else 1), F.lit(0.0 if nan else float(v) + 0.0)
        got["exact"] = got["exact"] if nan else _exact(F.lit(v), isinstance(v, int))
    elif rank == TIMESTAMP:
        got["ts"] = F.lit(v).cast("timestamp")
    elif rank == STRING:
        got["text"] = F.lit(v)
    elif rank == BYTES:
        got["bin"] = F.lit(bytes(v))
    elif rank == REFERENCE:
        got["ref"] = path_key(F.lit(v.path))
    elif rank == GEO:
        got["lat"], got["lng"] = F.lit(float(v.lat)), F.lit(float(v.lng))
    return {"rank": F.lit(rank), **got}


def literal(v: Any) -> Column:
    """A Python value as a dynamic value."""
    rank = rank_of(v)
    items: list[tuple[str, Any]] = []
    if rank == ARRAY:
        items = [("", x) for x in v]
    elif rank == VECTOR:
        items = [("", float(x)) for x in v.values]
    elif rank == MAP:
        items = [(k, v[k]) for k in sorted(v, key=lambda k: k.encode())]
    size = F.lit(len(items) if rank == VECTOR else None).cast("int")
    each = [F.struct(F.lit(n).alias("name"), *[c.alias(k) for k, c in _leaf_fields(x, rank_of(x)).items()], F.lit(canonical(x) if rank_of(x) >= ARRAY else None).cast("string").alias("json")) for n, x in items]
    kind = f"array<struct<name:string,{_LEAF},json:string>>"
    held = (F.array(*each) if each else F.array().cast(kind)) if rank >= ARRAY else F.lit(None).cast(kind)
    key = F.struct(*[c.alias(k) for k, c in _leaf_fields(v, rank).items()], size.alias("size"), held.alias("items"))
    exact = F.lit(v if rank == NUMBER and isinstance(v, int) else None).cast("long")
    return F.struct(key.cast(KEY).alias("key"), exact.alias("int"), F.lit(canonical(v)).alias("json")).cast(VALUE)


def fields(**values: Any) -> Column:
    """A document's fields as a map of dynamic values; nested maps also by dotted name."""
    flat: dict[str, Any] = {}

    def add(prefix: str, x: dict):
        for k, v in x.items():
            flat[prefix + k] = v
            if isinstance(v, dict):
                add(prefix + k + ".", v)

    add("", values)
    if not flat:
        return F.create_map().cast(f"map<string,{VALUE}>")
    return F.create_map(*[c for k, v in flat.items() for c in (F.lit(k), literal(v))])


def lift(c: Column, kind: str) -> Column:
    """A typed column as a dynamic value column (null: explicit null)."""
    rank = {"boolean": BOOLEAN, "bigint": NUMBER, "int": NUMBER, "double": NUMBER, "float": NUMBER, "timestamp": TIMESTAMP, "timestamp_ntz": TIMESTAMP, "string": STRING, "binary": BYTES}[kind]
    got = {k: x for k, x in _leaf_fields(None, NULL).items() if k != "rank"}
    if rank == BOOLEAN:
        got["real"] = c.cast("int")
    elif rank == NUMBER:
        d = c.cast("double")
        got["real"], got["num"] = F.when(F.isnan(d), 0).otherwise(1), F.when(F.isnan(d), 0.0).otherwise(d + F.lit(0.0))
        got["exact"] = F.when(~F.isnan(d), _exact(c, kind in ("bigint", "int")))
    else:
        slot = {TIMESTAMP: "ts", STRING: "text", BYTES: "bin"}[rank]
        got[slot] = c.cast("timestamp") if rank == TIMESTAMP else c
    kind_of_items = f"array<struct<name:string,{_LEAF},json:string>>"
    key = F.struct(F.when(c.isNull(), F.lit(NULL)).otherwise(F.lit(rank)).alias("rank"), *[F.when(c.isNotNull(), x).alias(k) for k, x in got.items()], F.lit(None).cast("int").alias("size"), F.lit(None).cast(kind_of_items).alias("items"))
    exact = c.cast("long") if kind in ("bigint", "int") else F.lit(None).cast("long")
    return F.struct(key.cast(KEY).alias("key"), exact.alias("int"), F.lit(None).cast("string").alias("json")).cast(VALUE)


LEAF_NAMES = [x.split(":")[0] for x in "rank:int,real:int,num:double,exact:bigint,ts,text,bin,ref,lat,lng".split(",")]


def _simple(kind: T.DataType) -> str | None:
    """The name under which ``lift`` knows a scalar type."""
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return "int"
    if isinstance(kind, T.DecimalType):
        return "double"
    if isinstance(kind, T.DateType):
        return "timestamp"
    name = kind.simpleString()
    return name if name in ("boolean", "bigint", "int", "double", "float", "timestamp", "timestamp_ntz", "string", "binary") else None


def lift_any(c: Column, kind: T.DataType) -> Column:
    """A column of any stored type as a dynamic value: arrays and structs one level down, deeper ones as JSON."""
    name = _simple(kind)
    if name is not None:
        return lift(c.cast("double") if isinstance(kind, T.DecimalType) else c, name)

    def item(label: Column, x: Column, inner: T.DataType) -> Column:
        if _simple(inner) is not None:
            key = lift_any(x, inner)["key"]
            leaf = [key[n].alias(n) for n in LEAF_NAMES]
            deep = F.lit(None).cast("string")
        else:
            rank = ARRAY if isinstance(inner, T.ArrayType) else MAP
            empty = {k: v for k, v in _leaf_fields(None, NULL).items() if k != "rank"}
            leaf = [F.when(x.isNull(), NULL).otherwise(rank).alias("rank"), *(v.alias(k) for k, v in empty.items())]
            deep = F.to_json(F.struct(x.alias("v")))
        return F.struct(label.alias("name"), *leaf, deep.alias("json"))

    if isinstance(kind, T.ArrayType):
        rank, items = ARRAY, F.transform(c, lambda x: item(F.lit(""), x, kind.elementType))
    else:
        rank = MAP
        each = [F.when(c[f.name].isNotNull(), item(F.lit(f.name), c[f.name], f.dataType).cast(ITEMS[6:-1])) for f in sorted(kind.fields, key=lambda f: f.name.encode())]
        items = F.filter(F.array(*each), lambda x: x.isNotNull())
    return _held(c, rank, items, F.lit(None).cast("int"))


def lift_vector(c: Column) -> Column:
    """An array of numbers as a vector value."""
    items = F.transform(c.cast("array<double>"), lambda x: F.struct(F.lit("").alias("name"), *[lift(x, "double")["key"][n].alias(n) for n in LEAF_NAMES], F.lit(None).cast("string").alias("json")))
    return _held(c, VECTOR, items, F.size(c))


def _held(c: Column, rank: int, items: Column, size: Column) -> Column:
    none = [F.lit(None).alias(n) for n in LEAF_NAMES if n != "rank"]
    key = F.struct(F.when(c.isNull(), NULL).otherwise(rank).alias("rank"), *none, F.when(c.isNotNull(), size).alias("size"), F.when(c.isNotNull(), items.cast(ITEMS)).alias("items"))
    return F.struct(key.cast(KEY).alias("key"), F.lit(None).cast("long").alias("int"), F.lit(None).cast("string").alias("json")).cast(VALUE)
