"""Filter trees as Columns: one evaluator for both query flavours, over typed and dynamic collections.

Every predicate is two-valued: a missing field never matches (except ``!=`` and
``not-in`` of the entity flavour, which include missing fields), NaN matches no
range, and numbers compare across integer and double.
"""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions import values as V
from ..functions.paths import path_key
from .model import CONTAINS, CONTAINS_ANY, ENTITY, EQ, GE, GT, HAS_ANCESTOR, IN, IS_NAN, IS_NOT_NAN, IS_NOT_NULL, IS_NULL, KEY, LE, LT, NAME, NE, NOT_IN, And, Or, Where

RANGES = {LT: "__lt__", LE: "__le__", GT: "__gt__", GE: "__ge__"}


def _false() -> Column:
    return F.lit(False)


def is_nan(v: Any) -> bool:
    return isinstance(v, float) and math.isnan(v)


def compile_filter(where, source, flavour: str) -> Column:
    """A filter tree over a collection (``docloom.sources.database.Collection``) as one boolean Column."""
    if where is None:
        return F.lit(True)
    if isinstance(where, And):
        return reduce(lambda a, b: a & b, (compile_filter(p, source, flavour) for p in where.parts))
    if isinstance(where, Or):
        return reduce(lambda a, b: a | b, (compile_filter(p, source, flavour) for p in where.parts))
    if where.field in (NAME, KEY):
        return _name(where, source)
    if where.field in source.unindexed:
        return _false()
    return (_dynamic if source.dynamic else _typed)(where, source, flavour)


def _name(w: Where, source) -> Column:
    path = source.path
    if w.op == HAS_ANCESTOR:
        return source.under(w.value, itself=True)
    if w.op in (EQ, IN):
        return source.by_ids([w.value] if w.op == EQ else list(w.value))
    if w.op == NE:
        return path != w.value
    if w.op == NOT_IN:
        return ~path.isin(list(w.value)) if w.value else F.lit(True)
    if w.op in RANGES:
        left, right = (path_key(path), path_key(F.lit(w.value))) if source.virtual_ids else (path, F.lit(w.value))
        return getattr(left, RANGES[w.op])(right)
    raise InvalidArgument(f"{w.op} is no filter on names")


def _fits(kind: T.DataType, v: Any) -> bool:
    """Whether a literal is of the column's class; other classes never match."""
    if isinstance(v, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(v, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(v, str):
        return isinstance(kind, T.StringType)
    if isinstance(v, (bytes, bytearray)):
        return isinstance(kind, T.BinaryType)
    if isinstance(v, (dt.datetime, dt.date)):
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    if isinstance(v, (list, tuple, V.Vector)):
        return isinstance(kind, T.ArrayType)
    if isinstance(v, (dict, V.Geo)):
        return isinstance(kind, T.StructType)
    if isinstance(v, V.Ref):
        return isinstance(kind, T.StringType)
    return False


def typed_literal(v: Any, kind: T.DataType) -> Column:
    if isinstance(v, V.Ref):
        return F.lit(v.path)
    if isinstance(v, V.Vector):
        v = list(v.values)
    if isinstance(v, (list, tuple)):
        return F.array(*[typed_literal(x, kind.elementType) for x in v]).cast(kind)
    if isinstance(v, V.Geo):
        v = dict(zip(kind.fieldNames(), (v.lat, v.lng), strict=True))
    if isinstance(v, dict):
        return F.struct(*[typed_literal(v.get(f.name), f.dataType).alias(f.name) for f in kind.fields]).cast(kind)
    if v is None:
        return F.lit(None).cast(kind)
    if isinstance(v, (dt.datetime, dt.date)):
        return F.lit(v).cast(kind)
    return F.lit(v)


def _equal(c: Column, kind: T.DataType, v: Any) -> Column:
    """Equality of a present, non-null column with a literal; NaN equals NaN."""
    if is_nan(v):
        return F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else _false()
    return c == typed_literal(v, kind) if _fits(kind, v) else _false()


def _present(p: Column) -> Column:
    return F.coalesce(p, _false())


def _typed(w: Where, source, flavour: str) -> Column:
    """Predicates over typed columns.  A null result counts as false in a filter, so it is only replaced below a negation: bare comparisons reach the scan."""
    c, kind = source.typed(w.field)
    entity = flavour == ENTITY
    array = isinstance(kind, T.ArrayType)
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    absent = c.isNull()
    if w.op == IS_NULL or (w.op == EQ and w.value is None):
        return absent if w.field in source.nulls else _false()
    if w.op == IS_NOT_NULL or (w.op == NE and w.value is None):
        return c.isNotNull()
    if w.op == IS_NAN:
        return F.isnan(c) if floating else _false()
    if w.op == IS_NOT_NAN:
        return c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull()

    def equal(v):
        if array and entity and not isinstance(v, (list, tuple)):
            return F.exists(c, lambda x: _present(_equal(x, kind.elementType, v)))
        return _equal(c, kind, v)

    def span(x, k, v):
        if not _fits(k, v) or is_nan(v):
            return _false()
        got = getattr(x, RANGES[w.op])(typed_literal(v, k))
        return got & ~F.isnan(x) if isinstance(k, (T.DoubleType, T.FloatType)) and w.op in (GT, GE) else got

    if w.op == EQ:
        return equal(w.value)
    if w.op == NE:
        return ~_present(equal(w.value)) if entity else c.isNotNull() & ~_present(equal(w.value))
    if w.op in RANGES:
        if array and entity and not isinstance(w.value, (list, tuple)):
            return F.exists(c, lambda x: span(x, kind.elementType, w.value))
        return span(c, kind, w.value)
    if w.op in (IN, NOT_IN):
        plain = [v for v in w.value if _fits(kind, v) and not is_nan(v) and not isinstance(v, (list, tuple, dict, V.Geo, V.Ref, V.Vector))]
        rest = [v for v in w.value if not any(v is p for p in plain) and v is not None]
        terms = ([c.isin(plain)] if plain else []) + [equal(v) for v in rest]
        some = reduce(lambda a, b: a | b, terms) if terms else _false()
        if w.op == IN:
            return some
        some = _present(some)
        if any(v is None for v in w.value):
            return _false()
        return ~some if entity or not w.value else c.isNotNull() & ~some
    if w.op == CONTAINS:
        return F.exists(c, lambda x: _present(_equal(x, kind.elementType, w.value))) if array else _false()
    if w.op == CONTAINS_ANY:
        fit = [v for v in w.value if array and _fits(kind.elementType, v)]
        return F.arrays_overlap(c, F.array(*[typed_literal(v, kind.elementType) for v in fit])) if fit else _false()
    raise InvalidArgument(f"{w.op} is no operator")


_LEAF_NAMES = ["rank", "real", "num", "exact", "ts", "text", "bin", "ref", "lat", "lng"]


def _leaf(x: Column) -> Column:
    return F.struct(*[x[n].alias(n) for n in _LEAF_NAMES], x["json"].alias("json"))


def _leaf_of(v: Any) -> Column:
    k = V.literal(v)["key"]
    return F.struct(*[k[n].alias(n) for n in _LEAF_NAMES], F.lit(V.canonical(v) if V.rank_of(v) >= V.ARRAY else None).cast("string").alias("json"))


def _dynamic(w: Where, source, flavour: str) -> Column:
    value = source.value(w.field)
    key, rank = value["key"], value["key"]["rank"]
    entity = flavour == ENTITY
    if w.op == IS_NULL or (w.op == EQ and w.value is None):
        return _present(rank == V.NULL)
    if w.op == IS_NOT_NULL or (w.op == NE and w.value is None):
        return _present(rank > V.NULL)
    if w.op == IS_NAN:
        return _present((rank == V.NUMBER) & (key["real"] == 0))
    if w.op == IS_NOT_NAN:
        return _present((rank > V.NULL) & ~((rank == V.NUMBER) & (key["real"] == 0)))

    def equal(v):
        same = key == V.literal(v)["key"]
        if entity and not isinstance(v, (list, tuple)):
            return same | ((rank == V.ARRAY) & F.exists(key["items"], lambda x: _leaf(x) == _leaf_of(v)))
        return same

    def span(v):
        if v is None or is_nan(v):
            return _false()
        r, bound = V.rank_of(v), V.literal(v)["key"]
        own = (rank == r) & getattr(key, RANGES[w.op])(bound)
        own = own & (key["real"] == 1) if r == V.NUMBER else own
        if entity and r < V.ARRAY:
            leaf = _leaf_of(v)
            some = F.exists(key["items"], lambda x: (x["rank"] == r) & getattr(_leaf(x), RANGES[w.op])(leaf) & ((x["real"] == 1) if r == V.NUMBER else F.lit(True)))
            own = own | ((rank == V.ARRAY) & some)
        return own

    if w.op == EQ:
        return _present(equal(w.value))
    if w.op == NE:
        return ~_present(equal(w.value)) if entity else _present(rank > V.NULL) & ~_present(equal(w.value))
    if w.op in RANGES:
        return _present(span(w.value))
    if w.op in (IN, NOT_IN):
        terms = [_present(equal(v)) for v in w.value if v is not None]
        some = reduce(lambda a, b: a | b, terms) if terms else _false()
        if w.op == IN:
            return some
        if any(v is None for v in w.value):
            return _false()
        return ~some if entity or not w.value else _present(rank > V.NULL) & ~some
    if w.op in (CONTAINS, CONTAINS_ANY):
        wanted = [w.value] if w.op == CONTAINS else list(w.value)
        held = lambda v: F.exists(key["items"], lambda x: _leaf(x) == _leaf_of(v))
        terms = [held(v) for v in wanted]
        return _present((rank == V.ARRAY) & reduce(lambda a, b: a | b, terms)) if terms else _false()
    raise InvalidArgument(f"{w.op} is no operator")
