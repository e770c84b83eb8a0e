"""From an analysed query to a DataFrame: scan, filter, cursors, distinct, sort, offset and limit, projection.

Lazily evaluated DataFrame operations; sort with limit becomes Spark's top-k,
filters on stored columns reach the scan.  Only a deep page (``ordered``) is lined
up when the query is built.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.paths import parse_field_path, path_key
from ..sources.database import PATH, Collection
from .analyze import analyze
from .filters import compile_filter, typed_literal
from .model import DOCUMENT, ENTITY, KEY, NAME, Order, Plan, Query, Selector
from .ordered import keyed, ordered

_FLOAT = (T.DoubleType, T.FloatType)


def key_columns(order: list[Order], c: Collection, flavour: str) -> list[tuple[Column, bool]]:
    """What an order compares, and whether it descends."""
    return [(k, o.descending) for o in order for k in _compared(o, c, flavour)]


def sort_keys(o: Order, c: Collection, flavour: str) -> list[Column]:
    """Columns that order by ``o``: absent and null lowest, NaN before all numbers, names by path."""
    return [k.desc_nulls_last() if o.descending else k.asc_nulls_first() for k in _compared(o, c, flavour)]


def _compared(o: Order, c: Collection, flavour: str) -> list[Column]:
    if o.field in (NAME, KEY):
        return [path_key(c.path) if c.virtual_ids and flavour == DOCUMENT else c.path]
    if c.dynamic:
        return [c.value(o.field)["key"]]
    col, kind = c.typed(o.field)
    return [F.when(col.isNull(), 0).when(F.isnan(col), 1).otherwise(2), col] if isinstance(kind, _FLOAT) else [col]


def _exists(field: str, c: Collection) -> Column:
    if c.dynamic:
        return c.value(field).isNotNull()
    col, _ = c.typed(field)
    return F.lit(True) if field in c.nulls else col.isNotNull()


def _position(o: Order, c: Collection, value, flavour: str) -> tuple[Column, Column]:
    """(of the row, of the cursor) as structs that compare like the order."""
    if o.field in (NAME, KEY):
        path = value.path if isinstance(value, V.Ref) else value
        if c.virtual_ids and flavour == DOCUMENT:
            return path_key(c.path), path_key(F.lit(path))
        return c.path, F.lit(path)
    if c.dynamic:
        return c.value(o.field)["key"], V.literal(value)["key"]
    col, kind = c.typed(o.field)
    rank = lambda x: F.when(x.isNull(), 0).when(F.isnan(x), 1).otherwise(2) if isinstance(kind, _FLOAT) else F.when(x.isNull(), 0).otherwise(2)
    lit = typed_literal(value, kind).cast(kind)
    return F.struct(rank(col).alias("r"), col.alias("v")), F.struct(rank(lit).alias("r"), lit.alias("v"))


def cursor_predicate(plan: Plan, c: Collection, values: tuple, *, start: bool, before: bool) -> Column:
    """Rows at or behind a start cursor, or at or before an end cursor, as a chain of comparisons."""
    pairs = [(o, *_position(o, c, v, plan.query.flavour)) for o, v in zip(plan.order, values, strict=False)]
    inclusive = before if start else not before
    out = F.lit(False)
    for i, (o, row, at) in enumerate(pairs):
        ties = [r == a for _, r, a in pairs[:i]]
        further = row > at if start != o.descending else row < at
        out = out | reduce(lambda x, y: x & y, [*ties, further])
    if inclusive:
        out = out | reduce(lambda x, y: x & y, [r == a for _, r, a in pairs])
    return F.coalesce(out, F.lit(False))


def filtered(plan: Plan, c: Collection) -> DataFrame:
    """Scan rows of one collection that match filter, existence and cursors."""
    q = plan.query
    df = c.df
    if q.where is not None:
        df = df.where(compile_filter(q.where, c, q.flavour))
    for f in plan.required:
        df = df.where(_exists(f, c))
    if q.start is not None:
        df = df.where(cursor_predicate(plan, c, q.start.values, start=True, before=q.start.before))
    if q.end is not None:
        df = df.where(cursor_predicate(plan, c, q.end.values, start=False, before=q.end.before))
    return df


def first_of_each(df: DataFrame, plan: Plan, c: Collection) -> DataFrame:
    """The first row in the query's order for each combination of the distinct fields."""
    q = plan.query
    by = [c.value(f)["key"] if c.dynamic else c.typed(f)[0] for f in q.distinct_on]
    df, keys, names = keyed(df, key_columns(plan.order, c, q.flavour))
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*keys))).where("_nth = 1").drop("_nth", *names)


def one_selector(plan: Plan, c: Collection) -> DataFrame:
    q = plan.query
    df = filtered(plan, c)
    if q.nearest is not None:
        from ..operators.vector import find_nearest

        return find_nearest(df, q.nearest, c)
    if q.distinct_on:
        df = first_of_each(df, plan, c)
    nothing = q.flavour == ENTITY and q.limit == 0
    limited = q.limit is not None and (q.limit > 0 or nothing)
    if limited or q.offset or q.order:
        df = ordered(df, key_columns(plan.order, c, q.flavour), q.offset, max(q.limit, 0) if limited else None)
    return df


def project(df: DataFrame, q: Query, c: Collection) -> DataFrame:
    """Field masks: dotted paths nest again, unknown ones are absent, the bare name gives paths alone."""
    if q.select is None:
        return df
    if list(q.select) in ([NAME], [KEY]):
        return df.select(PATH)
    if c.dynamic:
        tops = [".".join(parse_field_path(f)) for f in q.select if f not in (NAME, KEY)]
        keep = lambda k, _: F.coalesce(reduce(lambda a, b: a | b, [(k == t) | k.startswith(t + ".") for t in tops]), F.lit(False))
        return df.select(PATH, F.map_filter("fields", keep).alias("fields"))
    tree: dict = {}
    for f in q.select:
        if f not in (NAME, KEY):
            at = tree
            parts = parse_field_path(f)
            for s in parts[:-1]:
                at = at.setdefault(s, {})
                at = at if isinstance(at, dict) else {}
            at[parts[-1]] = None

    def cols(t: dict, prefix: list[str]) -> list[Column]:
        out = []
        for name, sub in t.items():
            col, _ = c.typed(".".join(f"`{s}`" if not s.isidentifier() else s for s in [*prefix, name]))
            out.append((F.struct(*cols(sub, [*prefix, name])) if sub else col).alias(name))
        return out

    known = {k: v for k, v in tree.items() if k in c.df.columns}
    return df.select(PATH, *cols(known, []))


def expand_projection(df: DataFrame, fields: list[str]) -> DataFrame:
    """Entity projection: one row for each element of the first array field (an empty array stays one row)."""
    first = next((f for f in fields if isinstance(df.schema[f].dataType, T.ArrayType)), None)
    if first is None:
        return df.select(*fields)
    return df.select(*[F.explode_outer(f).alias(f) if f == first else F.col(f) for f in fields])


def as_dynamic(df: DataFrame, c: Collection) -> DataFrame:
    """The common form of documents of any collection: path and a map of dynamic values."""
    if c.dynamic:
        return df.select(PATH, "fields")
    each = []
    for f in df.schema.fields:
        if f.name != PATH:
            col = F.col(f"`{f.name}`")
            entry = F.struct(F.lit(f.name).alias("key"), V.lift_any(col, f.dataType).alias("value"))
            each.append(entry if f.name in c.nulls else F.when(col.isNotNull(), entry))
    return df.select(PATH, F.map_from_entries(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("fields"))


def _kindless(db, q: Query, plan: Plan, s: Selector) -> DataFrame:
    """Documents of all collections in one form; ordered and limited as one."""
    inner = replace(plan, query=replace(q, limit=None, offset=0, order=()), order=[])
    every = reduce(lambda a, b: a.unionByName(b), [as_dynamic(one_selector(inner, c), c) for c in db.scans(s, q.parent)])
    whole = Collection("", every, virtual_ids=False)
    if q.limit or q.offset or q.order:
        every = ordered(every, key_columns(plan.order, whole, q.flavour), q.offset, q.limit if q.limit and q.limit > 0 else None)
    return project(every, q, whole)


def build(db, q: Query) -> DataFrame:
    """The rows of a query; order and limit hold for each selector, results follow each other."""
    plan = analyze(q)
    selectors = q.selectors or (Selector("", True),)
    parts = []
    for s in selectors:
        if not s.collection and db.tables:
            if q.flavour == ENTITY:
                continue  # entities always have a kind
            parts.append(_kindless(db, q, plan, s))
            continue
        for c in db.scans(s, q.parent):
            parts.append(project(one_selector(plan, c), q, c))
    if not parts:
        return db.spark.createDataFrame([], f"{PATH} string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def limit_to_last(db, q: Query) -> DataFrame:
    """The last ``limit`` rows in ascending order: reversed order and limit, then sorted forwards."""
    plan = analyze(q)
    back = replace(q, order=tuple(Order(o.field, not o.descending) for o in plan.order))
    (c,) = db.scans(q.selectors[0], q.parent)
    got = build(db, back)
    return ordered(got, key_columns(plan.order, Collection(c.name, got, c.nulls, c.unindexed, c.virtual_ids), q.flavour))
