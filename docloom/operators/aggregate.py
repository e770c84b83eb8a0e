"""COUNT, SUM and AVG over a query, all in one pass.

Typing rules: a sum of integers is an exact integer (a double if it leaves the
64-bit range), any double makes it a double, NaN spreads, and no number at all
gives integer 0; an average of no numbers is null, and of NaN it is NaN for
documents and null for entities.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..plans.analyze import analyze, required_for
from ..plans.build import _exists, filtered, first_of_each, key_columns
from ..plans.ordered import ordered
from ..plans.model import ENTITY, Avg, Count, Order, Query, Selector, Sum

LONG_MAX = (1 << 63) - 1


def _number(c, field: str) -> tuple[Column, Column]:
    """(double, exact integer) of numeric values; both null for others."""
    if c.dynamic:
        v = c.value(field)
        numeric = v["key"]["rank"] == V.NUMBER
        as_double = F.when(v["key"]["real"] == 0, F.lit(float("nan"))).otherwise(v["key"]["num"])
        return F.when(numeric, as_double), F.when(numeric, v["int"])
    col, kind = c.typed(field)
    if not isinstance(kind, T.NumericType):
        return F.lit(None).cast("double"), F.lit(None).cast("long")
    return col.cast("double"), col.cast("long") if isinstance(kind, T.IntegralType) else F.lit(None).cast("long")


def _wide(i: Column) -> Column:
    return F.sum(i.cast("decimal(38,0)"))


def aggregate(db, q: Query, aggregations) -> DataFrame:
    """One row with a column for each aggregation.

    A sum is long where all inputs are integers by type, double otherwise; for
    dynamic collections ``<alias>`` is double and ``<alias>_int`` the exact
    integer or null.  A sum of 64-bit integers decides its type by its value
    (double if it leaves the range), so such a request runs when it is made and
    its one row comes back.
    """
    required = required_for(aggregations)
    plan = analyze(q)
    fields = [a.field for a in aggregations if isinstance(a, (Sum, Avg))]
    if q.flavour == ENTITY and not q.order and len(set(fields)) == 1 and q.limit:
        q = replace(q, order=(Order(fields[0]),))  # limited entity aggregates take the smallest values
        plan = analyze(q)
    frames = []
    for s in q.selectors or (Selector("", True),):
        for c in db.scans(s, q.parent):
            df = filtered(plan, c)
            for f in required:
                df = df.where(_exists(f, c))
            if q.distinct_on:
                df = first_of_each(df, plan, c)
            if q.limit or q.offset or (q.flavour == ENTITY and q.limit == 0):
                df = ordered(df, key_columns(plan.order, c, q.flavour), q.offset, q.limit if q.limit is not None and (q.limit > 0 or q.flavour == ENTITY) else None)
            ups = [a.up_to for a in aggregations if isinstance(a, Count)]
            if len(ups) == len(aggregations) and all(u is not None for u in ups):
                df = df.limit(max(ups))  # no need to read on
            cols = []
            for i, f in enumerate(dict.fromkeys(fields)):
                d, n = _number(c, f)
                cols += [d.alias(f"d{i}"), n.alias(f"n{i}"), F.lit(not c.dynamic and isinstance(c.typed(f)[1], T.IntegralType)).alias(f"t{i}")]
            frames.append(df.select(*cols, F.lit(1).alias("one")))
    rows = reduce(lambda a, b: a.unionByName(b), frames)
    at = {f: i for i, f in enumerate(dict.fromkeys(fields))}
    dynamic = any(c.dynamic for s in (q.selectors or (Selector("", True),)) for c in db.tables_of(s))
    out, by_value = [], []
    for i, a in enumerate(aggregations):
        alias = a.alias or f"property_{i + 1}"
        if isinstance(a, Count):
            n = F.count(F.lit(1))
            out.append((F.least(n, F.lit(a.up_to).cast("long")) if a.up_to is not None else n).alias(alias))
            continue
        k = at[a.field]
        d, n = F.col(f"d{k}"), F.col(f"n{k}")
        if isinstance(a, Avg):
            mean = F.avg(d)
            out.append((F.nanvl(mean, F.lit(None).cast("double")) if q.flavour == ENTITY else mean).alias(alias))
            continue
        whole = F.coalesce(_wide(n), F.lit(0).cast("decimal(38,0)"))
        fits = (whole <= LONG_MAX) & (whole >= -LONG_MAX - 1)
        only_ints = F.count(d) == F.count(n)
        if dynamic:
            out.append(F.coalesce(F.sum(d), F.lit(0.0)).alias(alias))
            out.append(F.when(only_ints & fits, whole.cast("long")).alias(alias + "_int"))
        elif all(isinstance(c.typed(a.field)[1], T.IntegralType) for s in (q.selectors or ()) for c in db.tables_of(s)):
            if any(isinstance(c.typed(a.field)[1], T.LongType) for s in (q.selectors or ()) for c in db.tables_of(s)):
                by_value.append(alias)
                out += [F.when(fits, whole.try_cast("long")).alias(alias), whole.cast("double").alias(f"_real_{alias}")]
            else:
                out.append(whole.cast("long").alias(alias))
        else:
            out.append(F.coalesce(F.sum(d), F.lit(0.0)).alias(alias))
    result = rows.agg(*out)
    return _typed_by_value(result, by_value) if by_value else result


def _typed_by_value(result: DataFrame, aliases: list[str]) -> DataFrame:
    """The one row of a request, each of these sums as a long, or as a double where it is none."""
    row = result.first().asDict()
    real = {a: row[f"_real_{a}"] for a in aliases if row[a] is None}
    fields = [T.StructField(f.name, T.DoubleType() if f.name in real else f.dataType) for f in result.schema.fields if not f.name.startswith("_real_")]
    return result.sparkSession.createDataFrame([tuple(real.get(f.name, row[f.name]) for f in fields)], T.StructType(fields))
