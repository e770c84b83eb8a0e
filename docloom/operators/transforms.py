"""Write transforms as Columns over the stored value, for typed columns and for dynamic values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V


def request_time(commit_time) -> Column:
    return F.lit(commit_time)


def increment(c: Column, by) -> Column:
    """Missing counts as 0; integer plus integer stays integer (Spark widens otherwise)."""
    return F.coalesce(c, F.lit(0)) + F.lit(by)


def maximum(c: Column, v) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(v))


def minimum(c: Column, v) -> Column:
    return F.least(F.coalesce(c, F.lit(0)), F.lit(v))


def _array(values) -> Column:
    return values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])


def append_missing(c: Column, values) -> Column:
    """Append what the stored array lacks (a missing one is empty); repeats inside ``values`` are all appended."""
    more = _array(values)
    new = F.filter(more, lambda x: ~F.coalesce(F.array_contains(c, x), F.lit(False)))
    return F.when(c.isNull(), more).otherwise(F.concat(c, new))


def remove_all(c: Column, values) -> Column:
    """Drop every equal element; what is no array stays as it is."""
    gone = _array(values)
    return F.filter(c, lambda x: ~F.coalesce(F.array_contains(gone, x), F.lit(False)))


# -- dynamic values: a stored value of another type than the transform's counts as missing --------------------------------


def _of_number(whole: Column, real: Column) -> Column:
    """An integer value where ``whole`` is not null, else a double."""
    return F.when(whole.isNotNull(), V.lift(whole, "bigint")).otherwise(V.lift(real, "double"))


def _number(v: Column) -> tuple[Column, Column]:
    """(exact integer or null, double) of a value; 0 for what is no number."""
    key = v["key"]
    is_number = F.coalesce(key["rank"] == V.NUMBER, F.lit(False))
    real = F.when(key["real"] == 0, F.lit(float("nan"))).otherwise(key["num"])
    return F.when(is_number, v["int"]).otherwise(F.lit(0).cast("long")), F.when(is_number, real).otherwise(F.lit(0.0))


def increment_value(v: Column, by: int | float) -> Column:
    """Integer plus integer is an integer (a double beyond 64 bits), any double makes it one."""
    whole, real = _number(v)
    exact = F.try_add(whole, F.lit(by).cast("long")) if isinstance(by, int) else F.lit(None).cast("long")
    return _of_number(exact, real + F.lit(float(by)))


def _pick(v: Column, by: int | float, greater: bool) -> Column:
    """The greater (or lesser) of the stored number and ``by``, with its own type; the stored one stays if they are equal."""
    whole, real = _number(v)
    stored, other = _of_number(whole, real), V.literal(by)
    return F.when(other["key"] > stored["key"] if greater else other["key"] < stored["key"], other).otherwise(stored)


def maximum_value(v: Column, by: int | float) -> Column:
    return _pick(v, by, True)


def minimum_value(v: Column, by: int | float) -> Column:
    return _pick(v, by, False)


def _elements(v: Column) -> Column:
    """Elements of an array value; none of another."""
    items = F.when(v["key"]["rank"] == V.ARRAY, v["key"]["items"])
    return F.coalesce(items, F.array().cast(V.ITEMS))


def _array_value(items: Column) -> Column:
    key = V.literal([])["key"].withField("items", items)
    return F.struct(key.cast(V.KEY).alias("key"), F.lit(None).cast("long").alias("int"), F.lit(None).cast("string").alias("json")).cast(V.VALUE)


def append_missing_value(v: Column, values: list) -> Column:
    held, more = _elements(v), V.literal(list(values))["key"]["items"]
    return _array_value(F.concat(held, F.filter(more, lambda x: ~F.exists(held, lambda y: y == x))))


def remove_all_value(v: Column, values: list) -> Column:
    """What is no array stays as it is."""
    gone = V.literal(list(values))["key"]["items"]
    return F.when(v["key"]["rank"] == V.ARRAY, _array_value(F.filter(_elements(v), lambda x: ~F.exists(gone, lambda y: y == x)))).otherwise(v)
