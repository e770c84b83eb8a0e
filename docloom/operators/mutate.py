"""Mutations as set operations: a batch of writes against the live documents.

Writes are a DataFrame with ``path``, ``op`` (insert, update, upsert, delete),
document columns, and optionally the preconditions ``exists``, ``base_version``
and ``update_time``, a ``mask`` (field paths that the write sets, null for all)
and ``transforms`` of fields.  ``judged`` takes one write for each path,
``fold`` any number, in the order of ``place``.
"""

from __future__ import annotations

import datetime as dt
import itertools
import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Aborted, FailedPrecondition, InvalidArgument, NotFound
from . import transforms as X
from .numbering import numbered

INSERT, UPDATE, UPSERT, DELETE = "insert", "update", "upsert", "delete"


def judged(live: DataFrame, writes: DataFrame) -> DataFrame:
    """Each write with ``status``: OK or the error it would give against the live documents (path, version)."""
    held = live.select("path", F.col("version").alias("_version"))
    met = writes.join(held, "path", "left")
    there = F.col("_version").isNotNull()
    status = F.when((F.col("op") == INSERT) & there, "ALREADY_EXISTS").when((F.col("op") == UPDATE) & ~there, "NOT_FOUND")
    if "exists" in writes.columns:
        status = status.when(F.col("exists").isNotNull() & (F.col("exists") != there), "FAILED_PRECONDITION")
    if "update_time" in writes.columns:
        now = live.select("path", F.col("change_time").alias("_updated"))
        met = met.join(now, "path", "left")
        status = status.when(F.col("update_time").isNotNull() & ~F.col("update_time").eqNullSafe(F.col("_updated")), "FAILED_PRECONDITION")
    if "base_version" in writes.columns:
        status = status.when(F.col("base_version").isNotNull() & (F.col("base_version") != F.coalesce("_version", F.lit(0))), "CONFLICT")
    return met.withColumn("status", status.otherwise("OK")).drop("_updated")


# -- several writes to a path, in order -------------------------------------------------------------------

INCREMENT, MAXIMUM, MINIMUM, APPEND, REMOVE, REQUEST_TIME = "increment", "maximum", "minimum", "append_missing_elements", "remove_all_from_array", "request_time"
ARRAY_KINDS = (APPEND, REMOVE)
#: One transform: a field path, its kind, a number (exact where it is an integer) or the elements as JSON.
TRANSFORM = "struct<field:string,kind:string,whole:bigint,number:double,items:string>"


def masked(old: Column, new: Column, kind: T.DataType, path: str, mask: Column) -> Column:
    """A field behind a write: new where the mask names it or a field above it, field by field where it names some inside, else old."""
    named = F.array_contains(mask, path)
    if not isinstance(kind, T.StructType):
        return F.when(named, new).otherwise(old)
    inside = F.exists(mask, lambda m: m.startswith(path + "."))
    each = [masked(old[f.name], new[f.name], f.dataType, f"{path}.{f.name}", mask).alias(f.name) for f in kind.fields]
    return F.when(named, new).when(inside, F.struct(*each).cast(kind)).otherwise(old)


def transformed(value: Column, kind: T.DataType, path: str, wanted: Column, time: Column) -> Column:
    """A field behind the transforms that name it, in their order; a struct behind those of its fields."""
    if isinstance(kind, T.StructType):
        each = [transformed(value[f.name], f.dataType, f"{path}.{f.name}", wanted, time).alias(f.name) for f in kind.fields]
        return F.when(F.exists(wanted, lambda t: t["field"].startswith(path + ".")), F.struct(*each).cast(kind)).otherwise(value)

    def step(x: Column, t: Column) -> Column:
        out = x
        if isinstance(kind, T.NumericType):
            exact = isinstance(kind, T.IntegralType)
            by = F.coalesce(t["whole"].cast(kind), t["number"].cast(kind)) if exact else F.coalesce(t["number"], t["whole"].cast("double")).cast(kind)
            zero = F.coalesce(x, F.lit(0).cast(kind))
            added = (F.coalesce(x.cast("long"), F.lit(0)) + F.coalesce(t["whole"].cast("double"), t["number"])).cast(kind) if exact else zero + by
            out = F.when(t["kind"] == INCREMENT, F.when(t["whole"].isNotNull(), zero + by).otherwise(added) if exact else added).when(t["kind"] == MAXIMUM, F.greatest(zero, by)).when(t["kind"] == MINIMUM, F.least(zero, by)).otherwise(x)
        elif isinstance(kind, T.ArrayType):
            items = F.from_json(t["items"], kind)
            out = F.when(t["kind"] == APPEND, X.append_missing(x, items)).when(t["kind"] == REMOVE, X.remove_all(x, items)).otherwise(x)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out = F.when(t["kind"] == REQUEST_TIME, time.cast(kind)).otherwise(x)
        return out.cast(kind)

    return F.aggregate(F.filter(wanted, lambda t: t["field"] == path), value, step)


def _names(name: str):
    """Whether a transform is for a top-level field or one inside it."""
    return lambda t: (t["field"] == name) | t["field"].startswith(name + ".")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _leaves(value: Column, kind: T.DataType, path: str) -> list[tuple[str, Column]]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    return [(path, value)]


def fold(live: DataFrame, writes: DataFrame, columns: T.StructType, time=None, *, null_arrays: bool = False) -> DataFrame:
    """What each write does, those to one path one after another in the order of ``place``.

    ``live``: path, version, create_time, change_time and the document columns.
    Gives place, path, op, status, deleted, version, create_time (null: made by
    this write), ``doc`` (the document's columns behind the write), and ``results``: the
    JSON value of each transformed field (null for array transforms where
    ``null_arrays``, as entities have it).  A write that isn't OK changes nothing.
    """
    have = set(writes.columns)
    time = F.lit(time if time is not None else dt.datetime.now(dt.timezone.utc)).cast("timestamp")
    if clash := have & set(columns.fieldNames()) & {"path", "place", "op", "exists", "base_version", "update_time", "mask", "transforms"}:
        raise InvalidArgument(f"document columns named like parts of a write: {sorted(clash)}")
    optional = {"exists": "boolean", "base_version": "long", "update_time": "timestamp", "mask": "array<string>", "transforms": f"array<{TRANSFORM}>"}
    given = [F.col(k).cast(t).alias(k) if k in have else F.lit(None).cast(t).alias(k) for k, t in optional.items()]
    doc = lambda: F.struct(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in columns.fields]).alias("doc")
    asked = writes.select("path", F.struct("place", "op", *given, doc()).alias("w")).groupBy("path").agg(F.collect_list("w").alias("ws"))
    now = live.select("path", F.struct(F.lit(True).alias("alive"), F.col("version").cast("long").alias("version"), F.col("create_time").cast("timestamp").alias("created"), F.col("change_time").cast("timestamp").alias("updated"), doc()).alias("now"))
    kind = columns.simpleString()
    entry = f"struct<place:bigint,op:string,status:string,deleted:boolean,version:bigint,created:timestamp,doc:{kind},results:array<string>>"
    state = f"struct<alive:boolean,version:bigint,created:timestamp,updated:timestamp,doc:{kind},out:array<{entry}>>"
    begin = F.struct(
        F.coalesce(F.col("now.alive"), F.lit(False)), F.coalesce(F.col("now.version"), F.lit(0).cast("long")), F.col("now.created"), F.col("now.updated"), F.col("now.doc"), F.array().cast(f"array<{entry}>")
    ).cast(state)

    def behind(s: Column, w: Column) -> Column:
        """The document behind a write that is no delete."""
        old = lambda n: F.when(s["alive"], s["doc"][n])
        out = []
        for f in columns.fields:
            c = w["doc"][f.name]
            if "mask" in have:
                c = F.when(w["mask"].isNull(), c).otherwise(masked(old(f.name), c, f.dataType, f.name, w["mask"]))
            if "transforms" in have:
                # A transform without a mask or values works on what is stored.
                named = F.coalesce(F.exists(w["transforms"], _names(f.name)), F.lit(False))
                base = F.when(named & c.isNull(), old(f.name)).otherwise(c)
                c = F.when(named, transformed(base, f.dataType, f.name, w["transforms"], time)).otherwise(c)
            out.append(c.cast(f.dataType).alias(f.name))
        return F.struct(*out)

    def results(d: Column, w: Column) -> Column:
        if "transforms" not in have:
            return F.lit(None).cast("array<string>")

        def one(t: Column) -> Column:
            got = F.lit(None).cast("string")
            for path, c in _leaves(d, columns, ""):
                shown = F.get_json_object(F.to_json(F.struct(c.alias("v"))), "$.v")
                got = F.when(t["field"] == path, shown).otherwise(got)
            return F.when(t["kind"].isin(*ARRAY_KINDS), F.lit(None).cast("string")).otherwise(got) if null_arrays else got

        return F.transform(w["transforms"], one)

    def step(s: Column, w: Column) -> Column:
        there, gone = s["alive"], w["op"] == DELETE
        status = F.when((w["op"] == INSERT) & there, "ALREADY_EXISTS").when((w["op"] == UPDATE) & ~there, "NOT_FOUND")
        status = status.when(w["exists"].isNotNull() & (w["exists"] != there), "FAILED_PRECONDITION")
        status = status.when(w["update_time"].isNotNull() & ~(there & s["updated"].eqNullSafe(w["update_time"])), "FAILED_PRECONDITION")
        status = status.when(w["base_version"].isNotNull() & (w["base_version"] != F.when(there, s["version"]).otherwise(F.lit(0))), "CONFLICT").otherwise("OK")
        made = F.struct(status.alias("status"), F.when((status == "OK") & ~gone, behind(s, w).cast(kind)).alias("doc"))

        def done(m: Column) -> Column:
            ok = m["status"] == "OK"
            entry_now = F.struct(w["place"], w["op"], m["status"], gone, s["version"] + ok.cast("long"), F.when(there, s["created"]), m["doc"], F.when(ok & ~gone, results(m["doc"], w))).cast(entry)
            out = F.concat(s["out"], F.array(entry_now))
            # Whatever was written in this commit has no time yet, so that no update_time can match it.
            changed = F.struct(~gone, s["version"] + 1, F.when(there, s["created"]), F.lit(None).cast("timestamp"), m["doc"], out).cast(state)
            return F.when(ok, changed).otherwise(F.struct(s["alive"], s["version"], s["created"], s["updated"], s["doc"], out).cast(state))

        return _let(made, done)

    ordered = F.array_sort("ws", lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
    each = asked.join(now, "path", "left").select("path", F.explode(F.aggregate(ordered, begin, step, lambda s: s["out"])).alias("e"))
    return each.select(F.col("e.place").alias("place"), "path", "e.op", "e.status", "e.deleted", "e.version", F.col("e.created").alias("create_time"), "e.doc", "e.results")


def transforms_column(wanted: list[tuple[str, str, object]]) -> list[tuple] | None:
    """(field, kind, operand) of one write as a value of the ``transforms`` column."""
    import json

    out = []
    for field_path, kind, by in wanted:
        if kind not in (INCREMENT, MAXIMUM, MINIMUM, APPEND, REMOVE, REQUEST_TIME):
            raise InvalidArgument(f"{kind} is no transform")
        whole = by if isinstance(by, int) and not isinstance(by, bool) else None
        out.append((field_path, kind, whole, float(by) if isinstance(by, (int, float)) else None, json.dumps(list(by)) if kind in ARRAY_KINDS else None))
    return out or None


def post_image(live: DataFrame, writes: DataFrame, columns: list[str], mask: list[str] | None = None) -> DataFrame:
    """Documents after the writes: one full outer merge; versions rise, deleted paths go, masked writes keep other columns."""
    w = writes.select("path", "op", *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = live.join(w, "path", "full_outer")
    written = F.col("op").isNotNull()
    kept = both.where(~written | (F.col("op") != DELETE))
    touched = set(columns if mask is None else mask)
    cols = [F.when(written, F.col(f"_new_{c}") if c in touched else F.col(c)).otherwise(F.col(c)).alias(c) for c in columns]
    version = F.when(written, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).cast("long")
    return kept.select("path", *cols, version.alias("version"))


def tombstones(live: DataFrame, deletes: DataFrame, even_absent: bool = True) -> DataFrame:
    """Change rows of deletes; documents leave one for an absent path too, entities do not."""
    gone = deletes.select("path").distinct()
    gone = gone if even_absent else gone.join(live.select("path"), "path", "left_semi")
    return gone.withColumn("deleted", F.lit(True))


def conflicts(read_set: DataFrame, live: DataFrame) -> DataFrame:
    """Paths that a transaction has read (path, version) and that have changed or gone since."""
    now = live.select("path", F.col("version").alias("_now"))
    return read_set.join(now, "path", "left").where(F.col("_now").isNull() | (F.col("_now") > F.col("version"))).select("path", "version", F.col("_now").alias("current_version"))


def allocate_ids(incomplete: DataFrame, base: int, order: list[str], path: str | None = None) -> DataFrame:
    """Gapless ids behind ``base`` in ``order``."""
    return numbered(incomplete, order, base, "id", path)


def complete_keys(keys: DataFrame, key: str, base: int, order: list[str]) -> DataFrame:
    """Keys with ids for those that lack one; complete ones pass through."""
    given = numbered(keys.where(F.col(key).isNull()), order, base, "_new").withColumn(key, F.col("_new").cast(keys.schema[key].dataType))
    return keys.where(F.col(key).isNotNull()).unionByName(given.select(*keys.columns))


def reserve_ids(keys: DataFrame, key: str) -> None:
    """Ids are ranks behind those in use, so a complete key needs no reservation; an incomplete one is an error."""
    if not keys.where(F.col(key).isNull()).isEmpty():
        raise InvalidArgument("an incomplete key can't be reserved")


def auto_id() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return "".join(secrets.choice(alphabet) for _ in range(20))


@dataclass
class Transaction:
    read_only: bool = False
    read_time: dt.datetime | None = None
    reads: DataFrame | None = None


@dataclass
class Transactions:
    """Open transactions on the driver: begin, commit with optimistic checks, roll back once."""

    open: dict[str, Transaction] = field(default_factory=dict)
    _next: itertools.count = field(default_factory=itertools.count)

    def begin(self, read_only: bool = False, read_time: dt.datetime | None = None) -> str:
        if read_time is not None and not read_only:
            raise InvalidArgument("a read time needs a read-only transaction")
        name = f"tx{next(self._next)}"
        self.open[name] = Transaction(read_only, read_time)
        return name

    def get(self, name: str) -> Transaction:
        if name not in self.open:
            raise NotFound(f"transaction {name}")
        return self.open[name]

    def read(self, name: str, rows: DataFrame) -> None:
        t = self.get(name)
        seen = rows.select("path", "version")
        t.reads = seen if t.reads is None else t.reads.unionByName(seen)

    def rollback(self, name: str) -> None:
        self.get(name)
        del self.open[name]

    def check(self, name: str, live: DataFrame, writing: bool) -> None:
        """End a transaction that may commit, or raise; a transaction ends either way."""
        t = self.get(name)
        del self.open[name]
        if writing and t.read_only:
            raise FailedPrecondition("a read-only transaction can't write")
        if t.reads is not None and not conflicts(t.reads, live).isEmpty():
            raise Aborted("what the transaction has read has changed")

    def commit(self, name: str, live: DataFrame, writes: DataFrame | None) -> DataFrame | None:
        """The judged writes of an atomic commit, or an error and no write at all."""
        self.check(name, live, writes is not None)
        return None if writes is None else atomic(live, writes)


def atomic(live: DataFrame, writes: DataFrame) -> DataFrame:
    """All writes or none."""
    out = judged(live, writes)
    bad = out.where("status <> 'OK'").orderBy("path").select("path", "status").first()
    if bad is not None:
        raise Aborted(f"{bad['path']}: {bad['status']}")
    return out
