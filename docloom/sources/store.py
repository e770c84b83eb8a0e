"""A writable collection: a change log, its live view, and commits.

``Store`` is the stateful face of the engine: reads are plans over the log,
writes are folded path by path over the live documents they touch and appended
in one atomic commit, whose number is the one that followed what was read.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, Conflict, EngineError, FailedPrecondition, InvalidArgument, NotFound
from ..functions.paths import check_id
from ..operators import changes, lookup, mutate
from ..operators.numbering import numbered
from ..plans.model import Query
from ..streaming import watch
from .changelog import ChangeLog
from .database import PATH, Database
from .shared import written

_SYSTEM = "seq long, path string, change_time timestamp, deleted boolean, version long, create_time timestamp"
_ERRORS: dict[str, type[EngineError]] = {"ALREADY_EXISTS": AlreadyExists, "NOT_FOUND": NotFound, "FAILED_PRECONDITION": FailedPrecondition, "CONFLICT": Conflict}


@dataclass
class Committed:
    """A commit: the number of the last change before it, and what each write did (place, path, op, status, update_time, version, results)."""

    base: int
    writes: DataFrame


class Store:
    """Documents of one typed collection (``columns`` as a DDL string) kept in a change log at ``root``."""

    def __init__(self, spark: SparkSession, root: str, collection: str, columns: str):
        self.spark, self.collection = spark, collection
        self.columns = T.StructType.fromDDL(columns)
        self.schema = T.StructType([*T.StructType.fromDDL(_SYSTEM).fields, *self.columns.fields])
        self.log = ChangeLog(spark, root)
        self.transactions = mutate.Transactions()

    # -- reads

    def changes(self) -> DataFrame:
        return self.log.read() if self.log.commits() else self.spark.createDataFrame([], self.schema)

    def _recent(self, number: int | None = None) -> DataFrame:
        got = self.log.recent(self.log.next_number() if number is None else number)
        return self.spark.createDataFrame([], self.schema) if got is None else got

    def live(self) -> DataFrame:
        return changes.live(self._recent())

    def snapshot(self) -> None:
        """Keep the latest changes, so that later reads of what is live take only the commits behind them."""
        number = self.log.next_number()
        self.log.snapshot(changes.latest(self._recent(number)), number)

    def as_of(self, time: dt.datetime) -> DataFrame:
        return changes.as_of(self.changes(), time)

    def database(self, read_time: dt.datetime | None = None) -> Database:
        """The live documents, or those of a moment, for queries and aggregates."""
        db = Database(self.spark)
        df = self.live() if read_time is None else self.as_of(read_time)
        db.register(self.collection, df, path=F.col("path"), prefix=self.collection)
        return db

    def query(self, q: Query) -> DataFrame:
        return self.database(q.read_time).query(q)

    def aggregate(self, q: Query, aggregations) -> DataFrame:
        return self.database(q.read_time).aggregate(q, aggregations)

    def get(self, path: str):
        row = self.live().where(F.col("path") == path).first()
        if row is None:
            raise NotFound(path)
        return row

    def batch_get(self, paths: list[str]) -> DataFrame:
        return lookup.batch_get(self.live().withColumnRenamed("path", PATH), lookup.keys_frame(self.spark, paths))

    def list(self, page_size: int = lookup.PAGE, token: str | None = None) -> DataFrame:
        return lookup.list_documents(self.live().withColumnRenamed("path", PATH), page_size, token)

    def current_seq(self) -> int:
        return changes.current_seq(self.changes()).first()["seq"]

    def diff(self, matches: Column, since: int) -> DataFrame:
        return changes.diff(self.changes(), matches, since, self.current_seq())

    def watch(self, matches: dict[str, Column]) -> DataFrame:
        """A streaming DataFrame of events."""
        return watch.watch(self.log.stream(self.schema), matches)

    # -- writes

    def writes(self, rows: list[tuple[str, str, dict]], *, masks: list | None = None, transforms: list | None = None, **conditions) -> DataFrame:
        """Writes from (op, path, values), in order; ``exists``, ``base_version`` and ``update_time`` hold for all.

        ``masks`` and ``transforms`` have an entry for each write: field paths or
        None; a list of (field path, kind, operand) or None.
        """
        for _, path, _ in rows:
            check_id(path.rpartition("/")[2])
        names = self.columns.fieldNames()
        kinds = T.StructType([T.StructField("place", T.LongType()), T.StructField("op", T.StringType()), T.StructField("path", T.StringType()), *self.columns.fields, T.StructField("mask", T.ArrayType(T.StringType())), T.StructField("transforms", T._parse_datatype_string(f"array<{mutate.TRANSFORM}>"))])
        masks, wanted = masks or [None] * len(rows), transforms or [None] * len(rows)
        df = self.spark.createDataFrame([(i, op, path, *(v.get(n) for n in names), m, mutate.transforms_column(x or [])) for i, ((op, path, v), m, x) in enumerate(zip(rows, masks, wanted, strict=True))], kinds)
        df = df if any(m is not None for m in masks) else df.drop("mask")
        df = df if any(wanted) else df.drop("transforms")
        casts = {"exists": "boolean", "base_version": "long", "update_time": "timestamp"}
        for k, v in conditions.items():
            df = df.withColumn(k, F.lit(v).cast(casts[k]))
        return df

    def _folded(self, writes: DataFrame, number: int, time: dt.datetime, mask: list[str] | None) -> tuple[DataFrame, str]:
        """What each write does, as a written table, and its folder."""
        if "place" not in writes.columns:  # one write for each path, in any order
            writes = writes.withColumn("place", F.xxhash64("path"))
        if mask is not None:
            writes = writes.withColumn("mask", F.array(*[F.lit(m) for m in mask]).cast("array<string>"))
        recent = self._recent(number)
        touched = changes.live(recent.join(writes.select("path").distinct(), "path", "left_semi"))
        folder = self.log.staging()
        return written(mutate.fold(touched, writes, self.columns, time), folder), folder

    def _append(self, folded: DataFrame, number: int, time: dt.datetime, gapless: bool = False, batch: tuple[str, int] | None = None) -> Committed:
        """Publish the writes that are OK as commit ``number``: numbered in their order, a millisecond apart and behind all changes before.

        ``gapless``: all writes are OK and their places are 0, 1, 2, ...
        """
        last = self._recent(number).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"), F.max("change_time").alias("time")).first()
        base, begin = last["seq"], time
        if last["time"] is not None:
            begin = max(time, last["time"].astimezone(dt.timezone.utc) + dt.timedelta(milliseconds=1))
        ok, folder = folded.where("status = 'OK'"), self.log.staging()
        try:
            at = F.timestamp_millis(F.lit(int(begin.timestamp() * 1000)) + F.col("seq") - base - 1)
            out = ok.withColumn("seq", F.col("place") + base + 1) if gapless else numbered(ok, ["place", "path"], base, "seq", folder)
            out = out.withColumn("change_time", at).withColumn("create_time", F.coalesce("create_time", at))
            own = set(self.columns.fieldNames())
            self.log.commit(out.select(*[(F.col("doc")[f.name] if f.name in own else F.col(f.name)).cast(f.dataType).alias(f.name) for f in self.schema.fields]), number, batch)
        finally:
            self.log.remove(folder)
        made = self.log.read(number, number).select("path", "version", F.col("change_time").alias("update_time"))
        status = folded.select("place", "path", "op", "status", "results", F.when(F.col("status") == "OK", F.col("version")).alias("version"))
        return Committed(base, status.join(made, ["path", "version"], "left"))

    def commit(self, writes: DataFrame, *, transaction: str | None = None, time: dt.datetime | None = None, mask: list[str] | None = None) -> Committed:
        """All writes in their order or none; a writer that was overtaken by another is aborted."""
        time, number = time or dt.datetime.now(dt.timezone.utc), self.log.next_number()
        if transaction is not None:
            self.transactions.check(transaction, changes.live(self._recent(number)), writing=True)
        folded, folder = self._folded(writes, number, time, mask)
        bad, n, places, least, most = folded.agg(
            F.min_by(F.struct("status", "path"), F.when(F.col("status") != "OK", F.col("place"))), F.count(F.lit(1)), F.count_distinct("place"), F.min("place"), F.max("place")
        ).first()
        if bad is not None:
            self.log.remove(folder)
            raise _ERRORS[bad["status"]](bad["path"])
        return self._append(folded, number, time, gapless=n > 0 and n == places and least == 0 and most == n - 1)

    def batch_write(self, writes: DataFrame, time: dt.datetime | None = None, batch: tuple[str, int] | None = None) -> DataFrame:
        """Each write on its own, in their order: those that can, are made; place, path, op, status, version and update_time of all, as a table."""
        time, number = time or dt.datetime.now(dt.timezone.utc), self.log.next_number()
        folded, _ = self._folded(writes, number, time, None)
        return self._append(folded, number, time, batch=batch).writes

    def end(self, transaction: str) -> None:
        """Commit a transaction that has no writes."""
        self.transactions.check(transaction, self.live(), writing=False)

    def create(self, path: str, values: dict) -> Committed:
        return self.commit(self.writes([(mutate.INSERT, path, values)]))

    def update(self, path: str, values: dict, mask: list[str] | None = None) -> Committed:
        return self.commit(self.writes([(mutate.UPDATE, path, values)]), mask=mask)

    def upsert(self, path: str, values: dict) -> Committed:
        return self.commit(self.writes([(mutate.UPSERT, path, values)]))

    def delete(self, path: str) -> Committed:
        return self.commit(self.writes([(mutate.DELETE, path, {})]))

    def sink(self, batch: DataFrame, batch_id: int, stream: str = "sink") -> None:
        """For ``writeStream.foreachBatch``: one commit for each micro-batch of writes (path, op, columns); a batch that is replayed is left out."""
        last = self.log.last_batch(stream)
        if last is None or batch_id > last:
            self.batch_write(batch, batch=(stream, batch_id))

    def write_stream(self) -> WriteStream:
        return WriteStream(self)


class WriteStream:
    """A stream of write requests: a handshake gives the first token, each request must bring the last one and gets the next."""

    def __init__(self, store: Store):
        self.store, self.stream_id, self.batch = store, uuid.uuid4().hex, 0

    @property
    def token(self) -> str:
        return f"{self.stream_id}:{self.batch}"

    def write(self, token: str, writes: DataFrame | None) -> tuple[str, Committed | None]:
        """The next token and what an atomic commit did (None for a request without writes, which only acknowledges)."""
        if token != self.token:
            raise InvalidArgument("a request must bring the token of the response before it")
        done = None if writes is None else self.store.commit(writes)
        self.batch += writes is not None
        return self.token, done
