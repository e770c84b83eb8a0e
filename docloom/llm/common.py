"""Shared helpers: scratch tables, word boundaries and 64-bit mixing in numpy."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 19


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a session of one process (a test) that has none gets a folder of this machine; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Rows and bytes of a batch that goes to Python, so that texts of any length take bounded memory on both sides.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches where the session has Spark's defaults."""
    for key, plain, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", None, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if plain is None or spark.conf.get(key, plain) == plain:
            spark.conf.set(key, str(value))


#: Spark's own removal of shuffle files when a query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` frees them early.

    Tables that a result is still read from stay; inside ``freed()`` all that were
    made go when the block ends, as its result has been written by then.
    """

    _open: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        for made in Scratch._open[-1:]:
            made.append(self)
        self.spark, self.root = spark, f"{scratch_dir(spark)}/docloom-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, files: int = 0) -> DataFrame:
        """Write ``df`` once and read it back: later steps restart from the files, not from lineage.

        ``files``: so many of about equal size, for a table too small for a file of each task.
        """
        schema, conf = df.schema, self.spark.conf
        df = df.repartition(files) if files else df
        before = conf.get(CLEANUP, "false")
        # The shuffle files of this write are of no use behind it.
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            p.getFileSystem(conf).delete(p, True)


@contextmanager
def freed() -> Iterator[None]:
    """Remove the tables that are made inside the block when it ends."""
    Scratch._open.append([])
    try:
        yield
    finally:
        for s in Scratch._open.pop():
            s.drop("")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# -- numpy over Arrow string buffers -----------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _table_of_bytes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _table_of_bytes()
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INV = pow(BASE, -1, 1 << 64)


def powers(n: int, base: int, held: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 .. base**n modulo 2**64 (kept between calls, grown by doubling)."""
    got = held.get(base)
    if got is None or len(got) <= n:
        m = 1 << max(12, int(n).bit_length())
        got = np.empty(m, np.uint64)
        got[0], k = 1, 1
        while k < m:
            got[k : 2 * k] = got[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        held[base] = got
    return got


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Hashes of [start, end) from running sums of value * base**position; equal content, equal hash."""
    return mix64((sums[end] - sums[start]) * powers(len(sums), inverse)[start])


def running(values: np.ndarray, base: int) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(values), base)[: len(values)], out=out[1:])
    return out


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most`` bytes; null texts are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(end, n), data[at[first] : at[min(end, n)]], at[first : min(end, n) + 1] - at[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.ones(n + 1, bool)  # edge[i]: a word can't run from i-1 to i
    space = _SPACE[data]
    edge[1:n] = space[:-1]
    edge[offsets[(offsets < n)]] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    stop = np.ones(n, bool)
    stop[:-1] = space[1:]
    inner = offsets[1:-1]
    stop[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(stop & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return span_hashes(running(_BYTES[data], BASE), starts, ends, BASE, BASE_INV)
