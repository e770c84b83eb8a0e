"""Approximate nearest neighbours by an inverted multi-index (operator 5).

Vectors are cut in two halves, each quantised by its own k-means (fitted on a
bounded sample); a cell is a pair of centroids.  A query walks the cells by
rising sum of the two centroid distances with a heap until the cells hold
enough vectors; the last sum is its reach.  Vectors lie in blocks of about 1024
by first centroid and a salt (so a very common vector spreads over many
blocks); queries that reach a block join it in groups, the block's vectors
within reach are ranked by exact distance in double precision, and the ten best
of every block are merged.

The number of centroids of a half grows with the cube root of the number of
vectors, from ``LEAST_CENTROIDS`` to ``MOST_CENTROIDS``; only centroids and cell counts (at most the
square of that) go to the driver and to every task.  Recall is set by
``probe``, the share of all vectors that a query reranks, at every size alike;
``tests/llm`` measures it against brute force.

Defined cases: vectors that are null, zero, of another length than most (no
distance is defined between lengths), or hold null or non-finite components
take no part, nor do null ids; of rows with one id a query takes one, and none
of them answers it; with fewer candidates than asked all are returned; ties go
to the smaller vec_id; an empty table gives no row; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

NEAREST = 10
EVERY = 100
LEAST_CENTROIDS, MOST_CENTROIDS = 128, 1024
#: Vectors that k-means is fitted on, for each centroid and at least.
SAMPLE_EACH, SAMPLE = 32, 8192
PROBE = 0.45
BLOCK, QUERIES, WALKS = 1024, 256, 64
ASSIGNED = 2048


def centroids_for(n: int) -> int:
    """Centroids of each half for n vectors (fewer where there are fewer vectors): with the cube root of n, between two bounds."""
    return max(LEAST_CENTROIDS, min(MOST_CENTROIDS, int(np.ceil(2 * n ** (1 / 3)))))


def kmeans(data: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    k = max(1, min(k, len(data)))
    rng = np.random.default_rng(seed)
    centre = data[rng.choice(len(data), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = assign(data, centre)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, data[:, d], k) for d in range(data.shape[1])], axis=1)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def assign(data: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; distances of so many rows are held at a time."""
    own, near = (centre * centre).sum(axis=1), np.empty(len(data), np.int64)
    for at in range(0, len(data), ASSIGNED):
        near[at : at + ASSIGNED] = np.argmin(own - 2 * data[at : at + ASSIGNED].astype(np.float64) @ centre.T, axis=1)
    return near


def spans(query: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances from one half of a query to all centroids; the same bits wherever they are computed."""
    gap = centre - query
    return (gap * gap).sum(axis=1)


def reach(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> float:
    """Walk cells by rising first[i] + second[j] until they hold ``wanted`` vectors; the last sum."""
    order1, order2 = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[order1], second[order2]
    heap, met, held, last = [(a[0] + b[0], 0, 0)], {(0, 0)}, 0, 0.0
    while heap and held < wanted:
        last, i, j = heapq.heappop(heap)
        held += int(counts[order1[i], order2[j]])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in met:
                met.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return float(last)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def sound(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>): the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0))
        .where(~bad & F.exists(v, lambda x: x != 0))
    )


def sampled(vectors: DataFrame, n: int, sample: int) -> pa.ChunkedArray:
    """The ``sample`` of n vectors with the least hashes of their ids.

    Of a large table only hashes low enough for twice as many are sorted, so that
    the task that merges the sample reads about as many rows at every size.
    """
    place, share = F.xxhash64("vec_id"), 2 * sample / n

    def least(some: DataFrame) -> pa.Table:
        return some.orderBy(place, "vec_id", "v").limit(sample).select("v").toArrow()

    got = least(vectors.where(place < F.lit(int(share * (1 << 64)) - (1 << 63)))) if share < 1 else None
    if got is None or got.num_rows < sample:  # ids that repeat much
        got = least(vectors)
    return got.column("v")


class Index:
    """Centroids, cell counts, and the blocks of all vectors."""

    def __init__(self, vectors: DataFrame, scratch: Scratch, centroids: int | None = None, sample: int | None = None):
        by_size = vectors.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        self.empty = by_size is None
        if self.empty:
            return
        self.dim = by_size["size"]
        self.half = self.dim // 2
        centroids = centroids or centroids_for(by_size["count"])
        sample = sample or max(SAMPLE, SAMPLE_EACH * centroids)
        vectors = vectors.where(F.size("v") == self.dim)
        some = sampled(vectors, by_size["count"], sample)
        data = np.concatenate([_matrix(c) for c in some.chunks])
        self.centres = [kmeans(part, centroids) for part in (data[:, : self.half], data[:, self.half :])] if self.half else [np.zeros((1, 0)), kmeans(data, centroids)]
        centres, half = self.centres, self.half

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("v"))
                    codes = [assign(p, c) if p.shape[1] else np.zeros(len(x), np.int64) for p, c in zip((x[:, :half], x[:, half:]), centres, strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c.astype(np.int32)) for c in codes)], ["vec_id", "v", "i", "j"])

        self.coded = scratch.keep(vectors.mapInArrow(code, "vec_id long, v array<double>, i int, j int"), "coded")
        self.counts = np.zeros((len(centres[0]), len(centres[1])), np.int64)
        cells = self.coded.groupBy("i", "j").count().toArrow()  # a row per pair of centroids at most
        self.counts[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("count").to_numpy()

    def parts(self) -> list[int]:
        return [max(1, -(-int(n) // BLOCK)) for n in self.counts.sum(axis=1)]


def _reach_batches(index: Index, wanted: int):
    centres, half, counts = index.centres, index.half, index.counts
    rows = counts.sum(axis=1) > 0
    floor2 = counts.sum(axis=0) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lists = [], []
            for q in _matrix(b.column("v")) if b.num_rows else []:
                d1, d2 = spans(q[:half], centres[0]), spans(q[half:], centres[1])
                most = reach(d1, d2, counts, wanted)
                out.append(most)
                lists.append(np.flatnonzero(rows & (d1 + d2[floor2].min() <= most)).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64()), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "v", "most", "rows"])

    return run


def _rank_batches(index: Index, nearest: int):
    centres, half = index.centres, index.half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                i = b.column("i")[k].as_py()
                block, asked = b.column("block")[k].values, b.column("asked")[k].values
                ids, codes = np.asarray(block.field("vec_id")), np.asarray(block.field("j"))
                x = _matrix(block.field("v"))
                out_q, out_v, out_s = [], [], []
                for q_id, q, most in zip(asked.field("vec_id").to_pylist(), _matrix(asked.field("v")), asked.field("most").to_pylist(), strict=True):
                    d1, d2 = spans(q[:half], centres[0]), spans(q[half:], centres[1])
                    near = np.flatnonzero((d1[i] + d2[codes] <= most) & (ids != q_id))
                    gap = x[near] - q
                    score = np.sqrt((gap * gap).sum(axis=1))
                    best = np.lexsort((ids[near], score))[:nearest]
                    out_q.append(np.full(len(best), q_id))
                    out_v.append(ids[near][best])
                    out_s.append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame | None = None, *, every: int = EVERY, nearest: int = NEAREST, centroids: int | None = None, sample: int | None = None, probe: float = PROBE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query (by default the rows whose id ``every`` divides)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    held = sound(vectors)
    index = Index(held, scratch, centroids, sample)
    if index.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = int(index.counts.sum())
    asked = (sound(queries).where(F.size("v") == index.dim) if queries is not None else index.coded.select("vec_id", "v").where(F.col("vec_id") % every == 0)).groupBy("vec_id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
    asked = scratch.keep(asked, "asked")
    n_asked, own = asked.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    # A query's own rows don't answer it, so there must be ``nearest`` beside them.
    wanted = max(nearest + own, int(np.ceil(probe * total)))
    asked = asked.select("vec_id", "v").repartition(max(1, -(-n_asked // WALKS)), "vec_id")
    parts = F.array(*[F.lit(n) for n in index.parts()])
    of_row = F.element_at(parts, F.col("i") + 1)
    groups = F.lit(max(1, -(-n_asked // QUERIES)))
    reached = (
        asked.mapInArrow(_reach_batches(index, wanted), "vec_id long, v array<double>, most double, rows array<int>")
        .withColumn("i", F.explode("rows"))
        .withColumn("crowd", F.pmod(F.xxhash64("vec_id"), groups))
        .groupBy("i", "crowd")
        .agg(F.collect_list(F.struct("vec_id", "v", "most")).alias("asked"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), of_row - 1)))
    )
    blocks = (
        index.coded.withColumn("part", F.pmod(F.xxhash64("vec_id"), of_row).cast("int"))
        .groupBy("i", "part")
        .agg(F.collect_list(F.struct("vec_id", "j", "v")).alias("block"))
    )
    # Spark's estimate doesn't see that a query is copied to every block it reaches, so it would broadcast them all.
    met = blocks.join(reached.hint("merge"), ["i", "part"]).select("i", "block", "asked")
    found = met.mapInArrow(_rank_batches(index, nearest), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
