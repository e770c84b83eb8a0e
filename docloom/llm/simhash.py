"""SimHash near-duplicates by tiled exact comparison (operator 2).

Fingerprints are made per document in numpy; equal ones become one class.  The
classes are cut into tiles of one number of set bits each, and a pair of tiles
is skipped when their bit counts differ by more than the radius: such
fingerprints can't link.  The other pairs of tiles are compared in full with
exclusive-or and bit counts.  A tile pair returns a spanning forest of its
links, never all pairs.

All tiles of a corpus would be a quadratic number of pairs, so tiles are also
pruned by agreement: the 64 bits are cut into radius + ``agree`` blocks, two
fingerprints within the radius agree on ``agree`` blocks at least, and only
tiles that agree on a choice of so many blocks (a table and its bucket) are
paired.  Every link is met in one of the tables; the number of blocks is a
parameter and the same at every size.  A bucket of many tiles is spread over
tasks by tile pair.

Components come from alternating star steps over the forest (aggregates and
joins only), with each round written to the shared folder.

Defined cases: a null or empty text has no words and fingerprint zero, which
links like any other; fewer words than a shingle make one shingle; rows with
equal texts, repeated rows included, share a component; a null doc_id takes part
but never names a component that has another id; an empty table gives an empty
result; other columns, whatever their names, are ignored (and kept by
``keep_representatives``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, freed, mix64, running, slices, span_hashes, word_bounds, word_hashes

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 2048
#: Blocks that must agree: 15 tables of 21 bits each for the radius of 4.
AGREE = 2
EDGES_PER_FILE = 1_000_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in more than half of the shingles' hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = (ends[shingle - 1 :] - 1).tolist()
    first = [0, *ends[: len(words) - shingle].tolist()]
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64, len(last))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def tables(radius: int, agree: int) -> list[int]:
    """Bit masks: one per choice of ``agree`` of radius + agree blocks."""
    n = radius + agree
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    return [sum(blocks[i] for i in pick) for pick in combinations(range(n), agree)]


def _grow(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links left-right, by breadth-first search over values not reached yet."""
    waiting, out = [left, left if same else right], []
    while len(waiting[0]):
        seed, waiting[0] = waiting[0][0], waiting[0][1:]
        if same:
            waiting[1] = waiting[0]
        queue = [(seed, 0)]
        while queue:
            x, side = queue.pop()
            other = 0 if same else 1 - side
            near = np.bitwise_count(waiting[other] ^ x) <= radius
            if near.any():
                reached = waiting[other][near]
                waiting[other] = waiting[other][~near]
                queue += [(y, other) for y in reached]
                out += [(int(x), int(y)) for y in reached]
    return out


def compare_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links of a pair of tiles (or within one), thinned to a spanning forest with the same components.

    All pairs are compared with exclusive-or and bit counts, a band of rows at
    a time; only values with a link take part in the search for the forest.
    """
    same = right is None
    other = left if same else right
    busy, met = np.zeros(len(left), bool), np.zeros(len(other), bool)
    rows = max(1, (1 << 18) // max(1, len(other)))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at : at + rows, None] ^ other[None, :]) <= radius
        if same:
            near[np.arange(len(near)), at + np.arange(len(near))] = False
        busy[at : at + rows] = near.any(axis=1)
        met |= near.any(axis=0)
    return _grow(left[busy], other[met], radius, same) if busy.any() else []


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row holds two tiles (the second null: compare within the first)."""
        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                values = lambda c: np.asarray(c.values).view(np.uint64) if c.is_valid else None
                found += compare_tiles(values(x), values(y), radius)
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], ["a", "b"])

    return run


def make_tiles(classes: DataFrame, radius: int = RADIUS, tile: int = TILE, agree: int = AGREE) -> DataFrame:
    """t, bucket, bits, part, fps: the fingerprints (``fp``) of one bit count in each bucket of each table, at most about ``tile`` of them."""
    signed = [m - (1 << 64) if m >> 63 else m for m in tables(radius, agree)]
    keyed = classes.select("fp", F.bit_count("fp").alias("bits"), F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("t", "mask"))
    keyed = keyed.select("fp", "bits", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"))
    counts = keyed.groupBy("t", "bucket", "bits").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(W.partitionBy("t", "bucket"))  # at most 65 rows
    cut = counts.withColumn("size", size).where("size > 1").select("t", "bucket", "bits", F.ceil(F.col("n") / F.lit(tile)).cast("long").alias("parts"))
    placed = keyed.join(cut, ["t", "bucket", "bits"]).withColumn("part", F.pmod(F.xxhash64("fp", "t"), F.col("parts")))
    return placed.groupBy("t", "bucket", "bits", "part").agg(F.collect_list("fp").alias("fps"))


def tile_pairs(tiles: DataFrame) -> DataFrame:
    """Pairs of different tiles of a bucket, each once, with the gap between their bit counts."""
    x, y = tiles.alias("x"), tiles.alias("y")
    gap = F.col("y.bits") - F.col("x.bits")
    ordered = (gap > 0) | ((gap == 0) & (F.col("y.part") > F.col("x.part")))
    met = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.bucket") == F.col("y.bucket")) & ordered)
    return met.select(F.col("x.fps").alias("x"), F.col("y.fps").alias("y"), gap.alias("gap"))


def links(classes: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE, agree: int = AGREE) -> DataFrame:
    """a < b: a forest of links over distinct fingerprints (``fp``) with the components of all links."""
    tiles = scratch.keep(make_tiles(classes, radius, tile, agree), "tiles")
    within = tiles.where("size(fps) > 1").select(F.col("fps").alias("x"), F.lit(None).cast("array<long>").alias("y"))
    across = tile_pairs(tiles).where(F.col("gap") <= radius).select("x", "y")
    pairs = within.unionByName(across).repartition(F.xxhash64("x", "y"))
    return pairs.mapInArrow(_compare(radius), "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, root: the least node of each connected component, for every node of an edge (a, b).

    Alternating star steps: the large star hangs greater neighbours on the least
    one, the small star lesser ones; edges stop changing when every component
    is a star.  Each round is aggregates and joins on nodes, and a written table.
    """
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges0")
    n = edges.count()
    seen = None
    for k in range(1, most_rounds):
        files = max(1, -(-n // EDGES_PER_FILE))
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        # Written tables, so that both sides of the joins are plain shuffles: then the centre of a star is split between tasks.
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), f"least{k}", files)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, f"large{k}", files)
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"low{k}", files)
        met = large.join(low, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.keep(small, f"edges{k}", files)
        scratch.drop(f"edges{k - 1}", f"least{k}", f"large{k}", f"low{k}")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen, n = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, agree: int = AGREE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per document."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs, shingle), "fps")
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    forest = links(classes, scratch, radius, tile, agree)
    stars = components(forest, scratch)
    grouped = classes.join(stars, classes["fp"] == stars["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near-duplicates by similarity: documents whose shingle sets have a Jaccard similarity of at least ``least`` --------
#
# Fingerprints are linked as above, tile by tile, and the documents of a component are checked by their shingle sets.
# At a similarity of 0.8 fingerprints of 64 bits differ in 5 to 14 bits, too many for tables that agree on whole blocks,
# and comparing all tiles of a corpus at such a radius is quadratic.  So documents beyond the radius meet where they share
# a band of minimal shingle hashes.  A group that meets is cut into tiles.  Inside a tile a pair is skipped only if its
# sizes, or the numbers of its hashes in 64 ranges,
# leave no room for an overlap that is large enough; every other pair is checked by its whole shingle sets.  Sets hold
# 32 bits of each shingle's hash: of n shingles of one text and m of another, n * m / 2**32 agree by chance (2e-5 for
# texts of 300 words), which can only decide a pair within that of the limit.

NEAR_SHINGLE, LEAST = 5, 0.8
BINS, BAND_ROWS = 64, 4
NEAR_TILE, NEAR_TILE_BYTES = 2048, 32 << 20
_SHINGLE_BASE = 0xB5297A4D3F84D5B5
_SHINGLE_INV = pow(_SHINGLE_BASE, -1, 1 << 64)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(58)


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted different hashes of the shingles of a word-hash sequence (a short one is one shingle)."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    sums = running(words, _SHINGLE_BASE)
    start = np.arange(max(1, n - shingle + 1))
    return np.unique(span_hashes(sums, start, np.minimum(start + shingle, n), _SHINGLE_BASE, _SHINGLE_INV))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of bands of minimal hashes; an empty bin borrows from the next one that isn't."""
    at = np.searchsorted(hashes, _EDGES) % len(hashes)
    least = hashes[at].reshape(-1, BAND_ROWS)
    key = np.arange(len(least), dtype=np.uint64)
    for c in range(BAND_ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, c])
    return key


def _sign_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = np.frombuffer(_LOWER, np.uint8)
        for b in batches:
            for a, e, data, offsets in slices(b.column("text")):
                starts, ends, first = word_bounds(data, offsets)
                words = word_hashes(lower[data], starts, ends)
                prints, fps, sets, keys = [], [], [], []
                raw, cuts = data.tobytes(), offsets.tolist()
                for x, y, start, end in zip(first[:-1].tolist(), first[1:].tolist(), cuts[:-1], cuts[1:], strict=True):
                    own = words[x:y]
                    fps.append(fingerprint(raw[start:end]))
                    h = shingle_set(own, shingle)
                    prints.append(int(span_hashes(running(own, _SHINGLE_BASE), np.array([0]), np.array([len(own)]), _SHINGLE_BASE, _SHINGLE_INV).view(np.int64)[0]))
                    sets.append((h >> np.uint64(32)).astype(np.uint32).tobytes())
                    keys.append(bands(h).view(np.int64) if len(h) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(a, e - a), b.column("text_hash").slice(a, e - a), pa.array(prints, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "print", "fp", "set", "bands"],
                )

    return run


def link_similar(nodes: np.ndarray, sets: list[np.ndarray], split: int, least: float) -> list[tuple[int, int]]:
    """A forest of verified links: of all pairs (split 0), or of those between the first ``split`` documents and the others."""
    n, out = len(sets), []
    size = np.array([len(s) for s in sets])
    spread = np.array([np.bincount(s >> np.uint32(26), minlength=BINS) for s in sets]).reshape(n, BINS).astype(np.int32)
    side = np.arange(n) < split
    waiting = np.ones(n, bool)
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            ask = waiting & (np.minimum(size, size[x]) >= least * np.maximum(size, size[x]))
            if split:
                ask &= side != side[x]
            near = np.flatnonzero(ask)
            room = np.minimum(spread[near], spread[x]).sum(axis=1)  # at least the size of the overlap
            for y in near[room >= least * (size[near] + size[x] - room)]:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both >= least * (size[x] + size[y] - both):
                    waiting[y] = False
                    queue.append(y)
                    out.append((int(nodes[x]), int(nodes[y])))
    return out


def _similar_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for own, p, q in zip(b.column("members"), b.column("p").to_pylist(), b.column("q").to_pylist(), strict=True):
                v = own.values
                part = np.asarray(v.field("part"))
                order = np.argsort(part != p, kind="stable")
                sets = [np.unique(np.frombuffer(s.as_buffer(), np.uint32)) for s in v.field("set").take(pa.array(order))]
                split = int((part == p).sum()) if p != q else 0
                found += link_similar(np.asarray(v.field("print"))[order], sets, split, least)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    return run


def similar(docs: DataFrame, *, shingle: int = NEAR_SHINGLE, least: float = LEAST, tile: int = NEAR_TILE) -> DataFrame:
    """doc_id, print, component_id: documents linked by a similarity of ``least`` or more (equal word sequences are one class).

    Pairs whose fingerprints link all meet.  One beyond their radius, at 0.8,
    shares one of 16 bands of four minimal hashes with a probability of 0.9998;
    pairs that meet are decided exactly.
    """
    return _grouped(docs, shingle, least, tile).select("doc_id", "print", "component_id")


def _grouped(docs: DataFrame, shingle: int = NEAR_SHINGLE, least: float = LEAST, tile: int = NEAR_TILE) -> DataFrame:
    """The rows of ``similar`` with the hash of the text and the root of the component."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = scratch.keep(rows.mapInArrow(_sign_batches(shingle), "doc_id long, text_hash long, print long, fp long, set binary, bands array<long>"), "signed")
    classes = scratch.keep(signed.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.max(F.octet_length("set")).cast("long").alias("bytes")), "classes")
    # A component of linked fingerprints is one more group whose documents meet.
    tiled = Scratch(docs.sparkSession)
    linked = components(links(classes.select("fp").distinct(), tiled), tiled).select(F.col("node").alias("fp"), "root")
    near = classes.join(linked, "fp", "left").select("print", "bytes", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("band"))
    met = classes.select("print", "bytes", F.explode("bands").alias("band")).union(near)
    # A tile is bounded in rows and in bytes.
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(tile), F.sum("bytes") / F.lit(NEAR_TILE_BYTES))).cast("int")
    sized = met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts")).where("n > 1")
    crowded = met.drop("bytes").join(sized, "band").withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    # The sets of documents that share a band with another, each once; then to every pair of tiles of its bucket.
    needed = scratch.keep(crowded, "crowded")
    sets = signed.join(needed.select("print").distinct(), "print", "left_semi").groupBy("print").agg(F.first("set").alias("set"))
    placed = needed.join(sets, "print").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = placed.groupBy("band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).agg(F.collect_list(F.struct("print", "set", "part")).alias("members"))
    forest = tiles.where("size(members) > 1").select("members", "p", "q").mapInArrow(_similar_batches(least), "a long, b long").distinct()
    stars = components(forest, scratch)
    scratch.drop("crowded")
    grouped = classes.join(stars, classes["print"] == stars["node"], "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("print", "root", "component_id")
    return signed.select("doc_id", "text_hash", "print").join(named, "print").select("doc_id", "text_hash", "print", "root", "component_id")


def keep_representatives(docs: DataFrame, **kw) -> DataFrame:
    """One row of each group of similar ones: the smallest doc_id (a null one last), then the smallest hash of the text.

    Rows that repeat that doc_id and text are one, by the least of their other columns.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    scratch = Scratch(docs.sparkSession)
    with freed():
        best = _grouped(docs, **kw).groupBy("root").agg(F.min(order).alias("b")).select(F.col("b.doc_id").alias("best_id"), F.col("b.text_hash").alias("best_hash"))
        kept = scratch.keep(best, "kept")
    # The documents as one struct, so that no column's name can clash.
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), (F.to_json(F.struct(*rest)) if rest else F.lit("")).alias("least"))
    mine = hashed.join(kept, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("hash") == F.col("best_hash")), "left_semi")
    one = mine.groupBy("id", "hash").agg(F.min_by("row", "least").alias("row"))
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])
