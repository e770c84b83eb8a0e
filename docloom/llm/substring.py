"""Substring dedup by recompression (operator 1).

Each document is a sequence of word hashes.  A round first names runs of one
word (round 0), then pairs: every symbol falls left or right by a bit of its
name, and a left symbol followed by a right one becomes a new symbol.  A name is
the hash of its parts, so a substring has the same name in every document and on
every executor, with no dictionary to shuffle: one pass over the texts makes
all rounds.  The last round names every pair of neighbours, overlapping ones
too.  With each symbol goes the span of words its making depended on;
inside any two equal substrings, symbols whose span fits are the same.

A window of 50 words is represented by a symbol whose span lies inside it: one
of the highest round, of these the one with the least hashed name.  The level
and the name are the window's key (a window without such a symbol, within a long
run, has a key of its own).  Consecutive windows with one key form a segment:
(key, content).  Then Spark looks for names that documents share:

1. names met in two documents are found by an aggregate (one row per name and
   task is shuffled, however hot the name is); all other windows are done with,
2. segments with such a name are kept (a sort-merge join that AQE may split),
3. segments of equal content, the expansion around the symbol, go to their
   smallest document; all others repeat,
4. names with segments of different content are compared window by window, with
   one document standing for each content,
5. the repeated spans of each document are removed from its text.

Equality is decided by two independent 64-bit hashes (key and window or
content).  Steps write tables to the shared folder; no step has a cap.

Defined cases: null and empty texts have no words; documents shorter than a
window are unchanged; rows with a null doc_id are neither kept from nor counted
as earlier; rows with the same doc_id don't repeat each other; an empty table
gives an empty result; other columns, whatever their names, are ignored by
``repeats`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix64, running, slices, span_hashes, word_bounds, word_hashes

WINDOW = 50
#: Rounds of pairs before the last one, which names all neighbours.
ROUNDS = 5
#: Rounds whose symbols may represent a window, counted from the last.
LAST_ROUNDS = 4
CHUNK_WORDS = 200_000
CHUNK_BYTES = 4 << 20
#: Windows of one document in a record batch.
BATCH_WINDOWS = 500_000
WORD_BASE = 0xD1342543DE82EF95
WORD_INV = pow(WORD_BASE, -1, 1 << 64)
KEY_BASE = 0xA24BAED4963EE407 | 5
KEY_INV = pow(KEY_BASE, -1, 1 << 64)
_FAR = 1 << 40
_u = np.uint64


def recompress(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, ...]]:
    """The symbols behind each round: name, first word, and the span [left, right) each depends on.

    ``first`` has the index of the first word of each document, and the end.
    """
    n = len(hashes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    name, start, left = hashes, np.arange(n), np.arange(n)
    right = left + 1
    # Runs of one word: a maximal run depends on the words beside it.
    if n:
        fresh = np.ones(n, bool)
        fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(fresh)
        size = np.diff(np.append(at, n))
        opens = first[doc[at]] == at
        closes = first[doc[at] + 1] == at + size
        start, doc = at, doc[at]
        left = np.where(opens, -_FAR, at - 1)
        right = np.where(closes, _FAR, at + size + 1)
        name = np.where(size > 1, mix64(name[at] * _u(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64)), name[at])
    yield name, start, left, right
    for k in range(rounds):
        m = len(name)
        if m:
            more = np.zeros(m, bool)  # the next symbol is of the same document
            more[:-1] = doc[1:] == doc[:-1]
            bit = (mix64(name + _u(k + 1)) >> _u(17) & _u(1)).astype(bool)
            pair = np.zeros(m, bool)
            pair[:-1] = ~bit[:-1] & bit[1:] & more[:-1]
            second = np.zeros(m, bool)
            second[1:] = pair[:-1]
            far_right = np.where(more, np.append(right[1:], 0), _FAR)
            far_left = np.where(np.append(False, more[:-1]), np.append(0, left[:-1]), -_FAR)
            new_left = np.where(bit & ~second, np.minimum(left, far_left), left)  # a right symbol left alone has looked left
            new_right = np.where(~bit, np.maximum(right, far_right), right)
            behind = np.append(name[1:], _u(0))
            joined = mix64(name * _u(0x9E3779B97F4A7C15) + (behind << _u(23) | behind >> _u(41)) + _u(k))
            new_left = np.where(pair, np.minimum(left, np.append(left[1:], 0)), new_left)
            kept = ~second
            name, start, left, right, doc = np.where(pair, joined, name)[kept], start[kept], new_left[kept], new_right[kept], doc[kept]
        yield name, start, left, right
    if len(name):
        more = doc[1:] == doc[:-1]
        both = mix64(name[:-1] * _u(0x9E3779B97F4A7C15) + name[1:])
        name, start, left, right = both[more], start[:-1][more], np.minimum(left[:-1], left[1:])[more], np.maximum(right[:-1], right[1:])[more]
    yield name, start, left, right


def _raise_over(best: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The greatest of ``best`` and of all values whose interval [lo, hi) holds a place; an interval is two of a power of two."""
    power = np.frexp(np.maximum(hi - lo, 1).astype(np.float64))[1] - 1
    above = np.zeros(len(best), np.uint64)
    for k in range(int(power.max(initial=0)), -1, -1):
        own, half = power == k, 1 << k
        np.maximum.at(above, lo[own], value[own])
        np.maximum.at(above, hi[own] - half, value[own])
        if k:  # what holds for 2**k places holds for both halves
            lower = above.copy()
            lower[half // 2 :] = np.maximum(lower[half // 2 :], above[: len(above) - half // 2])
            above = lower
    return np.maximum(best, above)


def window_keys(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The key of the window that starts at each word: round and name of its symbol, 0 where it has none."""
    opens, ends = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    best = np.zeros(len(hashes), np.uint64)
    for k, (name, start, left, right) in enumerate(recompress(hashes, first, rounds)):
        if k <= rounds + 1 - LAST_ROUNDS or not len(name):
            continue
        # The windows of the document that hold the whole span.
        lo, hi = np.maximum(right - window, opens[start]), np.minimum(left, ends[start] - window) + 1
        fits = (left >= 0) & (right < _FAR) & (lo < hi)
        key = _u(k + 1) << _u(58) | mix64(name[fits]) >> _u(6)
        best = _raise_over(best, lo[fits], hi[fits], key)
    return best


def segments(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """key, content, document, first window and number of windows of all segments."""
    n = len(hashes)
    is_window = np.arange(n) + window <= np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(is_window)
    if not len(at):
        e = np.empty(0, np.int64)
        return e, e, e, e, e
    sums = running(hashes, WORD_BASE)
    key = window_keys(hashes, first, window)
    alone = np.flatnonzero(is_window & (key == 0))
    if len(alone):
        key[alone] = span_hashes(running(mix64(hashes + _u(0x51ED270B)), KEY_BASE), alone, alone + window, KEY_BASE, KEY_INV) >> _u(6)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (key[at][1:] != key[at][:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(at)))
    begin = at[head]
    content = span_hashes(sums, begin, begin + count + window - 1, WORD_BASE, WORD_INV)
    return key[begin].view(np.int64), content.view(np.int64), doc[head], begin - first[doc[head]], count


def document_hashes(data: np.ndarray) -> np.ndarray:
    """Word hashes of one document, a bounded number of bytes at a time."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        part = data[at:end]
        starts, ends, _ = word_bounds(part, np.array([0, len(part)]))
        out.append(word_hashes(part, starts, ends))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _long_segments(hashes: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of one long document; a piece sees enough words around its windows to decide as the whole would."""
    n, margin = len(hashes), 2 * window
    for a in range(0, max(0, n - window + 1), CHUNK_WORDS):
        b = min(a + CHUNK_WORDS, n - window + 1)
        lo, hi = max(0, a - margin), min(n, b + window - 1 + margin)
        key, _, _, begin, count = segments(hashes[lo:hi], np.array([0, hi - lo]), window)
        begin = begin + lo
        stop = np.minimum(begin + count, b)
        begin = np.maximum(begin, a)
        kept = stop > begin
        key, begin, count = key[kept], begin[kept], (stop - begin)[kept]
        sums = running(hashes[a : b + window - 1], WORD_BASE)
        content = span_hashes(sums, begin - a, begin - a + count + window - 1, WORD_BASE, WORD_INV)
        yield key, content.view(np.int64), np.zeros(len(key), np.int64), begin, count


def _segment_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column(0), batch.column(1)
            for a, _, data, offsets in slices(batch.column(2)):
                if len(data) > CHUNK_BYTES:
                    found = _long_segments(document_hashes(data), window)
                else:
                    starts, ends, first = word_bounds(data, offsets)
                    found = [segments(word_hashes(data, starts, ends), first, window)]
                for key, content, doc, begin, count in found:
                    rows = pa.array(doc + a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(content), ids.take(rows), prints.take(rows), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))],
                        ["key", "content", "doc_id", "print", "begin", "n"],
                    )

    return run


def _window_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text, list of (key, content, begin, n, owner) -> a row per window of those segments."""
        for batch in batches:
            for text, asked in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                hashes = document_hashes(np.frombuffer(text.as_buffer(), np.uint8))
                sums = running(hashes, WORD_BASE)
                out, held = [], 0
                for s in asked:
                    if held + s["n"] > BATCH_WINDOWS and out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "content", "x", "hash", "owner"])
                        out, held = [], 0
                    held += s["n"]
                    at = np.arange(s["begin"], s["begin"] + s["n"])
                    out.append((np.full(len(at), s["key"]), np.full(len(at), s["content"]), np.arange(len(at), dtype=np.int32), span_hashes(sums, at, at + window, WORD_BASE, WORD_INV).view(np.int64), np.full(len(at), s["owner"])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "content", "x", "hash", "owner"])

    return run


def repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """doc_id, print, spans: for documents with repeats, the word ranges [begin, end) to remove."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text").where("doc_id is not null and text is not null")
    fields = "key long, content long, doc_id long, print long, begin int, n int"
    every = scratch.keep(texts.mapInArrow(_segment_batches(window), fields), "segments")
    met = every.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("content").alias("c0"), F.max("content").alias("c1"))
    # A written table, so that both sides of the join are plain shuffles: then a hot key is split between tasks.
    shared = scratch.keep(met.where("low < high").select("key", (F.col("c0") != F.col("c1")).alias("mixed")), "shared")
    held = scratch.keep(every.join(shared, "key"), "held")
    scratch.drop("segments")
    classes = scratch.keep(
        held.groupBy("key", "content", "n", "mixed").agg(F.min("doc_id").alias("owner"), F.min(F.struct("doc_id", "print", "begin")).alias("one")), "classes"
    )
    # Windows of keys that have several contents, one document standing for each content.
    asked = (
        classes.where("mixed")
        .select(F.col("one.doc_id").alias("doc_id"), F.col("one.print").alias("print"), F.struct("key", "content", F.col("one.begin").alias("begin"), "n", "owner").alias("s"))
        .groupBy("doc_id", "print")
        .agg(F.collect_list("s").alias("asked"))
    )
    windows = scratch.keep(texts.join(asked, ["doc_id", "print"]).select("text", "asked").mapInArrow(_window_batches(window), "key long, content long, x int, hash long, owner long"), "windows")
    owners = scratch.keep(windows.groupBy("key", "hash").agg(F.min("owner").alias("first_owner"), F.max("owner").alias("last_owner")).where("first_owner < last_owner"), "owners")
    later = (
        windows.join(owners, ["key", "hash"])
        .where("owner > first_owner")
        .groupBy("key", "content")
        .agg(F.collect_set("x").alias("xs"))
    )
    marked = held.join(classes.select("key", "content", "owner"), ["key", "content"])
    whole = marked.where("doc_id > owner").select("doc_id", "print", "begin", (F.col("begin") + F.col("n") + (window - 1)).alias("end"))
    first = marked.where("doc_id = owner").join(later, ["key", "content"]).select("doc_id", "print", "begin", F.explode("xs").alias("x"))
    parts = first.select("doc_id", "print", (F.col("begin") + F.col("x")).alias("begin"), (F.col("begin") + F.col("x") + window).alias("end"))
    spans = scratch.keep(whole.union(parts).groupBy("doc_id", "print").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    scratch.drop("shared", "held", "classes", "windows", "owners")
    return spans


def _kept(n: int, spans: pa.Scalar) -> np.ndarray | None:
    """Which of n words stay; None if all do."""
    if not spans.is_valid:
        return None
    both = spans.values.flatten()
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray(both[0]), 1)
    np.add.at(edge, np.asarray(both[1]), -1)
    return np.cumsum(edge[:n]) == 0


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digest = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            kept = _kept(len(words), spans)
            stay = words if kept is None else [words[i] for i in np.flatnonzero(kept)]
            total.append(len(words))
            removed.append(len(words) - len(stay))
            digest.append(hashlib.sha256(b" ".join(stay)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """row (all columns of a document), spans."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"))
    return held.join(spans.select(F.col("doc_id").alias("id"), "print", "spans"), ["id", "print"], "left").select("row", "spans")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    spans = repeats(docs, Scratch(docs.sparkSession), window)
    return _with_spans(docs.select(F.col("doc_id").cast("long"), "text"), spans).select("row.doc_id", "row.text", "spans").mapInArrow(_digest_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: bytes, spans: pa.Scalar) -> bytes:
    """The text without the words of the spans and the white space behind them; the rest as it was."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    kept = _kept(len(starts), spans)
    if kept is None or kept.all():
        return text
    stop = np.append(starts[1:], len(data))
    drop = np.zeros(len(data) + 1, np.int8)
    np.add.at(drop, starts[~kept], 1)
    np.add.at(drop, stop[~kept], -1)
    return data[np.cumsum(drop[:-1]) == 0].tobytes().rstrip(b" \t\n\v\f\r")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their repeated words removed; ``n_chars`` follows the text where it is a column."""
    tagged = _with_spans(docs, repeats(docs, Scratch(docs.sparkSession), window))
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    # Columns go by number, so that no name can clash.
    names = [f"c{i}" for i in range(len(rest))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut(t.as_buffer().to_pybytes(), s) if t.is_valid else None for t, s in zip(b.column("new"), b.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.binary()).cast(pa.string())], [*names, "new"])

    kept = [F.col("row")[c].alias(n) for c, n in zip(rest, names, strict=True)]
    schema = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for c, n in zip(rest, names, strict=True)), T.StructField("new", T.StringType())])
    edited = tagged.where("spans is not null").select(*kept, F.col("row.text").alias("new"), "spans").mapInArrow(run, schema)
    back = {c: F.col(n) for c, n in zip(rest, names, strict=True)} | {"text": F.col("new")}
    if "n_chars" in docs.columns:
        back["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    same = tagged.where("spans is null").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return same.union(edited.select(*[back[c].alias(c) for c in docs.columns]))
