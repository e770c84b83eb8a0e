"""Packing along a space-filling curve (operator 7).

Each document becomes token ids and a hashed bag of ids; a fixed random
projection takes that vector to four dimensions, and the cell it falls in gives
a Hilbert key.  Documents are range-sorted by (key, doc_id), so neighbours on
the curve, which share vocabulary, end up in the same sequences, and a group of
equal documents still spreads over tasks by doc_id.  The number of ranges
follows the number of ids, so a task stays the same size as a corpus grows.
Every task fills sequences of 4096 ids in order and cuts documents where a
sequence is full; what doesn't fill a task's last sequence is packed with that
of the tasks beside it along the curve, and only the last sequence of about a
thousand tasks is padded.

Ids of a text are found word by word: the tokenizer drops white space and never
joins across it, so words are looked up in a bounded cache and only new ones go
to the tokenizer, many at a time.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed each; a null doc_id sorts first; a text of many sequences is cut; an
empty table gives no piece; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, slices, word_bounds, word_hashes

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
DIMS, BITS, BUCKETS = 4, 8, 1024
CACHE_WORDS = 3_000_000
MISSES = 2_000
#: Ids of a task that packs, about, and tasks whose rests are packed together.
TASK_IDS, TASKS_TOGETHER = 4_000_000, 1_024


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.data):
            bigger = np.empty(max(need, 2 * len(self.data)), self.data.dtype)
            bigger[: self.n] = self.data[: self.n]
            self.data = bigger
        self.data[self.n : need] = more
        self.n = need


class Words:
    """Ids of white-space separated words, kept by the 64-bit hash of a word in sorted arrays of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit in 16 bits")
        # A digit is always a token of its own, so it can part words that don't hold it.
        self.parting = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.clear()

    @classmethod
    def held(cls, path: str) -> Words:
        """One per Python worker: kept in a module of its own, as code that is pickled by value is made anew for each task."""
        home = sys.modules.setdefault("_docloom_words", types.ModuleType("_docloom_words"))
        if path not in home.__dict__:
            home.__dict__[path] = cls(path)
        return home.__dict__[path]

    def clear(self) -> None:
        # Two sorted runs of (hash, entry): a large one, and a small one that is merged into it now and then.
        self.runs = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(2)]
        self.begin, self.size, self.flat = Grown(np.int64), Grown(np.int64), Grown(np.uint16)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of words by hash, -1 for new ones."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, entries in self.runs:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, entries[at], out)
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Keep new words: different hashes in rising order."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        entries = np.arange(self.size.n, self.size.n + len(ids))
        self.begin.add(self.flat.n + np.cumsum(size) - size)
        self.size.add(size)
        self.flat.add(np.frombuffer(b"".join(ids), np.uint16))

        def merged(run, keys, values):
            at = np.searchsorted(run[0], keys)
            return np.insert(run[0], at, keys), np.insert(run[1], at, values)

        large, small = self.runs[0], merged(self.runs[1], hashes, entries)
        if len(small[0]) * 8 > len(large[0]):
            large, small = merged(large, *small), (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.runs = [large, small]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of a few words; one call to the tokenizer for many without the parting digit."""
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if b"0" not in w]
        for at in range(0, len(plain), MISSES):
            some = plain[at : at + MISSES]
            ids = np.array(self.tokenizer.encode(" 0 ".join(words[i].decode() for i in some), add_special_tokens=False).ids, np.uint16)
            cut = np.flatnonzero(ids == self.parting[0])
            if len(self.parting) != 1 or len(cut) != len(some) - 1:
                raise ValueError("the parting digit is no token of its own in this vocabulary")
            lo = np.append(0, cut + 1).tolist()
            hi = np.append(cut, len(ids)).tolist()
            for i, a, b in zip(some, lo, hi, strict=True):
                out[i] = ids[a:b].tobytes()
        for i, w in enumerate(words):
            if b"0" in w:
                out[i] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint16).tobytes()
        return out

    def _known(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of different words without white space; new ones are encoded and kept."""
        data = np.frombuffer(b" ".join(words), np.uint8)
        hashes = word_hashes(data, *word_bounds(data, np.array([0, len(data)]))[:2])
        entry = self.find(hashes)
        new = np.flatnonzero(entry < 0)
        new = new[np.argsort(hashes[new])]
        got = self.encode([words[i] for i in new])
        if len(new):
            self.add(hashes[new], got)
        out = dict(zip((words[i] for i in new), got, strict=True))
        for i in np.flatnonzero(entry >= 0):
            a = self.begin.data[entry[i]]
            out[words[i]] = self.flat.data[a : a + self.size.data[entry[i]]].tobytes()
        return out

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Keep words of rising hashes.  An ASCII word has the ids of its lower case; a last point or comma is a token of its own."""
        stems = []
        for w in words:
            stem, tail = w, b""
            if w.isascii() and b"<" not in w:
                stem = w.lower()
                if stem[-1] in b".," and stem[:-1].isalpha():
                    stem, tail = stem[:-1], stem[-1:]
            stems.append((stem, tail))
        own = set(words)
        base = list({x for pair in stems for x in pair if x and x not in own})
        known = self._known(base) if base else {}
        alone = [w for w, (stem, _) in zip(words, stems, strict=True) if stem == w]
        known.update(zip(alone, self.encode(alone), strict=True))
        rest = list({x for pair in stems for x in pair if x and x not in known})
        known.update(zip(rest, self.encode(rest), strict=True))
        self.add(hashes, [known[stem] + known[tail] if tail else known[stem] for stem, tail in stems])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts, and where each text's ids start (and the last end)."""
        starts, ends, first = word_bounds(data, offsets)
        hashes, at, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.size.n > CACHE_WORDS:
            self.clear()
        entry = self.find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            self.learn([raw[i:j] for i, j in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)], hashes[new])
            entry = self.find(hashes)
        begin, size = self.begin.data[entry], self.size.data[entry]
        each = size[which]
        done = np.append(0, np.cumsum(each))
        where = np.repeat(begin[which] - done[:-1], each) + np.arange(done[-1])
        return self.flat.data[where], done[first]


def _projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMS))


def place(ids: list[np.ndarray]) -> np.ndarray:
    """Cells (one row per document, DIMS columns of BITS bits) of hashed and projected bags of ids."""
    bags = np.stack([np.bincount((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22), minlength=BUCKETS) for x in ids]).astype(np.float64)
    flat = bags @ _projection() / np.sqrt((bags * bags).sum(axis=1, keepdims=True))
    share = 0.5 + 0.5 * np.tanh(0.7978845608 * (flat + 0.044715 * flat**3))  # the normal distribution function, nearly
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each cell along the Hilbert curve (axes to transposed index, then interleaved)."""
    x = cells.astype(np.int64).T.copy()
    dims, q = len(x), 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = x[i] & q > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << bits - 1
    while q > 1:
        turn = np.where(x[-1] & q > 0, turn ^ q - 1, turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


def _token_batches(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = Words.held(path), np.array([end_id], np.uint16)
        for b in batches:
            for first, last, data, offsets in slices(b.column("text"), 2 * SLICE_BYTES):
                flat, cut = words.ids(data, offsets)
                ids = [np.concatenate([flat[x:y], end]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                keys = hilbert(place(ids))
                rest = [b.column(i).slice(first, last - first) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(keys), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], [*b.schema.names[:-1], "curve_key", "doc_tokens", "ids"])

    return run


def tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, curve_key, doc_tokens, ids (packed 16-bit) of each document."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_token_batches(path or tokenizer_path(), end_id), "doc_id long, curve_key long, doc_tokens long, ids binary")


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "ids"]
_KINDS = [pa.int64()] * 8 + [pa.binary()]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, ids binary"
#: Sequence numbers of rests start here; those of a task at a multiple of 2**36.
RESTS = 1 << 62


def _fill(pieces: Iterator[tuple], length: int, number: int, with_ids: bool, rest) -> Iterator[pa.RecordBatch]:
    """Fill sequences with (doc_id, start, ids, doc_tokens) in order; ``rest`` makes rows of what doesn't fill the last one."""
    open_, filled, rows = [], 0, []

    def sealed(some: list[tuple], task) -> list[tuple]:
        out, at = [], 0
        for doc, start, ids, total in some:
            raw = ids.astype("<u4").tobytes()
            out.append((doc, start, len(ids), zlib.crc32(raw), total, number, at, task, raw if with_ids else None))
            at += len(ids)
        return out

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _PIECE)

    for doc, first, ids, total in pieces:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, length - filled)
            open_.append((doc, first + at, ids[at : at + take].copy(), total))
            at, filled = at + take, filled + take
            if filled == length:
                rows += sealed(open_, None)
                open_, filled, number = [], 0, number + 1
            if len(rows) >= 4096:
                yield table()
                rows = []
    rows += rest(open_, sealed)
    if rows:
        yield table()


def _pack_batches(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def pieces():
            for b in batches:
                for doc, total, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    yield doc, 0, np.frombuffer(packed.as_buffer(), np.uint16), total

        def rest(open_, _):
            return [(doc, start, len(ids), None, total, None, None, task, ids.astype("<u4").tobytes()) for doc, start, ids, total in open_]

        yield from _fill(pieces(), length, task << 36, with_ids, rest)

    return run


def _rest_batches(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def pieces():
            for b in batches:
                for doc, start, total, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    yield doc, start, np.frombuffer(raw, "<u4"), total

        yield from _fill(pieces(), length, RESTS + (TaskContext.get().partitionId() << 36), with_ids, lambda open_, sealed: sealed(open_, None))

    return run


def pack(docs: DataFrame, *, length: int = LENGTH, path: str | None = None, end_id: int = END_ID, with_ids: bool = False, task_ids: int = TASK_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids as 32-bit numbers)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    held = scratch.keep(tokens(docs, path, end_id), "tokens")
    total = held.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    n = max(spark.sparkContext.defaultParallelism, -(-total // task_ids))
    lined = held.repartitionByRange(n, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")
    pieces = scratch.keep(lined.select("doc_id", "doc_tokens", "ids").mapInArrow(_pack_batches(length, with_ids), _SCHEMA), "pieces")
    full = pieces.where("sequence_id is not null")
    # Rests are less than a sequence a task; those of tasks beside each other on the curve go together.
    rests = pieces.where("sequence_id is null").repartitionByRange(-(-n // TASKS_TOGETHER), "task").sortWithinPartitions("task", "doc_id", "start", "ids")
    packed = rests.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_rest_batches(length, with_ids), _SCHEMA)
    return full.unionByName(packed).select(*_PIECE[:7], *["ids"] * with_ids)
