"""Toxicity by a classifier chain (operator 10).

Categories are predicted one after another by linear models over hashed word
and word-beginning rates; the model of a category also sees the probabilities
of the categories before it.  While training, those probabilities are
out-of-fold predictions, so a later model learns how far to trust an earlier
one on documents it has not seen.

The models are fitted on the driver from at most ``TRAIN`` different labelled
documents and ``TRAIN_VALUES`` feature values (a hash-ordered sample: two
documented bounds, in rows and in bytes), a few documents at a time, so that
training holds no more than the sample.  Every feature has a weight.  Every
document is then scored whole, in one pass without a shuffle, with the models
as part of the task.

Defined cases: a null text is an empty one (rates of zero); a label that is
null, or a labelled id without a document, is not used; without labels of both
kinds a category is predicted at its base rate; repeated rows are scored each
and one of them is trained on;
an empty table gives an empty result; other columns are ignored by ``score``
and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, _BYTES, Scratch, mix64, running, slices, span_hashes

#: Earlier categories feed later ones.
CATEGORIES = ("low_quality", "toxic")
TRAIN = 10_000
#: Feature values of the sample: 8 bytes each on the driver.
TRAIN_VALUES = 12_000_000
FOLDS = 3
DIM = 1 << 18
#: Word beginnings of so many bytes count as features beside the word.
BEGINNINGS = (4, 6)
PER_WORDS = 40.0
EPOCHS, BATCHES, STEP, RIDGE = 6, 40, 0.1, 1e-3
#: Documents of the sample that are handled at a time outside of training.
SOME = 256

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = np.where((data >= 65) & (data <= 90), data + 32, data)
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return np.where(latin, out + 32, out).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of documents: document, feature and rate, each feature once a document."""
    n, m = len(data), len(offsets) - 1
    edge = np.ones(n + 1, bool)
    letter = _LETTER[data]
    edge[1:n] = ~letter[:-1]
    edge[offsets[offsets < n]] = True
    starts = np.flatnonzero(edge[:n] & letter)
    stop = np.ones(n, bool)
    stop[:-1] = ~letter[1:] if n else stop[:-1]
    inner = offsets[1:-1]
    stop[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(stop & letter) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    sums = running(_BYTES[_lower(data)], BASE)
    keys = [span_hashes(sums, starts, ends, BASE, BASE_INV)]
    keys += [mix64(span_hashes(sums, starts, np.minimum(ends, starts + k), BASE, BASE_INV) + np.uint64(k)) for k in BEGINNINGS]
    slot = np.concatenate([(k & np.uint64(DIM - 1)).astype(np.int64) for k in keys])
    both, count = np.unique(np.tile(doc, len(keys)) * DIM + slot, return_counts=True)
    words = np.bincount(doc, minlength=m)
    row = both // DIM
    return row, both % DIM, np.minimum(count * PER_WORDS / np.maximum(words[row], 12), 1.0).astype(np.float32)


@dataclass
class Linear:
    """Sparse logistic regression: slots in use, their weights, weights of earlier probabilities, and the bias."""

    weight: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, rows, slots, rates, before: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(rows, self.weight[slots] * rates, n) + before @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Rates:
    """Feature rates of training documents, one after another: document i has the entries ends[i] .. ends[i + 1]."""

    ends: np.ndarray
    slots: np.ndarray
    rates: np.ndarray

    def take(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (a place in ``docs``), feature and rate of some documents."""
        n = self.ends[docs + 1] - self.ends[docs]
        done = np.append(0, np.cumsum(n))
        at = np.repeat(self.ends[docs] - done[:-1], n) + np.arange(done[-1])
        return np.repeat(np.arange(len(docs)), n), self.slots[at], self.rates[at]

    def sorted(self, order: np.ndarray) -> Rates:
        """The same documents in another order."""
        slots, rates = np.empty_like(self.slots), np.empty_like(self.rates)
        ends = np.append(0, np.cumsum(np.diff(self.ends)[order]))
        for at in range(0, len(order), SOME):
            some = order[at : at + SOME]
            _, slots[ends[at] : ends[at + len(some)]], rates[ends[at] : ends[at + len(some)]] = self.take(some)
        return Rates(ends, slots, rates)


def fit(held: Rates, docs: np.ndarray, before: np.ndarray, y: np.ndarray) -> Linear:
    """Adaptive gradient steps over small batches in a fixed order; the same data give the same model."""
    k = before.shape[1]
    base = float(np.clip(y[docs].mean() if len(docs) else 0.0, 1e-4, 1 - 1e-4))
    w = np.zeros(DIM + k + 1, np.float32)
    w[-1] = np.log(base / (1 - base))
    if y[docs].min(initial=1) < y[docs].max(initial=0):
        moment, sq, t = np.zeros_like(w), np.zeros_like(w), 0
        rng = np.random.default_rng(3)
        for epoch in range(EPOCHS):
            order = rng.permutation(docs)
            for some in np.array_split(order, min(BATCHES, len(order))):
                rows, slots, rates = held.take(some)
                z = np.bincount(rows, w[slots] * rates, len(some)) + before[some] @ w[DIM:-1] + w[-1]
                gap = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]) / len(some)).astype(np.float32)
                g = np.concatenate([np.bincount(slots, rates * gap[rows], DIM) + RIDGE * w[:DIM], before[some].T @ gap, [gap.sum()]]).astype(np.float32)
                t += 1
                moment += 0.1 * (g - moment)
                sq += 0.01 * (g * g - sq)
                w -= STEP * (1 - epoch / EPOCHS) * (moment / (1 - 0.9**t)) / (np.sqrt(sq / (1 - 0.99**t)) + 1e-5)
    return Linear(w[:DIM], w[DIM:-1].astype(np.float64), float(w[-1]))


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear]
    limits: list[float]

    def predict(self, rows, slots, rates, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for m in self.models:
            out = np.column_stack([out, m.predict(rows, slots, rates, out, n)])
        return out


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that splits out-of-fold predictions with the best F1, between its neighbours."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float(p[order[k]] if k + 1 == len(p) else (p[order[k]] + p[order[k + 1]]) / 2)


def fit_chain(held: Rates, labels: np.ndarray, names: tuple[str, ...] = CATEGORIES, folds: int = FOLDS) -> Chain:
    """labels: a column of 0/1 for each category, a row for each document of ``held``."""
    n = len(held.ends) - 1
    every, fold = np.arange(n), np.arange(n) % folds
    before, models, limits = np.zeros((n, 0), np.float32), [], []
    for c in range(len(names)):
        y = labels[:, c].astype(np.float32)
        unseen = np.zeros(n)
        for f in range(folds):
            m = fit(held, every[fold != f], before, y)
            for out in np.array_split(every[fold == f], max(1, n // SOME)):
                unseen[out] = m.predict(*held.take(out), before[out], len(out))
        models.append(fit(held, every, before, y))
        limits.append(best_limit(unseen, y))
        before = np.column_stack([before, unseen]).astype(np.float32)
    return Chain(tuple(names), models, limits)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, e, data, offsets in slices(b.column("text")):
            rows, slots, rates = features(data, offsets)
            cut = np.searchsorted(rows, np.arange(e - a + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (slots.astype(np.int32), rates)]
            yield pa.RecordBatch.from_arrays([b.column("labels").slice(a, e - a), *lists], ["labels", "slots", "rates"])


def label_columns(names: tuple[str, ...]) -> list[Column]:
    """0/1 for each category; ``low_quality`` is the complement of ``quality``."""
    return [(1 - F.col("quality") if n == "low_quality" else F.col(n)).cast("int") for n in names]


def train(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = CATEGORIES, most: int = TRAIN, values: int = TRAIN_VALUES) -> Chain:
    """Fit the chain on a hash-ordered sample of at most ``most`` labelled documents with ``values`` feature values."""
    known = labels.select(F.col("doc_id").alias("_id"), F.array(*label_columns(names)).alias("labels")).where(F.col("_id").isNotNull() & ~F.exists("labels", lambda x: x.isNull()))
    # The sample has a fixed size, which bounds the broadcast.
    sample = known.orderBy(F.xxhash64("_id"), "_id", "labels").limit(most)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), "_id").select(F.concat(F.array(F.xxhash64("_id", "text")), F.col("labels").cast("array<long>")).alias("labels"), "text")
    held = Scratch(docs.sparkSession).keep(texts.mapInArrow(_feature_batches, "labels array<long>, slots array<int>, rates array<float>"), "features")
    # An id may have many rows: the first ``most`` different ones, as long as their values fit.
    sizes = held.groupBy("labels").agg(F.max(F.size("slots")).alias("n")).orderBy("labels").limit(most).collect()
    fits = int(np.searchsorted(np.cumsum([r.n for r in sizes]), values, "right"))
    if not fits:
        return fit_chain(Rates(np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)), np.zeros((0, len(names))), names)
    last = F.array(*[F.lit(x).cast("long") for x in sizes[fits - 1].labels])
    got = held.where(F.col("labels") <= last).dropDuplicates(["labels"]).toArrow()
    # Sorted here: the same sample gives the same model in any order.
    keys = got.column("labels").to_pylist()
    order = np.array(sorted(range(len(keys)), key=lambda i: keys[i]), np.int64)
    parts = [np.concatenate([c.flatten().to_numpy() for c in got.column(n).chunks]) for n in ("slots", "rates")]
    ends = np.append(0, np.cumsum(np.concatenate([c.value_lengths().to_numpy() for c in got.column("slots").chunks])))
    del got
    return fit_chain(Rates(ends, *parts).sorted(order), np.array([keys[i][1:] for i in order]).reshape(-1, len(names)), names)


def _score_batches(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, data, offsets in slices(b.column("text")):
                p = chain.predict(*features(data, offsets), e - a)
                flags = [pa.array((p[:, c] > chain.limits[c]).astype(np.int32)) for c in range(p.shape[1])]
                rest = [b.column(i).slice(a, e - a) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(p[:, c]) for c in range(p.shape[1])), *flags], [*b.schema.names[:-1], *(f"p_{n}" for n in chain.names), *chain.names])

    return run


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, then p_<category> and <category> (0 or 1) for every category."""
    schema = "doc_id long, " + ", ".join([f"p_{n} double" for n in chain.names] + [f"{n} int" for n in chain.names])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score_batches(chain), schema)


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic") -> DataFrame:
    """The documents that the chain doesn't reject, with all their columns."""
    c = chain.names.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [np.empty(0, bool)]
            for a, e, data, offsets in slices(b.column(names.index("text"))):
                keep.append(chain.predict(*features(data, offsets), e - a)[:, c] <= chain.limits[c])
            yield b.filter(pa.array(np.concatenate(keep)))

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)
