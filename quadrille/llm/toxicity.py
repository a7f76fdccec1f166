"""Operator 9: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, others_of, plus, texts_of, words_of

#: At most so many rows of each label are learned from; which, a hash of doc_id decides.
ROWS_PER_LABEL = 3000
#: log2 of the number of weights.
BITS = 20
#: Features of fewer learning rows aren't weighed.
SEEN = 3
#: L1 strengths, times the root of the number of rows; folds of the learning rows choose one.
STRENGTHS = (0.1, 0.16, 0.3)
FOLDS = 3
#: Beginnings of words, in letters: words that are inflected or compounded otherwise share them.
STEMS = (4, 5, 6, 7)
#: Log odds of a third.
UNKNOWN = -0.6931471805599453
_KEEP_WORDS = 300_000
_BI, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hasher:
    """Feature numbers of a text: its words, pairs of neighbours, pairs with one word between, and the beginnings of its
    words. Word hashes are kept in a table that is emptied when it has grown too large."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift = np.uint64(64 - bits)
        self.known: dict[bytes, int] = {}
        self.stems: dict[bytes, list[int]] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words, known, stems = words_of(text), self.known, self.stems
        if len(known) > _KEEP_WORDS:
            known.clear()
            stems.clear()
        distinct = set(words)
        for w in distinct.difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
            letters = w.decode()
            stems[w] = [xxhash.xxh64_intdigest(letters[:k].encode(), seed=k) for k in STEMS if len(letters) > k]
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        begin = np.fromiter(chain.from_iterable(map(stems.__getitem__, distinct)), np.uint64)
        turned = h << np.uint64(31) | h >> np.uint64(33)
        return np.concatenate((h, (h[:-1] ^ turned[1:]) * _BI, (h[:-2] ^ turned[2:]) * _SKIP, begin)) >> self.shift


@dataclass(frozen=True)
class Model:
    """Compact sparse weights: only the features that L1 left, by ascending number."""

    bias: float
    features: np.ndarray
    weights: np.ndarray
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.features.astype(np.int64)] = self.weights
        return out


def score(dense: np.ndarray, bias: float, features: np.ndarray) -> float:
    """Each feature counts once for a text, however often it occurs."""
    w = dense[features]
    found = features[w != 0]
    z = bias + float(dense[np.unique(found)].sum(dtype=np.float64)) if len(found) else bias
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


Encoded = list[tuple[np.ndarray, int]]


def _ftrl(encoded: Encoded, size: int, l1: float, alpha: float, beta: float, l2: float, epochs: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The bias, the features that L1 left and their weights."""
    l1 *= len(encoded) ** 0.5
    z, n = np.zeros(size), np.zeros(size)
    positive = sum(y for _, y in encoded)
    bias, bias_n = float(np.log((positive + 0.5) / (len(encoded) - positive + 0.5))), 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs if 0 < positive < len(encoded) else 0):
        for i in order.permutation(len(encoded)):
            at, y = encoded[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + np.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > l1)
    return bias, at, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)


def fit(rows: list[tuple[bytes | None, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 0.065, l2: float = 0.5, epochs: int = 4, bits: int = BITS, seed: int = 7) -> Model:
    """FTRL-proximal (McMahan et al.): per-coordinate rates alpha / (beta + sqrt(n)), L1 and L2. The bias has no L1.

    l1 is times the root of the number of rows, as gradients of noise add up. Rows are (text, label); no rows, or only one label, give a model without features that scores the base rate.
    """
    hasher = Hasher(bits)
    bias, at, w = _ftrl([(np.unique(hasher(t)).astype(np.int64), y) for t, y in rows], 1 << bits, l1, alpha, beta, l2, epochs, seed)
    return Model(bias, at.astype(np.uint32), w.astype(np.float32), bits)


def _chosen(encoded: Encoded, size: int, strength: float, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """A strong L1 chooses features, which are then fitted again under a weak one: the strong one alone leaves the weights
    of the right features too small."""
    _, at, _ = _ftrl(encoded, size, strength, 1.0, 1.0, 0.5, 2, seed)
    place = np.full(size, -1)
    place[at] = np.arange(len(at))
    few = [(p[p >= 0], y) for p, y in ((place[a], y) for a, y in encoded)]
    bias, left, w = _ftrl(few, len(at), 0.02, 1.0, 1.0, 0.5, 6, seed)
    return bias, at[left], w


def _cut(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The largest F1 that a cut of the scores z reaches, and that cut, half way to the next score."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    ends = np.append(z[1:] < z[:-1], True)  # equal scores fall on one side
    f1 = np.where(ends, 2 * hits / (np.arange(1, len(z) + 1) + hits[-1]), -1.0)
    k = int(f1.argmax())
    return float(f1[k]), float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)


def tuned(rows: list[tuple[bytes | None, int]], strengths: tuple[float, ...] = STRENGTHS, folds: int = FOLDS, seen: int = SEEN, bits: int = BITS, seed: int = 7) -> Model:
    """fit() with what folds of the rows choose: the L1 strength, and the place of score 0.5, by the largest F1 of scores
    out of fold (of equal ones the strongest L1). Equal texts share a fold. Features of fewer than `seen` rows are left out.

    With both labels, and without rows, a text that holds no weighed feature scores a third at most: nothing speaks against
    it. With one label only the score is the base rate.
    """
    if not rows:
        return Model(UNKNOWN, np.empty(0, np.uint32), np.empty(0, np.float32), bits)
    hasher, size = Hasher(bits), 1 << bits
    encoded = [(np.unique(hasher(t)).astype(np.int64), y) for t, y in rows]
    count = np.bincount(np.concatenate([a for a, _ in encoded]), minlength=size)
    encoded = [(a[count[a] >= seen], y) for a, y in encoded]
    labels, of = np.array([y for _, y in encoded]), np.array([xxhash.xxh64_intdigest(t or b"") % folds for t, _ in rows])
    best = (-1.0, 0.0, max(strengths))
    for strength in sorted(strengths, reverse=True) if 0 < labels.sum() < len(labels) else ():
        z = np.zeros(len(rows))
        for k in range(folds):
            bias, at, w = _chosen([e for e, f in zip(encoded, of, strict=True) if f != k], size, strength, seed)
            dense = np.zeros(size)
            dense[at] = w
            for i in np.flatnonzero(of == k):
                z[i] = bias + dense[encoded[i][0]].sum()
        f1, cut = _cut(z, labels)
        best = max(best, (f1, cut, strength), key=lambda b: b[0])
    bias, at, w = _chosen(encoded, size, best[2], seed)
    return Model(bias if best[0] < 0 else min(bias - best[1], UNKNOWN), at.astype(np.uint32), w.astype(np.float32), bits)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_label: int = ROWS_PER_LABEL) -> Model:
    """A tuned() model of at most rows_per_label documents of each label outside the held-out fifth.

    Labels of a repeated id agree on their largest, and its texts on their smallest, so at most rows_per_label texts of
    each label come to the driver. Null ids and labels teach nothing. The chosen ids, a bounded number, are broadcast.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold != 0)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = [r for y in (0, 1) for r in known.where(F.col("_label") == y).orderBy(F.xxhash64(id_col), id_col).limit(rows_per_label).collect()]
    if not chosen:
        return tuned([])
    ids = spark.createDataFrame(chosen, known.schema)
    found = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).groupBy(id_col, "_label").agg(F.min(text_col).cast("binary"))
    rows = sorted(((r[0], r[2] or b"", r[1]) for r in found.toLocalIterator()), key=lambda r: str(r[0]))
    return tuned([(t, y) for _, t, y in rows])


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs' other columns and `out`, from 0 to 1; null and empty texts score the bias alone. Rows stay as they
    are; a column that `out` names already is replaced."""
    others = others_of(docs, text_col, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense, hasher = m.dense(), Hasher(m.bits)
        for batch in batches:
            scores = [score(dense, m.bias, hasher(t)) for t in texts_of(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(scores, pa.float64())], names=[*others, out])

    return map_batches(docs.select(*others, text_col), run, plus(docs.select(*others), f"`{out}` double"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs.select("doc_id", "text"), learn(docs, labels))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
