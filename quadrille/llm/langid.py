"""Operator 11: the language of a text by a convolutional network over its bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import map_batches, others_of, plus, texts_of

#: At most so many languages, the most frequent ones, and so many rows of each and windows of each row are learned from.
LANGUAGES, ROWS_PER_LANGUAGE, WINDOWS_PER_ROW = 256, 500, 16
#: Bytes of a window, widths of the filters in bytes, filters of each width, and classes that bytes are put into.
LENGTH, WIDTHS, FILTERS, CLASSES = 64, (2, 3, 4), 16, 64
#: Windows that are multiplied at a time.
CHUNK = 1024
UNKNOWN = "und"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def windows_of(text: bytes | None) -> np.ndarray:
    """All windows of a text, lower-cased: each starts where the one before has its last bytes, so that no filter's bytes are
    cut, and the last is filled up with blanks. At least one."""
    step = LENGTH - max(WIDTHS) + 1
    data = (text or b"").translate(_LOWER)
    n = max(1, -(-(len(data) - (LENGTH - step)) // step))
    padded = np.frombuffer(data.ljust((n - 1) * step + LENGTH), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[: (n - 1) * step + 1 : step]


@dataclass(frozen=True)
class Network:
    """classes: the class of each byte; filters: by width, (width, classes, filters); then biases, and the softmax layer."""

    names: list[str]
    classes: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Filters as sums over pairs of bytes: what two neighbours give together is looked up at once."""
        flat = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, -1).astype(np.float32)
        none = np.zeros((CLASSES, FILTERS), np.float32)
        return {w: [flat(f[j], f[j + 1] if j + 1 < w else none) for j in range(0, w, 2)] for w, f in self.filters.items()}

    def log_probabilities(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Of each window: filters at every position, their largest values, and the softmax over languages."""
        out = np.empty((len(windows), len(self.names)))
        for at in range(0, len(windows), CHUNK):
            c = self.classes[windows[at : at + CHUNK]].astype(np.int32)
            pairs = c * CLASSES
            pairs[:, :-1] += c[:, 1:]
            pooled = []
            for w, parts in tables.items():
                places = LENGTH - w + 1
                total = parts[0][pairs[:, :places]]
                for j, t in enumerate(parts[1:], 1):
                    total += t[pairs[:, 2 * j : 2 * j + places]]
                pooled.append(total.max(axis=1))
            z = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.weights + self.offset
            z -= z.max(axis=1, keepdims=True)
            out[at : at + CHUNK] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def fit(windows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.005, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the cross-entropy of windows (n, LENGTH) with labels that index names; each language weighs the same. The
    largest of a filter's values alone carries its gradient back, to the bytes that gave it. No windows, no names or one
    name give a network that has nothing to choose from."""
    rnd = np.random.default_rng(seed)
    counts = np.bincount(windows.ravel(), minlength=256)
    classes = np.zeros(256, np.uint8)
    classes[np.argsort(-counts, kind="stable")[: CLASSES - 1]] = np.arange(1, CLASSES)  # class 0 is all other bytes
    coded = classes[windows].astype(np.int64)
    k, width = len(names), len(WIDTHS) * FILTERS
    p = {w: rnd.normal(0, 0.3, (w, CLASSES, FILTERS)) for w in WIDTHS} | {"b": np.zeros(width), "v": rnd.normal(0, 0.1, (width, k)), "c": np.zeros(k)}
    m, s = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))
    share = len(labels) / np.maximum(1, k * np.bincount(labels, minlength=k))
    t = 0
    for _ in range(epochs if k > 1 else 0):
        order = rnd.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = coded[rows], labels[rows]
            pooled, where = [], {}
            for w in WIDTHS:
                places = LENGTH - w + 1
                total = sum(p[w][j][x[:, j : j + places]] for j in range(w))
                where[w] = total.argmax(axis=1)
                pooled.append(np.take_along_axis(total, where[w][:, None, :], 1)[:, 0])
            h = np.maximum(np.concatenate(pooled, axis=1) + p["b"], 0)
            z = h @ p["v"] + p["c"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(y)), y] -= 1
            q *= share[y][:, None] / len(y)
            dh = (q @ p["v"].T) * (h > 0)
            g = {"v": h.T @ q + decay * p["v"], "c": q.sum(axis=0), "b": dh.sum(axis=0)}
            for i, w in enumerate(WIDTHS):
                own, f = dh[:, i * FILTERS : (i + 1) * FILTERS], np.arange(FILTERS)
                hit = [np.take_along_axis(x, where[w] + j, 1) * FILTERS + f for j in range(w)]
                g[w] = np.stack([np.bincount(at_.ravel(), own.ravel(), CLASSES * FILTERS).reshape(CLASSES, FILTERS) for at_ in hit]) + decay * p[w]
            t += 1
            for n in p:
                m[n] += 0.1 * (g[n] - m[n])
                s[n] += 0.001 * (g[n] ** 2 - s[n])
                p[n] -= rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(s[n] / (1 - 0.999**t)) + 1e-8)
    return Network(names, classes, {w: p[w] for w in WIDTHS}, p["b"], p["v"], p["c"])


def _sampled(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows spread evenly over each text, the first and the last among them."""
        for batch in batches:
            cut = [(w := windows_of(t))[np.unique(np.linspace(0, len(w) - 1, min(len(w), WINDOWS_PER_ROW)).astype(int))].tobytes() for t in texts_of(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_lang")), pa.array(cut, pa.binary())], names=["_lang", "_windows"])

    return run


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Network:
    """Fits a network on at most rows_per_language rows of each language outside the held-out quarter, chosen by a hash of
    id and text, with at most WINDOWS_PER_ROW windows each. Rows with a null id, language or text, and texts without a
    letter, teach nothing; rows that repeat both id and text teach once. Counts of languages and the chosen windows,
    a bounded number, come to the driver."""
    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
    rows = docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias(text_col), F.xxhash64(id_col, text_col).alias("_hash"), held.alias("_held"))
    rows = rows.where(f"_held <> 2 AND _lang IS NOT NULL AND `{text_col}` RLIKE '\\\\p{{L}}'")
    counts = rows.groupBy("_lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(LANGUAGES).collect()
    names = sorted(r[0] for r in counts)
    if not names:
        return fit(np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), [])
    drawn = F.pmod(F.col("_hash"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[0], min(1.0, 1.5 * rows_per_language / r[1] + 20 / r[1]))))
    some = rows.where(drawn < F.element_at(share, F.col("_lang"))).dropDuplicates(["_lang", "_hash"])
    first = Window.partitionBy("_lang").orderBy("_hash")
    some = some.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= rows_per_language)
    found = sorted((r[0], bytes(r[1])) for r in map_batches(some.select("_lang", text_col), _sampled(text_col), "_lang string, _windows binary").collect())
    windows = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, LENGTH)
    labels = np.repeat([names.index(lang) for lang, _ in found], [len(w) // LENGTH for _, w in found])
    return fit(windows, labels, names)


def identified(docs: DataFrame, network: Network, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs' other columns, the predicted language and its probability, from the mean of the log-probabilities of all windows
    of the whole text. Texts that are null or have no letter, and all texts if no language was learned, are `und` with
    score 0; given columns of these two names are replaced. Rows stay as they are, repeats included."""
    others = others_of(docs, text_col, lang, score)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        tables, names = n.tables(), n.names or [UNKNOWN]
        for batch in batches:
            given = [windows_of(t) for t in texts_of(batch, text_col)]
            start = np.cumsum([0, *map(len, given)])
            best, chance = np.zeros(len(given), np.int64), np.zeros(len(given))
            if n.names and given:
                logs = n.log_probabilities(np.concatenate(given), tables)
                mean = np.add.reduceat(logs, start[:-1], axis=0) / np.diff(start)[:, None]
                q = np.exp(mean - mean.max(axis=1, keepdims=True))
                best, chance = q.argmax(axis=1), q.max(axis=1) / q.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(chance, pa.float64())], names=[*others, lang, score])

    given, kept = docs.select(*others, text_col), docs.select(*others)
    nothing = given.where(~lettered).select(*others, F.lit(UNKNOWN).alias(lang), F.lit(0.0).alias(score))
    return map_batches(given.where(lettered), run, plus(kept, f"`{lang}` string, `{score}` double")).union(nothing)


def op11_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; a null id isn't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    found = identified(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
