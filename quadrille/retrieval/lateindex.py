"""A kept index for late interaction: centroids, residual codes of a few bits a component, postings by centroid.

Two searches: bounded() reads all codes, but whole vectors only of documents that can be among the best, and misses none;
search() reads the postings of a few centroids and the codes of its candidates, and is as good as centroids tell vectors apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quadrille.context import kept
from quadrille.retrieval.ranking import NUMBERS, met, ranked

#: Token vectors that centroids and code buckets are fitted on; all are indexed.
SAMPLE = 32_768
MOST_CENTROIDS = 4096
#: Postings of a part of a centroid; one with more is several.
PART = 100_000
BATCH = 256


def _vectors(lists: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Token vectors of documents, one after the other, and how many each has. Those of another length, or with components that
    are null or not finite, are no tokens."""
    good = [[v for v in (tokens or []) if v is not None and len(v) == width and all(x is not None for x in v) and np.isfinite(v).all()] for tokens in lists]
    flat = [v for tokens in good for v in tokens]
    return np.array(flat, np.float32).reshape(len(flat), width), np.array([len(x) for x in good], np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The closest centroid of each vector."""
    half = (centroids**2).sum(axis=1) / 2
    some = max(1, NUMBERS // max(1, len(centroids)))
    return np.concatenate([np.zeros(0, np.int64), *((vectors[i : i + some] @ centroids.T - half).argmax(axis=1) for i in range(0, len(vectors), some))])


def k_means(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from k of the sample's vectors; a centroid without vectors stays where it is."""
    centroids = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        at = nearest(sample, centroids)
        counts = np.bincount(at, minlength=len(centroids))
        sums = np.zeros(centroids.shape, np.float64)
        np.add.at(sums, at, sample)
        centroids[counts > 0] = (sums[counts > 0] / counts[counts > 0, None]).astype(np.float32)
    return centroids


def packed(residuals: np.ndarray, cuts: np.ndarray, bits: int) -> np.ndarray:
    """Codes of the buckets that components fall into, several a byte: (n, width * bits / 8) bytes, the last one filled up."""
    codes = np.searchsorted(cuts, residuals).astype(np.uint8)
    places = 8 // bits
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % places)))
    return sum(codes[:, i::places] << np.uint8(bits * i) for i in range(places)).astype(np.uint8)


def unpacked(data: np.ndarray, width: int, values: np.ndarray, bits: int) -> np.ndarray:
    places, mask = 8 // bits, (1 << bits) - 1
    codes = np.stack([data >> np.uint8(bits * i) & mask for i in range(places)], axis=-1).reshape(len(data), -1)[:, :width]
    return values[codes]


@dataclass(frozen=True)
class Codec:
    """What vectors are coded with: bounded in size, so that tasks get it whole."""

    centroids: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    bits: int

    @staticmethod
    def fit(sample: np.ndarray, tokens: int, bits: int, centroids: int | None = None) -> Codec:
        """Some four times the root of the number of tokens are centroids, a power of two; buckets hold equal shares of the
        residuals' components and stand for their medians."""
        if bits not in (1, 2, 4, 8):
            raise ValueError("bits must be 1, 2, 4 or 8")
        k = centroids or 1 << max(0, int(np.log2(4 * max(1, tokens) ** 0.5)))
        k = max(1, min(k, MOST_CENTROIDS, len(sample)))
        middle = k_means(sample, k) if len(sample) else np.zeros((1, sample.shape[1]), np.float32)
        rest = (sample - middle[nearest(sample, middle)]).ravel() if len(sample) else np.zeros(1, np.float32)
        n = 1 << bits
        cuts, values = np.quantile(rest, np.arange(1, n) / n), np.quantile(rest, (np.arange(n) + 0.5) / n)
        return Codec(middle, cuts.astype(np.float32), values.astype(np.float32), bits)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(vectors, self.centroids)
        return at.astype(np.int32), packed(vectors - self.centroids[at], self.cuts, self.bits)

    def decode(self, at: np.ndarray, data: np.ndarray) -> np.ndarray:
        return self.centroids[at] + unpacked(data, self.centroids.shape[1], self.values, self.bits)


@dataclass(frozen=True)
class LateIndex:
    """Written tables. documents: (doc, at array<int>, codes binary, errors array<float>), the centroids and codes of a document's
    tokens, and how far from them the vectors are; postings:
    (centroid, part, doc), each once, in order of centroids, a large centroid in several parts; parts: (centroid, parts)."""

    documents: DataFrame
    postings: DataFrame
    parts: DataFrame
    codec: Codec

    @property
    def bytes_a_vector(self) -> float:
        return 8 + self.codec.centroids.shape[1] * self.codec.bits / 8

    @staticmethod
    def build(docs: DataFrame, doc: str, tokens: str, path: str, bits: int = 4, centroids: int | None = None) -> LateIndex:
        """Codes all documents' token vectors in one pass and writes the index to `path`. Documents whose tokens are null or
        empty are in it without postings; vectors of another length than the sample's first, or with components that are null
        or not finite, aren't. Centroids are fitted on at most SAMPLE vectors, of documents that a hash chooses."""
        spark = docs.sparkSession
        rows = docs.select(F.col(doc).alias("doc"), F.col(tokens).alias("tokens"))
        total = rows.agg(F.sum(F.coalesce(F.size("tokens"), F.lit(0)))).first()[0] or 0
        some = rows.where("size(tokens) > 0").orderBy(F.xxhash64("doc")).limit(SAMPLE // 8).select(F.slice("tokens", 1, SAMPLE // 8).alias("t")).toLocalIterator()
        sample: list = []
        for row in some:
            sample += [v for v in row.t if v is not None and all(x is not None for x in v)]
            if len(sample) >= SAMPLE:
                break
        width = len(sample[0]) if sample else 0
        codec = Codec.fit(_vectors([sample[:SAMPLE]], width)[0], total, bits, centroids)
        shared = spark.sparkContext.broadcast(codec)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(i, BATCH)
                    vectors, sizes = _vectors(batch.column(1).to_pylist(), width)
                    at, data = shared.value.encode(vectors)
                    errors = np.linalg.norm(vectors - shared.value.decode(at, data), axis=1).astype(np.float64)
                    errors = np.nextafter((errors * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))  # never below the truth
                    ends = np.cumsum([0, *sizes])
                    cut = lambda x: [x[a:b] for a, b in zip(ends, ends[1:], strict=False)]  # noqa: B023, E731
                    columns = [pa.array([x.tolist() for x in cut(at)], pa.list_(pa.int32())), pa.array([x.tobytes() for x in cut(data)], pa.binary()), pa.array([x.tolist() for x in cut(errors)], pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", "at", "codes", "errors"])

        kind = dict(rows.dtypes)["doc"]
        rows.mapInArrow(encode, f"doc {kind}, at array<int>, codes binary, errors array<float>").write.mode("overwrite").parquet(f"{path}/documents")
        documents = spark.read.parquet(f"{path}/documents")
        pairs = documents.select(F.explode(F.array_distinct("at")).alias("centroid"), "doc")
        pairs.groupBy("centroid").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).write.mode("overwrite").parquet(f"{path}/parts")
        parts = spark.read.parquet(f"{path}/parts")
        placed = pairs.join(F.broadcast(parts), "centroid").select("centroid", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "doc")  # at most MOST_CENTROIDS rows
        placed.repartitionByRange("centroid", "part", "doc").sortWithinPartitions("centroid", "part").write.mode("overwrite").parquet(f"{path}/postings")
        fixed = [(bits, codec.cuts.tolist(), codec.values.tolist(), width)]
        spark.createDataFrame(fixed, "bits int, cuts array<float>, `values` array<float>, width int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codec")
        spark.createDataFrame(list(enumerate(codec.centroids.tolist())), "centroid int, vector array<float>").write.mode("overwrite").parquet(f"{path}/centroids")
        return LateIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> LateIndex:
        fixed = spark.read.parquet(f"{path}/codec").first()
        found = spark.read.parquet(f"{path}/centroids").orderBy("centroid").collect()
        middle = np.array([r.vector for r in found], np.float32).reshape(len(found), fixed.width)
        codec = Codec(middle, np.array(fixed.cuts, np.float32), np.array(fixed["values"], np.float32), fixed.bits)
        return LateIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("documents", "postings", "parts")), codec)

    def probed(self, queries: DataFrame, query: str, tokens: str, probes: int) -> DataFrame:
        """(query, token, centroid, score): the centroids with the largest products of each query token."""
        shared = queries.sparkSession.sparkContext.broadcast(self.codec)
        of = to_arrow_type(queries.schema[query].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            middle = shared.value.centroids
            for whole in batches:
                for i in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(i, BATCH)
                    asked, sizes = _vectors(batch.column(1).to_pylist(), middle.shape[1])
                    k = min(probes, len(middle))
                    scores = asked @ middle.T
                    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    row, token = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(row, k))).cast(of), pa.array(np.repeat(token, k).astype(np.int32)), pa.array(best.ravel().astype(np.int32)), pa.array(np.take_along_axis(scores, best, 1).ravel().astype(np.float64))], names=[query, "token", "centroid", "score"])

        return queries.select(query, tokens).mapInArrow(run, f"`{query}` {dict(queries.dtypes)[query]}, token int, centroid int, score double")

    def candidates(self, queries: DataFrame, query: str, tokens: str, probes: int, most: int) -> DataFrame:
        """(query, doc): documents with a token in a probed centroid, by the sum over query tokens of the best probed centroid;
        a token none of whose centroids a document has counts as much as its worst probed one. The first `most` of a query."""
        probed = self.probed(queries, query, tokens, probes)
        floors = probed.groupBy(query, "token").agg(F.min("score").alias("_floor"))
        base = floors.groupBy(query).agg(F.sum("_floor").alias("_base"))
        gains = probed.join(floors, [query, "token"]).withColumn("_gain", F.col("score") - F.col("_floor"))
        dealt = gains.join(F.broadcast(self.parts), "centroid").select(query, "token", "_gain", "centroid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = dealt.join(self.postings, ["centroid", "part"]).groupBy(query, "doc", "token").agg(F.max("_gain").alias("_gain"))
        scores = met.groupBy(query, "doc").agg(F.sum("_gain").alias("_gain")).join(base, query).withColumn("score", F.col("_gain") + F.col("_base"))
        return ranked(scores, [query], "doc", k=most).select(query, "doc")

    def search(self, queries: DataFrame, query: str, tokens: str, k: int = 10, probes: int = 16, most: int = 1024, vectors: DataFrame | None = None, rescored: int | None = None) -> DataFrame:
        """(query, doc, score, rank): candidates by their centroids, then scores from the residual codes. With `vectors` (doc,
        doc_tokens) the first `rescored` (8 k) get their exact scores, from whole vectors that are read for them alone.

        Queries without tokens find nothing. Nothing is collected; centroids and codes' values, bounded in size, are broadcast.
        """
        few = self.candidates(queries, query, tokens, probes, most)
        pairs = few.join(self.documents, "doc").join(queries.select(query, tokens), query)
        found = ranked(self._scored(pairs, query, tokens), [query], "doc", k=k if vectors is None else rescored or 8 * k)
        if vectors is None:
            return found
        pairs = found.select(query, "doc").join(vectors.select("doc", "doc_tokens"), "doc").join(queries.select(query, tokens), query)
        return ranked(_exact(pairs, query, tokens), [query], "doc", k=k)

    def bounded(self, queries: DataFrame, query: str, tokens: str, vectors: DataFrame, k: int = 10, block: int = 512, most: int | None = None) -> DataFrame:
        """(query, doc, score, rank): the exact first k, or with `most`, the first k of so many that codes place first, whatever
        their intervals; for codes of few bits, whose intervals are wide. Codes give each document's score an interval, by the distance of vectors
        from their codes; only documents that reach the k-th largest lower end are scored by their whole vectors (doc,
        doc_tokens). Documents without tokens score 0."""
        reach = self.within(queries, query, tokens, k, block, most).select(query, "doc")
        pairs = reach.join(vectors.select("doc", "doc_tokens"), "doc").join(queries.select(query, tokens), query)
        return ranked(_exact(pairs, query, tokens), [query], "doc", k=k)

    def within(self, queries: DataFrame, query: str, tokens: str, k: int, block: int = 512, most: int | None = None) -> DataFrame:
        """(query, doc, low, high): the documents that can be among the first k, or the first `most` by the middle."""
        codec, of = self.codec, to_arrow_type(queries.schema[query].dataType)
        width, shared = codec.centroids.shape[1], queries.sparkSession.sparkContext.broadcast(codec)

        def ends_of(part: list, asked: list, sizes: np.ndarray, decoded: np.ndarray, errors: np.ndarray) -> list[np.ndarray]:
            """The lower and upper ends of the scores of some queries with a batch's documents."""
            vectors, of_query = _vectors(asked, width)
            vectors = vectors.astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1)[:, None]
            full = np.flatnonzero(sizes)
            starts = np.cumsum([0, *sizes[full][:-1]])
            ends = [np.zeros((len(part), len(sizes))) for _ in range(2)]
            step = max(1, NUMBERS // max(1, len(decoded)))  # of query tokens
            owner = np.repeat(np.arange(len(part)), of_query)
            for i in range(0, len(vectors) if len(full) else 0, step):
                products = vectors[i : i + step] @ decoded.T
                slack = norms[i : i + step] * errors
                for total, side in zip(ends, (products - slack, products + slack), strict=True):
                    best = np.zeros((len(side), len(sizes)))
                    best[:, full] = np.maximum.reduceat(side, starts, axis=1)
                    np.add.at(total, owner[i : i + step], best)
            return ends

        def run(part: list, batch: pa.RecordBatch) -> pa.RecordBatch:
            codec, n, found = shared.value, most or k, []
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            marks, total = [0], 0
            for i, size in enumerate(sizes.tolist()):  # documents of so many tokens at once, or one
                total += size
                if total * width > 4 * NUMBERS and i > marks[-1]:
                    marks.append(i)
                    total = size
            for first, last in zip(marks, [*marks[1:], len(sizes)], strict=True):
                piece = batch.slice(first, last - first)
                at = piece.column(1).flatten().to_numpy()
                data = np.frombuffer(b"".join(piece.column(2).to_pylist()), np.uint8).reshape(len(at), -1) if len(at) else np.zeros((0, 1), np.uint8)
                decoded = codec.decode(at, data).astype(np.float64) if len(at) else np.zeros((0, width))
                errors = piece.column(3).flatten().to_numpy() * (1 + 1e-6) + 1e-6
                some = max(1, NUMBERS // max(1, last - first))  # of queries
                for i in range(0, len(part), some):
                    rows = part[i : i + some]
                    low, high = ends_of(rows, [r[1] for r in rows], sizes[first:last], decoded, errors)
                    floor = low + high if most else low
                    least = np.partition(floor, floor.shape[1] - n, axis=1)[:, floor.shape[1] - n][:, None] if floor.shape[1] > n else np.full((len(rows), 1), -np.inf)
                    q, d = np.nonzero((floor if most else high) >= least)
                    found.append((q + i, d + first, low[q, d], high[q, d]))
            q, d, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            return pa.RecordBatch.from_arrays([pa.array([part[i][0] for i in q.tolist()], of), batch.column(0).take(pa.array(d)), pa.array(low), pa.array(high)], names=[query, "doc", "low", "high"])

        kinds = dict(queries.dtypes) | dict(self.documents.dtypes)
        found = met(self.documents.select("doc", "at", "codes", "errors"), queries.select(query, tokens), run, f"`{query}` {kinds[query]}, doc {kinds['doc']}, low double, high double", block)
        if most:
            return ranked(found.withColumn("score", F.col("low") + F.col("high")), [query], "doc", k=most)
        found = kept(found, "late_bounds")
        floor = ranked(found.withColumnRenamed("low", "score"), [query], "doc", k=k).groupBy(query).agg(F.min("score").alias("_floor"))
        return found.join(floor, query).where("high >= _floor").drop("_floor")

    def _scored(self, pairs: DataFrame, query: str, tokens: str) -> DataFrame:
        shared = pairs.sparkSession.sparkContext.broadcast(self.codec)

        def score(batch: pa.RecordBatch) -> list[float]:
            codec = shared.value
            ats, codes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sizes = np.array([len(a) for a in ats])
            at = np.array([x for a in ats for x in a], np.int64)
            decoded = codec.decode(at, np.frombuffer(b"".join(codes), np.uint8).reshape(len(at), -1)) if len(at) else np.zeros((0, codec.centroids.shape[1]), np.float32)
            return _max_sims(batch.column(4).to_pylist(), decoded, sizes)

        return _scores(pairs.select(query, "doc", "at", "codes", tokens), query, score)


def _max_sims(asked: list, decoded: np.ndarray, sizes: np.ndarray) -> list[float]:
    """Of each row's query tokens with its document's, which are `sizes` of the decoded ones in turn."""
    ends = np.cumsum([0, *sizes])
    out = []
    for tokens, a, b in zip(asked, ends, ends[1:], strict=False):
        own = _vectors([tokens], decoded.shape[1])[0].astype(np.float64)
        out.append(float((own @ decoded[a:b].T.astype(np.float64)).max(axis=1).sum()) if b > a and len(own) else 0.0)
    return out


def _scores(pairs: DataFrame, query: str, score) -> DataFrame:
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score(batch), pa.float64())], names=[query, "doc", "score"])

    return pairs.mapInArrow(run, f"`{query}` {kinds[query]}, doc {kinds['doc']}, score double")


def _exact(pairs: DataFrame, query: str, tokens: str) -> DataFrame:
    def score(batch: pa.RecordBatch) -> list[float]:
        lists = batch.column(2).to_pylist()
        width = next((len(v) for t in lists for v in t or [] if v is not None), 0)
        vectors, sizes = _vectors(lists, width)
        return _max_sims(batch.column(3).to_pylist(), vectors, sizes)

    return _scores(pairs.select(query, "doc", "doc_tokens", tokens), query, score)
