"""The kept index for late interaction against the search that reads everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.retrieval import lateindex, ranking
from quadrille.retrieval.lateindex import Codec, LateIndex


def made(spark, seed, docs=400, width=16, topics=40, spread=0.25, odd=True):
    """Documents of one to six token vectors around a topic's own, with odd ones among them."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 1, (topics, 4, width))
    rows = [(i, [[float(x) for x in centres[i % topics][rnd.integers(4)] + rnd.normal(0, spread, width)] for _ in range(rnd.integers(1, 7))]) for i in range(docs)]
    if odd:
        rows += [(1000, None), (1001, []), (1002, rows[0][1]), (1003, rows[0][1])]
    return spark.createDataFrame(rows, "doc long, doc_tokens array<array<float>>").repartition(5)


def asked(docs, step=40):
    return docs.where(F.col("doc") % step == 0).select(F.col("doc").alias("query"), F.col("doc_tokens").alias("query_tokens"))


def tops(df, places=4):
    return sorted((r.query, r["rank"], r.doc, round(r.score, places)) for r in df.collect())


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_codes_round_trip(bits):
    rnd = np.random.default_rng(bits)
    sample = rnd.normal(0, 1, (500, 13)).astype(np.float32)
    codec = Codec.fit(sample, 500, bits)
    at, data = codec.encode(sample)
    assert data.shape == (500, -(-13 * bits // 8))
    codes = np.searchsorted(codec.cuts, sample - codec.centroids[at])
    assert np.allclose(codec.decode(at, data), codec.centroids[at] + codec.values[codes])
    assert np.array_equal(at, ((sample[:, None] - codec.centroids[None]) ** 2).sum(axis=2).argmin(axis=1))


@pytest.mark.parametrize("bits", [2, 8])
def test_bounded_search_is_exact(spark, tmp_path, bits):
    docs = made(spark, bits)
    queries = asked(docs)
    index = LateIndex.build(docs, "doc", "doc_tokens", f"{tmp_path}/x", bits=bits)
    want = ranking.max_sim(docs, queries, "doc", "query", 7)
    assert tops(index.bounded(queries, "query", "query_tokens", docs, 7).where("score <> 0")) == tops(want.where("score <> 0"))
    survivors = index.within(queries, "query", "query_tokens", 7)
    assert bits == 2 or survivors.count() < 0.2 * docs.count() * queries.count()


def test_probing_finds_nine_in_ten(spark, tmp_path):
    docs = made(spark, 3, docs=1200, odd=False)
    queries = asked(docs)
    index = LateIndex.build(docs, "doc", "doc_tokens", f"{tmp_path}/x")
    want = {(r.query, r.doc) for r in ranking.max_sim(docs, queries, "doc", "query", 10).collect()}
    got = {(r.query, r.doc) for r in index.search(queries, "query", "query_tokens", 10, probes=8, most=100).collect()}
    assert len(want & got) >= 0.9 * len(want)
    exact = index.search(queries, "query", "query_tokens", 10, probes=8, most=100, vectors=docs)
    assert len(want & {(r.query, r.doc) for r in exact.collect()}) >= 0.95 * len(want)
    assert index.candidates(queries, "query", "query_tokens", 8, 10_000).count() < 0.5 * docs.count() * queries.count()


def test_a_large_centroid_is_several_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lateindex, "PART", 20)
    docs = made(spark, 5, docs=200, topics=1, spread=0.01)
    index = LateIndex.build(docs, "doc", "doc_tokens", f"{tmp_path}/x", centroids=4)
    assert index.parts.agg(F.max("parts")).first()[0] > 1
    queries = asked(docs).where("size(query_tokens) > 0")
    found = index.candidates(queries, "query", "query_tokens", 4, 10_000)
    assert found.count() == queries.count() * docs.where("size(doc_tokens) > 0").count()


def test_late_index_of_nothing(spark, tmp_path):
    none = made(spark, 1).where("false")
    index = LateIndex.build(none, "doc", "doc_tokens", f"{tmp_path}/x")
    queries = asked(made(spark, 1))
    assert index.search(queries, "query", "query_tokens").collect() == []
    assert index.bounded(queries, "query", "query_tokens", none).collect() == []
    full = LateIndex.build(made(spark, 1), "doc", "doc_tokens", f"{tmp_path}/y")
    assert full.search(queries.where("false"), "query", "query_tokens").collect() == []


def test_more_queries_than_a_block_are_dealt(spark, monkeypatch):
    """The same first k by broadcast and by blocks of queries that meet blocks of rows."""
    monkeypatch.setattr(ranking, "ROW_BLOCK", 150)
    docs = made(spark, 7)
    vectors = docs.where("size(doc_tokens) > 0").select("doc", F.col("doc_tokens")[0].alias("vector"))
    vectors = vectors.union(spark.createDataFrame([(2000, None), (2001, [0.0] * 16), (2002, [1.0]), (2003, [None] * 16)], "doc long, vector array<float>"))
    queries = vectors.select(F.col("doc").alias("query"), F.col("vector").alias("query_vector")).where("query % 10 = 0 OR query > 1990")
    near = lambda block: tops(ranking.dense(vectors, queries, "doc", "query", 5, block=block).withColumn("score", F.coalesce("score", F.lit(-9.0))))
    assert near(4096) == near(7)
    sims = lambda block: tops(ranking.max_sim(docs, asked(docs, 20), "doc", "query", 5, block=block))
    assert sims(512) == sims(6)
    assert ranking.dense(vectors, queries.where("false"), "doc", "query").collect() == []
