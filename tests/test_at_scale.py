"""Quantiles, random draws and the kept text index: what holds where a group, a pool or a term is large."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import training
from quadrille.functions import text
from quadrille.operators import quantiles as q
from quadrille.retrieval import ranking, textindex
from quadrille.retrieval.textindex import TextIndex


def values(spark, seed):
    rnd = np.random.default_rng(seed)
    rows = [("many", float(x)) for x in rnd.normal(0, 1e6, 9000)] + [("ties", float(x)) for x in rnd.integers(0, 3, 5000)] + [("wide", float(x)) for x in np.exp(rnd.normal(0, 60, 4000))]
    rows += [("two", x) for x in [1.0] * 3000 + [2.0] * 3000] + [("one", 5.0), ("none", None), ("ends", float("-inf")), ("ends", float("inf")), ("ends", 0.0), (None, 1.0), (None, 3.0)]
    return spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.mark.parametrize("gathered", [5, 1000])
def test_quantiles_are_exact(spark, monkeypatch, gathered):
    """More distinct values than are ever gathered, ties across a rank, values of all sizes."""
    monkeypatch.setattr(q, "GATHERED", gathered)
    df = values(spark, gathered)
    shares = [0.0, 0.25, 0.5, 0.999, 1.0]
    want = {(r.g, i): x for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect() for i, x in enumerate(r.p or [None] * 5)}
    got = q.quantiles(df, ["g"], F.col("v"), shares, list("abcde")).collect()
    for r in got:
        if r.g is None:
            continue  # keys are joined, so rows of a null key have nulls
        for i, name in enumerate("abcde"):
            x, y = r[name], want[r.g, i]
            assert x == y or abs(x - y) <= 1e-9 * abs(y), (r.g, name, x, y)
    one = q.quantiles(df.where("g = 'many'"), [], F.col("v"), [0.5], ["m"]).first().m
    assert one == want["many", 2]
    assert q.quantiles(df.where("false"), ["g"], F.col("v"), [0.5], ["m"]).collect() == []


def test_draws_are_uniform_and_end(spark):
    """Chi-square of 20,000 draws from 50 items, of which each query has some of its own; and queries with few items left."""
    pool = spark.range(50).select(F.col("id").alias("i"))
    queries = spark.range(4000).select(F.col("id").alias("q"))
    taken = queries.select("q", F.explode(F.array(F.lit(3).cast("long"), F.col("q") % 50)).alias("i"))
    got = training.drawn(queries, pool, taken, "q", "i", 5)
    assert got.count() == 20_000 == got.select("q", "i").distinct().count()
    assert got.join(taken, ["q", "i"]).isEmpty()
    counts = {r.i: r["count"] for r in got.groupBy("i").count().collect()}
    assert 3 not in counts
    mean = 20_000 / 49
    assert sum((counts[i] - mean) ** 2 / mean for i in range(50) if i != 3) < 90  # 48 degrees of freedom
    few = training.drawn(queries.where("q < 3"), pool.where("i < 6"), taken, "q", "i", 5)
    left = {k: {i for i in range(6)} - {3, k} for k in range(3)}
    assert {k: {r.i for r in few.collect() if r.q == k} for k in range(3)} == left
    assert training.drawn(queries.where("q < 3"), pool.where("false"), taken, "q", "i", 5).collect() == []


def corpus(spark, seed, n=400):
    rnd = random.Random(seed)
    word = lambda: "the" if rnd.random() < 0.3 else f"w{int(rnd.paretovariate(0.7)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 60))), rnd.choice(["a", "b"])) for i in range(n)] + [(n, None, "a"), (n + 1, "the", None), (n + 2, "", "b")]
    asked = [(k, " ".join(["the", *(f"w{rnd.randint(1, 120)}" for _ in range(4))])) for k in range(25)] + [(98, "nothing here"), (99, None)]
    return spark.createDataFrame(docs, "d long, text string, kind string").repartition(4), spark.createDataFrame(asked, "q long, t string")


@pytest.mark.parametrize("kinds", [False, True])
def test_text_index_gives_what_the_scan_gives(spark, tmp_path, monkeypatch, kinds):
    monkeypatch.setattr(textindex, "BLOCK", 16)
    docs, asked = corpus(spark, 1)
    kind = F.col("kind") if kinds else None
    index = TextIndex.build(docs.where("d % 3 <> 0"), "d", text.tokens(F.col("text")), f"{tmp_path}/x", kind).add(docs.where("d % 3 = 0"), "d", text.tokens(F.col("text")), kind)
    shown = lambda df, names: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())
    for k in (1, 4):
        got = index.search(asked, "q", text.tokens(F.col("t")), k)
        want = ranking.bm25(docs, asked, "d", "q", text.tokens(F.col("text")), text.tokens(F.col("t")), k, kind="kind" if kinds else None)
        names = (["kind"] if kinds else []) + ["q", "doc", "score", "rank"]
        assert shown(got, names) == shown(want.withColumnRenamed("d", "doc"), names)
    blocks = index.table("postings").join(asked.select("q", F.explode(F.array_distinct(text.tokens(F.col("t")))).alias("term")), "term")
    read = index.read(asked, "q", text.tokens(F.col("t")), 1)
    assert read.count() < 0.8 * blocks.count()
    assert index.table("postings").agg(F.max("n")).first()[0] < 8 * textindex.BLOCK


def test_text_index_of_nothing(spark, tmp_path):
    docs, asked = corpus(spark, 2)
    words = text.tokens(F.col("text"))
    empty = TextIndex.build(docs.where("false"), "d", words, f"{tmp_path}/x")
    assert empty.search(asked, "q", text.tokens(F.col("t"))).collect() == []
    assert empty.add(docs, "d", words).search(asked.where("false"), "q", text.tokens(F.col("t"))).collect() == []
    assert empty.search(asked, "q", text.tokens(F.col("t")), 1).count() == 25


def test_filters_go_to_the_service(spark):
    """A plain where() is seen in the requests; what the service can't do stays with Spark; long lists are several requests."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import unquote

    from quadrille.sources import service

    asked, rows = [], [{"g": g, "Measure": m, "Value": v} for m in ("m1", "m2") for g, v in (("a", 1.0), ("b", 2.5), ("ab", 9.0), (None, 4.0))]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(unquote(self.path))
            own = [r for r in rows if f"'{r['Measure']}'" in asked[-1]]
            body = json.dumps({"value": own}).encode()  # filters but the measure's are ignored, so that Spark must hold them
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v4"
    df = service.service(spark, base, "T1", ["m1", "m2"], {"g": []})
    got = df.where("g IN ('a', 'b') AND Value > 2 AND Measure = 'm2' AND length(g) = 1").collect()
    assert [tuple(r) for r in got] == [("b", "m2", 2.5)]
    assert len(asked) == 1 and "g in ('a', 'b')" in asked[0] and "Value gt 2" in asked[0] and "'m1'" not in asked[0] and "length" not in asked[0]
    asked.clear()
    assert df.where("Measure = 'none'").collect() == [] and asked == []
    three = service.urls({"base": base, "table": "T", "version": 3, "dims": {"g": ["x"]}, "measures": ["m"]}, ["substringof('y',g)"])
    assert "substringof('x',g)) and substringof('y',g)" in unquote(three[0])
    assert len(service.urls({"base": base, "table": "T", "version": 4, "dims": {"g": [str(i) for i in range(250)]}, "measures": ["m", "n"]})) == 6
    server.shutdown()


def test_pivots_keep_their_codes(spark):
    """Codes with the separator in them, through a join, a rename and another column's aggregate."""
    from quadrille.operators import reshape

    df = spark.createDataFrame([("i", "a_b", "long_2021", 1.0), ("i", "c", "x", 2.0)], "k string, g string, h string, Value double")
    wide = reshape.pivot(df, ["k"], [("g", ["a_b", "c"]), ("h", ["long_2021", "x"])], F.sum)
    both = reshape.full_align([wide, reshape.pivot(df, ["k"], [("g", ["c"])], F.max)], ["k"]).withColumnRenamed("a_b_long_2021", "first")
    found = reshape.levels(both)
    assert found["first"] == [("g", "a_b"), ("h", "long_2021")] and found["c_x"] == [("g", "c"), ("h", "x")] and found["c"] == [("g", "c")] and found["k"] == []
    assert reshape.presented(wide, {"a_b": "A", "long_2021": "2021", "k": "Key"}).columns == ["A_2021", "Key", "c_x"]
