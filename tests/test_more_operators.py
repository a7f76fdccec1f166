"""Sources, sinks, answers and rankings that no query over the driver's tables can show."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import catalog, training
from quadrille.functions import text
from quadrille.metrics import answers, evaluation
from quadrille.operators import probing, reshape
from quadrille.retrieval import ranking
from quadrille.sources import service, tables, turtle

TURTLE = """@prefix ex: <http://e.org/> . @base <http://b.org/x> .
ex:a a ex:T ; ex:p "v"@en, 'w'^^ex:d, 1, 2.5, 1e3, true ; ex:q [ ex:r <rel> ] , ( 1 "two" ) ; .
PREFIX z: <http://z/>
z:g { z:s z:p \"\"\"long "quoted" \\n text\"\"\" . z:s z:p2 z:o }  # a comment
GRAPH <http://g> { _:b1 z:p _:b2 }
[] z:p 'x' .
"""


def test_turtle(spark, tmp_path):
    rows = turtle.parse(TURTLE)
    literals = {(r[2], r[5], r[6]) for r in rows if r[0] == "http://e.org/a" and r[1] == "http://e.org/p"}
    xsd = turtle.XSD
    assert literals == {("v", None, "en"), ("w", "http://e.org/d", None), ("1", xsd + "integer", None), ("2.5", xsd + "decimal", None), ("1e3", xsd + "double", None), ("true", xsd + "boolean", None)}
    assert ("http://z/s", "http://z/p", 'long "quoted" \n text', "http://z/g", True, None, None) in rows
    assert ("_:b1", "http://z/p", "_:b2", "http://g", False, None, None) in rows
    assert sum(r[1] == turtle.RDF + "first" for r in rows) == 2 and any(r[2] == "http://b.org/rel" for r in rows) and len(rows) == 18
    for bad in ("<a> <b> .", "ex:a ex:b ex:c .", "<a> <b> <c>", "<a> <b> \"open ."):
        with pytest.raises(SyntaxError):
            turtle.parse(bad)
    for name in "ab":
        (tmp_path / f"{name}.trig").write_text(TURTLE)
    found = turtle.graph(spark, str(tmp_path))
    assert found.count() == 36 and found.where("s LIKE '_:%b1'").select("s").distinct().count() == 2
    assert found.where("o_is_literal").count() == 20


def test_triples_and_summary_sinks(spark, tmp_path):
    tables.write_triples(spark.createDataFrame([("q1", "p1", "n1"), ("q2", "p2", "n2")], "q string, p string, n string"), str(tmp_path / "t"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sorted(lines) == [["q1", "p1", "n1"], ["q2", "p2", "n2"]]
    tables.write_summary(spark.createDataFrame([("b", 2), ("a", 1)], "k string, v long"), str(tmp_path / "s"), ["k"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == [("a", "1"), ("b", "2")]


def test_cached(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    path = str(tmp_path / "c")
    assert catalog.cached(spark, path, build).count() == 3 and catalog.cached(spark, path, build).count() == 3 and made == [1]


def test_sparql(spark):
    asked = []

    class Endpoint(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = json.dumps({"head": {"vars": ["s", "l"]}, "results": {"bindings": [{"s": {"value": "x"}, "l": {"value": "X"}}, {"s": {"value": "y"}}]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    found = service.sparql(spark, f"http://127.0.0.1:{server.server_port}/q", "SELECT ?s ?l WHERE { ?s ?p ?l }")
    assert sorted(map(tuple, found.collect())) == [("x", "X"), ("y", None)] and "SELECT+%3Fs" in asked[0]
    with pytest.raises(PermissionError):
        service.sparql(spark, f"http://127.0.0.1:{server.server_port}/q", "SELECT", trusted=("example.org",))
    server.shutdown()


@pytest.mark.parametrize("keep_empty", [False, True])
@pytest.mark.parametrize("f", [F.sum, F.avg, F.max, F.min])
def test_wide_pivots_equal_narrow_ones(spark, monkeypatch, f, keep_empty):
    rnd = random.Random(6)
    rows = [(rnd.choice(["i", "j", None]), rnd.choice("abcx"), rnd.choice(["p", "q", None]), rnd.choice([1.0, 2.5, None])) for _ in range(200)] + [("only", "zz", "p", 1.0)]
    df = spark.createDataFrame(rows, "i string, k string, l string, Value double")
    made = []
    for most in (16, 0):
        monkeypatch.setattr(reshape, "ONE_PASS", most)
        made.append(sorted(map(str, reshape.pivot(df, ["i"], [("k", "abc"), ("l", "pq")], f, keep_empty=keep_empty).collect())))
    assert made[0] == made[1]
    with pytest.raises(ValueError):
        reshape.pivot(df, ["i"], [("k", map(str, range(101))), ("l", map(str, range(100)))])


def test_answers_as_shown(spark):
    assert reshape.code_levels(["T001047_2021JJ00", "A_b", "x_1_long"]) == [("T001047", "2021JJ00"), ("A_b",), ("x_1", "long")]
    df = spark.createDataFrame([("a", "m", 1.0), ("b", "n", None)], "g string, Measure string, Value double")
    assert reshape.markdown(df.orderBy("g")) == "| g | Measure | Value |\n| --- | --- | --- |\n| a | m | 1.0 |\n| b | n |  |"
    assert reshape.indexed(df, ["g"]).columns == ["g", "Measure", "Value"]
    only = reshape.indexed(df, ["m"])
    assert only.columns == ["Measure", "g", "Value"] and only.count() == 1
    assert reshape.indexed(df, ["nothing"]).count() == 2
    assert reshape.sorted_columns(df).columns == ["Measure", "Value", "g"]


@pytest.mark.parametrize(
    ("truth", "predicted", "score"),
    [
        ([(1, 3), (2, 4)], [(1, 3), (2, 4)], 1.0),
        ([(1, 3), (2, 4)], [(5, 7), (6, 8)], 0.0),
        ([(1, 4), (2, 5), (3, 6)], [(1, 4)], 1 / 3),
        ([(1, 3), (2, 4)], [(4, 2), (3, 1)], 1.0),
        ([(1, 3), (None, 4)], [(1, 3), (4, None)], 1.0),
        ([(1, 4), (2, 5), (3, 6)], [(1, 2, 3), (4, 5, 6)], 1.0),
        ([(1, 3), (2, 4)], [(1, 2), (3, 4)], 0.0),
        ([(1, 3), (1, 3), (2, 4)], [(1, 3), (2, 4)], 2 / 3),
        ([(1, 3), (2, 4)], [(1, 3), (2, 4), (9, 9)], 1.0),
        ([], [(1, 2)], 0.0),
        ([(1, 2)], [], 0.0),
        ([], [], 1.0),
    ],
)
def test_record_accuracy(spark, truth, predicted, score):
    made = [spark.createDataFrame(rows, ", ".join(f"c{i} long" for i in range(len(rows[0]) if rows else 2))) for rows in (truth, predicted)]
    assert answers.record_accuracy(*made).first()["score"] == pytest.approx(score)


def test_dense_search_equals_brute_force(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(90, 5))
    v[7] = 0
    v[11:15] = v[10]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, vector array<double>").repartition(4)
    asked = df.where("i < 12").select(F.col("i").alias("q"), F.col("vector").alias("query_vector"))
    got = {(r.q, r["rank"]): (r.i, r.score) for r in ranking.dense(df, asked, "i", "q", 6, block=5).collect()}
    with np.errstate(invalid="ignore"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(12):
        s = [(-(u[q] @ x) if not np.isnan(u[q] @ x) else 9.0, i) for i, x in enumerate(u) if i != q] + [(9.0, 90), (9.0, 91)]
        for k, (score, i) in enumerate(sorted((round(a, 12), b) for a, b in s)[:6], 1):
            assert got[q, k][0] == i and (got[q, k][1] == pytest.approx(-score) if score < 9 else got[q, k][1] is None)
    assert ranking.dense(df, asked.where("false"), "i", "q").count() == 0


def test_max_sim_equals_brute_force(spark):
    rnd = np.random.default_rng(4)
    docs = [(i, rnd.normal(size=(rnd.integers(1, 5), 3)).tolist()) for i in range(30)] + [(30, []), (31, None)]
    df = spark.createDataFrame(docs, "d long, doc_tokens array<array<double>>").repartition(3)
    asked = df.where("d < 5").select(F.col("d").alias("q"), F.col("doc_tokens").alias("query_tokens"))
    got = {(r.q, r.d): r.score for r in ranking.max_sim(df, asked, "d", "q", None, block=2).collect()}
    assert len(got) == 5 * 32
    for (q, d), score in got.items():
        tokens = docs[d][1] or []
        assert score == pytest.approx(sum(max(np.dot(a, b) for b in tokens) for a in docs[q][1]) if tokens else 0.0)
    top = ranking.max_sim(df, asked, "d", "q", 3).collect()
    assert all(r.score == pytest.approx(sorted((s for (q, _), s in got.items() if q == r.q), reverse=True)[r["rank"] - 1]) for r in top) and len(top) == 15


def test_cosine_negatives_leave_out_near_duplicates(spark):
    rows = [(0, [1.0, 0.0], "a", "the body of it"), (1, [1.0, 0.1], "b", "the body of it"), (2, [1.0, 0.2], "b", "something else"), (3, [0.0, 1.0], "b", "far away"), (4, [0.9, 0.0], "a", "same group"), (5, [1.0, 0.3], None, "no group")]
    v = spark.createDataFrame(rows, "i long, vector array<double>, g string, body string")
    asked = v.where("i = 0").select(F.col("i").alias("q"), F.col("vector").alias("query_vector"), "g", "body")
    found = lambda body: sorted((r.kind, r.i) for r in training.cosine_negatives(v, asked, "q", "i", "g", 2, body).collect())
    assert found(None) == [("far", 3), ("near", 1)] and found("body") == [("far", 3), ("near", 2)]


def test_hard_negatives_are_padded(spark):
    scores = spark.createDataFrame([(1, i, float(-i)) for i in range(4)] + [(2, 0, 1.0)], "q long, i long, score double")
    positives = spark.createDataFrame([(1, 0), (2, 0), (2, 5)], "q long, i long")
    pool = spark.createDataFrame([(q, i) for q in (1, 2) for i in range(10)], "q long, i long")
    got = [(r.q, r.i, r["rank"]) for r in training.hard_negatives(scores, positives, "q", "i", 4, pool).orderBy("q", "rank").collect()]
    assert [x[1] for x in got if x[0] == 1][:3] == [1, 2, 3] and [x[2] for x in got] == [1, 2, 3, 4] * 2
    assert not {(q, i) for q, i, _ in got} & {(1, 0), (2, 0), (2, 5)} and len({(q, i) for q, i, _ in got}) == 8


def test_bm25_counts_all_documents_in_one_pass(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choices("ab cd ef gh ij".split(), k=rnd.randint(0, 9)))) for i in range(60)] + [(60, None), (61, "")]
    asked = [(1, "ab zz ab"), (2, "cd ef"), (3, ""), (4, None)]
    df, q = spark.createDataFrame(docs, "d long, text string").repartition(3), spark.createDataFrame(asked, "q long, t string")
    got = ranking.bm25(df, q, "d", "q", text.tokens(F.col("text")), text.tokens(F.col("t")), None)
    tokens = {i: (t or "").split() for i, t in docs}
    n, avgdl = len(docs), sum(map(len, tokens.values())) / len(docs)  # a null text is an empty one
    rows = {(r.q, r.d): r.score for r in got.collect()}
    for k, t in asked:
        words = {w for w in (t or "").split() if any(w in x for x in tokens.values())}
        for i, d in tokens.items():
            if not words & set(d):
                assert (k, i) not in rows
                continue
            df_ = {w: sum(w in x for x in tokens.values()) for w in words}
            want = sum(np.log((n + 1) / df_[w]) * (1 + 2.5 * d.count(w) / (1.5 * (0.25 + 0.75 * len(d) / avgdl) + d.count(w))) for w in words)
            assert rows[k, i] == pytest.approx(want, rel=1e-6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(_t") <= 6 or "Reused" in plan


def test_retrieved_variants(spark):
    asked = spark.createDataFrame([("q", "text")], "q string, question string")
    stage = lambda order: lambda a: a.join(spark.createDataFrame([("q", x, i, 1.0 / i) for i, x in enumerate(order, 1)], "q string, i string, rank long, score double"), "q").select("q", "i", "rank", "score")
    order = lambda **kw: [r.i for r in ranking.retrieved(asked, "q", "i", k=3, **kw).orderBy("rank").collect()]
    assert order(stages=[stage("abcd")]) == ["a", "b", "c"]
    assert order(stages=[stage("abcd"), stage("dcba")], pool=4)[0] in "ad"
    seen = []
    assert order(stages=[stage("abcd")], rewrite=lambda a: seen.append(1) or a) == ["a", "b", "c"] and seen
    more = lambda pool: ranking.with_escapes(pool.where("rank <= 2"), spark.createDataFrame([("q", "z", 2)], "q string, i string, n long"), "q", "i", 3)
    assert order(stages=[stage("abcd")], with_more=more) == ["a", "b", "z"]
    scorer = lambda prompts: prompts.select("q", F.lit("C\nA").alias("answer"))
    assert order(stages=[stage("abcd")], scorer=scorer, describe=F.lit("x")) == ["c", "a", "b"]
    assert [ranking.pool_size(10, m) for m in ("nodes", "all", "rerank", "tables")] == [2500, 2500, 50, 10]


def test_code_gate(spark):
    q = spark.createDataFrame([(1, "How many detached houses were there?")], "question_id long, q string")
    codes = spark.createDataFrame([("d", "A", "Detached houses"), ("d", "B", "Total"), ("e", "C", "detached barns"), ("f", "D", "unrelated")], "dimension string, code string, l string")
    found = lambda gate: {r.code for r in probing.ranked_codes(q, codes, F.col("q"), F.col("l"), 3, 0.0, gate).collect()}
    assert found(False) == {"A", "B", "C", "D"} and found(True) == {"A", "B", "C"}
    assert [(r.dimension, r.code) for r in probing.resolved_codes(q, codes, F.col("q"), F.col("l")).collect()] == [("d", "A")]


def test_failures_and_outcomes(spark):
    rows = [("a b".split(), "x y z".split(), "x y z".split()), ("a b".split(), "c d".split(), "e".split()), ("a b".split(), "a c".split(), "e".split())]
    df = spark.createDataFrame(rows, "q array<string>, g array<string>, t array<string>")
    assert sorted(r.label for r in evaluation.retrieval_failures(df, F.col("q"), F.col("g"), F.col("t")).collect()) == ["near_duplicate", "other", "vocab_gap"]
    made = evaluation.completed(spark.createDataFrame([("a",), ("b",), ("c",)], "question string"), spark.createDataFrame([("a", "S"), ("b", " ")], "question string, query string"))
    assert {r.question: r["query"] for r in made.collect()} == {"a": "S", "b": evaluation.PLACEHOLDER, "c": evaluation.PLACEHOLDER}


@pytest.mark.parametrize("aggregate", [F.count, F.sum, F.avg, F.max, F.collect_list, F.countDistinct, lambda c: F.coalesce(F.sum(c), F.lit(-1.0))])
@pytest.mark.parametrize("keep_empty", [False, True])
def test_pivot_is_the_same_above_and_below_its_switch(spark, monkeypatch, aggregate, keep_empty):
    """Sixteen codes in one pass, seventeen in two, and the same seventeen in one."""
    rows = [(i % 4, f"c{i % 23:02d}", None if i % 5 == 0 else float(i)) for i in range(150) if i % 23 not in (3, 16)] + [(9, "c99", 1.0), (8, "c01", None)]
    df = spark.createDataFrame(rows, "i int, code string, Value double")
    shown = lambda t, names: sorted(str([r[c] if not isinstance(r[c], list) else sorted(r[c]) for c in names]) for r in t.collect())
    codes = [f"c{i:02d}" for i in range(17)]
    two = reshape.pivot(df, ["i"], [("code", codes)], aggregate, keep_empty=keep_empty)
    monkeypatch.setattr(reshape, "ONE_PASS", 1000)
    one = reshape.pivot(df, ["i"], [("code", codes)], aggregate, keep_empty=keep_empty)
    few = reshape.pivot(df, ["i"], [("code", codes[:16])], aggregate, keep_empty=True)
    assert shown(two, two.columns) == shown(one, two.columns)
    assert [t for t in two.dtypes] == [t for t in one.dtypes]
    if keep_empty:
        assert shown(few, few.columns) == shown(two, few.columns)
