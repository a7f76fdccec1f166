import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille import catalog
from quadrille.functions import text
from quadrille.metrics import answers
from quadrille.operators import reshape
from quadrille.plans import sqltext
from quadrille.retrieval import ranking
from quadrille.sources import tables
from quadrille.streaming.windows import windowed_totals


def test_window_ratio():
    assert text.best_window_ratio("abc", "xxabcxx") == 100
    assert text.best_window_ratio("", "") == 100 and text.best_window_ratio("", "a") == 0
    assert text.best_window_ratio(None, "a") is None
    assert text._lcs("kitten", "sitting") == 4
    assert text.near_equal("a" * 100, "a" * 99 + "b") and not text.near_equal("abc", "xyz")


def test_rrf_golden(spark):
    lists = [spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, item string, rank long")] * 2
    got = {r["item"]: r["score"] for r in ranking.fuse(lists, "q", "item").collect()}
    assert got["a"] == pytest.approx(2 / 61) and got["b"] == pytest.approx(2 / 62)


def test_overlap_golden(spark):
    df = spark.createDataFrame([("q", "t", 8.0, ["births", "region"], ["births", "age"])], "q string, item string, score double, a array<string>, b array<string>")
    assert ranking.rerank_by_overlap(df, F.col("a"), F.col("b"), "q", "item", 2.0).first()["score"] == 9.0


def test_reranked_by_a_scorer(spark):
    pool = spark.createDataFrame([("q", x, i) for i, x in enumerate("abc", 1)], "q string, item string, rank long")
    scorer = lambda prompts: prompts.select("q", F.lit("1. C\n2. zzz\n3. a").alias("answer"))
    order = lambda df: [r["item"] for r in df.orderBy("rank").collect()]
    assert order(ranking.rerank(pool, "q", "item", F.lit(""), scorer, 3)) == ["c", "a", "b"]
    assert order(ranking.rerank(pool, "q", "item", F.lit(""), None, 3)) == ["a", "b", "c"]


def test_quantised(spark):
    df = spark.createDataFrame([([-1.0, -0.01, 0.0, 1.0],)], "v array<double>")
    assert df.select(ranking.quantised(F.col("v"), 1)).first()[0] == [0, 0, 1, 1]


def test_metrics(spark):
    a = spark.createDataFrame(pd.DataFrame({"x": [1.0, 2.0, 2.0], "y": ["a", "b", "b"]}))
    b = spark.createDataFrame(pd.DataFrame({"x": [2.0, 1.0], "y": ["b", "a"]}))
    assert answers.numeric_recall(a, b).first()[0] == pytest.approx(2 / 3)
    assert answers.record_accuracy(a, b).first()[0] == pytest.approx(2 / 3)
    assert answers.lenient_match(a, a.select("y", "x")).first()[0] == 1
    assert not answers.frames_equal(a, b).first()[0]
    empty = a.where("false")
    assert answers.numeric_recall(empty, a).first()[0] == 1 and answers.record_accuracy(empty, empty).first()[0] == 1


def test_sql_shim(spark, tmp_path):
    spark.createDataFrame([("a", "x", 1.0, 2.0), ("a", "y", 3.0, 4.0), ("b", "x", 5.0, None)], "d string, e string, m_1 double, m_2 double").write.parquet(str(tmp_path / "t.parquet"))
    sql = f"""SELECT * FROM (SELECT d, Measure, Value, e FROM (SELECT * FROM '{tmp_path}/t.parquet' WHERE "d" IN ('a', 'b'))
              UNPIVOT (Value FOR Measure IN ("m_1", "m_2"))) PIVOT (MAX(Value) FOR d IN ('a', 'b') e IN ('x'))"""
    rows = {r["Measure"]: (r["a_x"], r["b_x"]) for r in sqltext.run(spark, sql).collect()}
    assert rows == {"m_1": (1.0, 5.0), "m_2": (2.0, None)}
    assert sqltext.outcome(spark, "SELECT 1 AS \"a b\"") is None
    assert sqltext.outcome(spark, "SELEC 1").startswith("syntax")
    assert sqltext.outcome(spark, "SELECT * FROM '/nowhere/x.parquet'").startswith("missing")
    assert sqltext.outcome(spark, f"SELECT nothing FROM '{tmp_path}/t.parquet'").startswith("syntax")


def test_sql_components():
    truth = "SELECT a, SUM(b) FROM 'x.parquet' WHERE c > 3 AND d IN ('u') GROUP BY a ORDER BY a DESC"
    assert all(v == 1 for v in sqltext.component_scores(truth, truth).values())
    other = sqltext.component_scores(truth.replace("c > 3", "c > 4"), truth)
    assert other["where_f1"] == 0 and other["select_f1"] == 1
    assert sqltext.components("SELECT * FROM t PIVOT (SUM(v) FOR p IN ('1'))").pivot == {("identity", "v", "p", frozenset({"1"}))}
    assert sqltext.in_lists(truth) == {"d": ["u"]}
    assert sqltext.same_text("select  a from t;", "SELECT a\nFROM t")
    assert sqltext.question_type("(SUM () (JOIN (g) x y))") == "AGGJOIN"
    assert sqltext.question_type("SELECT 100*a/b FROM t") == "PROP"


def test_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "q", "sql": "s"}\n')
    assert tables.questions(spark, str(tmp_path / "q.jsonl")).first().asDict() == {"question": "q", "sexp": None, "sql": "s", "simplified_sql": None}
    (tmp_path / "g.nq").write_text('<s> <p> "a \\"b\\""@en <g> .\n<s> <p> <o> .\n<s> <p> "1"^^<int> <g> .\nbroken\n')
    rows = {(r.o, r.o_is_literal, r.o_lang, r.o_datatype, r.g) for r in tables.quads(spark, str(tmp_path / "g.nq")).collect()}
    assert rows == {('a "b"', True, "en", None, "g"), ("o", False, None, None, None), ("1", True, None, "int", "g")}
    docs = spark.createDataFrame([(1, "a\tb")], "pid long, body string")
    tables.write_collection(docs, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), sep="\t").first()[1] == "a b"
    assert tables.measure_columns(spark.createDataFrame([(1, 2)], "GDP_1 int, region int")) == ["GDP_1"]


def test_reshape(spark):
    df = spark.createDataFrame([("a", None, 1.0)], "k string, e string, m_1 double")
    assert reshape.without_empty_columns(df).columns == ["k", "m_1"]
    assert reshape.without_repeated_columns(["k", "k_1", "m_1"]) == ["k", "m_1"]
    left, right = spark.createDataFrame([("a", 1)], "k string, x int"), spark.createDataFrame([("b", 2)], "k string, y int")
    assert sorted(tuple(r) for r in reshape.full_align([left, right], ["k"]).collect()) == [("a", 1, None), ("b", None, 2)]


def test_translated(spark):
    labels = spark.createDataFrame([("LG12  ", "North")], "node_id string, label string")
    df = spark.createDataFrame([("LG12",), ("XX",)], "g string")
    assert sorted(r[0] for r in catalog.translated(df, "g", labels).collect()) == ["North", "XX"]


def test_windows_on_a_stream(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    want = windowed_totals(batch, "ts", ["event_type"], ["value"], "1 day")
    q = windowed_totals(stream, "ts", ["event_type"], ["value"], "1 day").writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.window_start, r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("totals")) == key(want)
