"""Plans whose tasks grow no faster than their input, with results that stay the same."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quadrille import queries, training, units
from quadrille.plans.compiler import CubeContext, compile
from quadrille.retrieval import lateindex, ranking
from quadrille.retrieval.textindex import TextIndex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_edges_are_those_of_ascii(spark, tmp_path):
    """A letter beyond ASCII ends a word, as in RE2."""
    texts = ["öin in", "inä", "xin in_ In", "", None, "in", "9in,in"]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [r.n for r in queries.QUERIES["pattern_counts"](spark, str(tmp_path)).orderBy("conv_id").collect()]
    assert got == [2, 1, 1, 0, None, 1, 1]


def test_observations_are_not_dealt_by_measure(spark):
    """Multipliers are broadcast, whatever is known of their size."""
    facts = spark.createDataFrame([("a", "COUNT", "x", 10.0)], "node_id string, unit string, unit_string string, multiplier double")
    df = units.scaled(spark.range(100).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("Measure"), F.col("id").cast("double").alias("Value")), facts)
    assert "SortMergeJoin" not in plan(df) and "BroadcastHashJoin" in plan(df)
    assert df.agg(F.sum("Value")).first()[0] == sum(10 * i if i % 2 == 0 else i for i in range(100))


def test_the_best_label_needs_no_sort_of_all_rows(spark):
    rows = [("x", "k", 1.0, 5.0), ("x", "k", 5.0, 2.0), ("y", "k", 3.0, None), ("y", "l", None, None)]
    cube = spark.createDataFrame(rows, "g string, h string, a double, b double")
    got = {}
    for f in ("MAX", "MIN"):
        df = compile(f"({f} () (VALUE T (MSR (a b)) (DIM g (x y)) (DIM h (k l))))", CubeContext(spark, "", {"T": cube}), "native")
        got[f] = sorted(tuple(r[c] for c in ("g", "h", "label", "Value")) for r in df.collect())
        first = plan(df)[plan(df).index("Exchange") :]
        assert "HashAggregate" in plan(df) and "SortAggregate" in plan(df)  # the latter of one row for each label
        assert first.rindex("HashAggregate") > first.rfind("SortAggregate")
    assert got == {"MAX": [("x", "k", "a", 5.0), ("y", "k", "a", 3.0)], "MIN": [("x", "k", "a", 1.0), ("y", "k", "a", 3.0)]}


def test_terms_are_counted_in_their_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "", "b", None]), (2, []), (3, ["x"])], "id long, t array<string>")
    got = {r.id: [tuple(x) for x in r.c] for r in df.select("id", ranking.counted(F.col("t")).alias("c")).collect()}
    assert got == {1: [("", 1), ("a", 1), ("b", 3)], 2: [], 3: [("x", 1)]}


def test_bm25_shuffles_documents_once(spark):
    """Of what has a row for each term or pair, nothing is shuffled but sums and first k."""
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i % 3} a") for i in range(300)], "doc long, t string")
    asked = spark.createDataFrame([(q, f"a b{q}") for q in range(5)], "q long, u string")
    df = ranking.bm25(docs, asked, "doc", "q", F.split("t", " "), F.split("u", " "), 3)
    rows = df.collect()
    assert len(rows) == 15 and all(r.doc == r.q + 7 * (r["rank"] - 1) for r in rows)
    dealt = [line for line in plan(df).splitlines() if "Exchange hashpartitioning(" in line]
    assert any("REPARTITION_BY_NUM" in line for line in dealt)
    assert not any("doc#" in line and "REPARTITION_BY_NUM" not in line for line in dealt)


def test_positives_by_a_condition_are_those_of_a_table(spark):
    scores = spark.createDataFrame([(q, i, float(i * 7 % 11)) for q in range(4) for i in range(11)], "q long, i long, score double")
    table = scores.where("i % 3 = q % 3").select("q", "i")
    got = [sorted(map(tuple, training.hard_negatives(scores, p, "q", "i", 4).collect())) for p in (table, F.expr("i % 3 = q % 3"))]
    assert got[0] == got[1] and len(got[0]) == 16


def test_a_graph_is_written_in_parts_and_read_at_its_weight(spark, tmp_path, monkeypatch):
    """One subject of many triples is several files, and files count as what they are in memory."""
    from quadrille.plans import patterns

    monkeypatch.setattr(patterns, "TRIPLES", 100)
    rows = spark.range(1000).select(F.lit("http://x/t").alias("s"), F.lit("http://x/p").alias("p"), F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("o"))
    g = patterns.Graph(rows).write(f"{tmp_path}/g")
    assert g.triples.count() == 1000 and g.counts == {"http://x/p": 1000}
    assert len(g.triples.inputFiles()) >= 8
    assert float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) >= 40


def test_an_index_is_built_and_searched_where_a_document_lies(spark, tmp_path):
    """All postings of a document are in one part, and no pair of query and document is shuffled."""
    docs = spark.createDataFrame([(i, " ".join(["a", f"b{i % 7}", f"c{i % 50}"] * (1 + i % 3)) if i else None) for i in range(3000)], "d long, t string")
    asked = spark.createDataFrame([(q, f"a b{q} c3 none") for q in range(5)], "q long, u string")
    words, own = F.split("t", " "), F.split("u", " ")
    index = TextIndex.build(docs, "d", words, f"{tmp_path}/x")
    each = index.table("postings").select("parts", "part", F.explode("docs.doc").alias("doc"))
    assert each.distinct().count() == each.select("doc").distinct().count()
    df = index.search(asked, "q", own, 4)
    shown = lambda df: sorted((r.q, r["rank"], r.doc, round(r.score, 6)) for r in df.collect())
    assert shown(df) == shown(ranking.bm25(docs, asked, "d", "q", words, own, 4).withColumnRenamed("d", "doc"))
    assert not any("Exchange" in line and "doc#" in line for line in plan(df).splitlines())


def test_scores_of_a_block_are_made_some_at_once(spark, tmp_path, monkeypatch):
    """A task's memory is bounded whatever the number of a block's queries."""
    caught = []
    catch = lambda rows, queries, run, schema, *_: caught.append(run) or spark.createDataFrame([], schema)
    rnd = np.random.default_rng(3)
    numbers = lambda n: rnd.normal(0, 1, (n, 8)).tolist()
    docs = spark.createDataFrame([(i, numbers(5)) for i in range(40)], "doc long, doc_tokens array<array<float>>")
    index = lateindex.LateIndex.build(docs, "doc", "doc_tokens", f"{tmp_path}/x", bits=8)
    codes = index.documents.select("doc", "at", "codes", "errors").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(ranking, "met", catch)
    monkeypatch.setattr(lateindex, "met", catch)
    monkeypatch.setattr(lateindex, "kept", lambda df, name: df)
    rows = spark.createDataFrame([(1, [1.0], 1)], "i long, vector array<float>, g long")
    training.cosine_negatives(rows, rows.toDF("q", "query_vector", "g"), "q", "i", "g", 5)
    index.within(docs.toDF("q", "t"), "q", "t", 5)
    index.within(docs.toDF("q", "t"), "q", "t", 5, most=7)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2048)), pa.array(numbers(2048), pa.list_(pa.float32())), pa.array([i % 10 for i in range(2048)])], names=["i", "vector", "g"])
    many = pa.Table.from_batches([codes] * 51).combine_chunks().to_batches()[0]
    asked = [(q, x, q % 10) for q, x in enumerate(numbers(2000))], [(q, numbers(5)) for q in range(500)]
    for run, part, given in ((caught[0], asked[0], batch), (caught[1], asked[1], many), (caught[2], asked[1], many)):
        tracemalloc.start()
        made = run(part, given)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made.num_rows and peak < 90e6, peak
