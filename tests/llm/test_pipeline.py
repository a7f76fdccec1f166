"""The pipeline's stages against the rules that they apply, on the smallest tables."""

import re

import corpus_pipeline
import duckdb
from quadrille.llm import decontaminate, packing, secrets, toxicity
from quadrille.llm.common import materialise

SF = "/root/testdata/sf0.001"


def kept_of_near_copies(texts, width=5, least=0.8):
    """The smallest id of each group of texts linked by Jaccard similarity, by brute force over all pairs."""
    sets = {}
    for i, text in texts.items():
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * max(1, len(sets[i] | sets[j]))):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i for i in sets if low[i] == i}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == columns
        seen[name] = (docs, out)
        docs = out
    before, after = seen["toxicity"]
    scores = toxicity.scored(before, toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert {r.doc_id for r in scores if r.score < 0.5} == {r.doc_id for r in after.collect()}
    before, after = seen["simhash"]
    assert sorted(kept_of_near_copies({r.doc_id: r.text for r in before.collect()})) == sorted(r.doc_id for r in after.collect())
    before, after = seen["decontaminate"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    duck = duckdb.connect()
    duck.register("documents", before.select("doc_id", "text").toPandas())
    duck.register("benchmark", bench.toPandas())
    verdict = duck.sql(f"SELECT doc_id FROM ({decontaminate.OP1_SQL}) WHERE NOT contaminated").fetchall()
    assert {i for (i,) in verdict} == {r.doc_id for r in after.collect()}
    before, after = seen["secrets"]
    texts = {r.doc_id: r.text for r in before.collect()}
    grammar = secrets.learn(secrets.labelled_credentials())
    found = {r.doc_id: r.spans for r in secrets.scan(before, grammar).collect()}
    plain = [(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", 2), ("AKIA[A-Z0-9]{12,}", 0), ("(?<![0-9a-f])[0-9a-f]{32,}", 0)]
    for r in after.collect():
        assert not any(len(m[g]) for p, g in plain for m in re.finditer(p, r.text or "") if "SECRET" not in m[0])
        assert (r.text == texts[r.doc_id]) == (not found[r.doc_id])
        assert r.n_chars == len(r.text) or not found[r.doc_id]
    before, after = seen["packing"]
    rows, lengths = after.collect(), sorted(len((t.text or "").encode()) + 1 for t in before.collect())
    assert sorted(r.n_tokens for r in rows) == lengths
    best = {0: 0}
    for _ in range(packing.BUCKETS):  # the least padding of the first j rows in one bucket more
        best = {j: min([best[j]] * (j in best) + [p + lengths[j - 1] * (j - i) - sum(lengths[i:j]) for i, p in best.items() if i < j]) for j in range(len(lengths) + 1)} | {0: 0} if len(best) > 1 else {0: 0} | {j: lengths[j - 1] * j - sum(lengths[:j]) for j in range(1, len(lengths) + 1)}
    assert sum(r.boundary - r.n_tokens for r in rows) == best[len(lengths)]


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "bucket", "boundary", "batch", "slot"]


def test_stages_with_odd_rows_and_clashing_columns(spark):
    """Nulls in any column, empty texts, repeated rows, and columns named as stages name theirs: only the rules decide."""
    text = "plain words about rivers and bridges near the old town hall"
    rows = [(1, text, None, "s"), (2, text, "en", None), (2, text, "en", None), (3, None, None, None), (4, "", "en", "s"), (None, "a null id", "en", "s"), (5, 'token = "aB3dE6gH9jK2mN5p"', "en", "s")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.1, "x", ["y"], 7, None, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _score double, spans string, base array<string>, fp long, _text string, Component_ID string")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    assert len(kept["toxicity"]) == 7
    assert sorted(str(r.doc_id) for r in kept["simhash"]) == ["1", "3", "5", "None"]  # 3 and 4 both have no words
    by_id = {r.doc_id: r for r in kept["secrets"]}
    assert by_id[5].text == '[SECRET]"' and by_id[5].n_chars == 9 and by_id[3].text is None and by_id[5].spans == "x"
    assert len(kept["packing"]) == 4


def test_stages_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_each_rows_own_text_decides_contamination(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first().text
    clean = "plain words about rivers and bridges near the old town hall"
    docs = spark.createDataFrame([(None, item), (None, clean), (7, item), (7, clean), (8, None)], "doc_id long, text string")
    got = corpus_pipeline.decontaminate_stage(spark, docs, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(None, clean), (7, clean), (8, None)], "doc_id long, text string").collect()))
