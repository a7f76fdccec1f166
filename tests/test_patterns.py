"""Graph patterns against a naive evaluation, and the catalog out of the graph and back."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from quadrille import cubegraph
from quadrille.catalog import Catalog
from quadrille.cubegraph import GEO, TIME, Namespaces, catalog_of, exploded, refreshed, table_graph, triples_of
from quadrille.plans.patterns import Graph, Solutions, iri, literal, term, text_of

NS = Namespaces("http://x/table#", "http://x/measure#", "http://x/dim#", "http://x/concept#")


def graph_of(spark, triples, counts=False):
    df = spark.createDataFrame(sorted(triples), "s string, p string, o string")
    return Graph(df, dict(df.groupBy("p").count().collect()) if counts else None)


def naive(triples, pattern):
    """Solutions as dicts, by trying every triple for every pattern."""
    found = [{}]
    for want in pattern:
        step = []
        for sol, t in product(found, triples):
            new = dict(sol)
            if all((new.setdefault(w[1:], x) == x) if isinstance(w, str) and w.startswith("?") else x in ([w] if isinstance(w, str) else w) for w, x in zip(want, t, strict=True)):
                step.append(new)
        found = step
    return found


def agree(a, b):
    return all(a.get(k) is None or b.get(k) is None or a[k] == b[k] for k in set(a) & set(b))


def shown(solutions):
    return sorted(sorted((k, v) for k, v in (s if isinstance(s, dict) else s.asDict()).items() if v is not None) for s in solutions)


@pytest.mark.parametrize(("seed", "counts"), [(0, False), (1, True), (2, True)])
def test_patterns_give_what_trying_everything_gives(spark, seed, counts):
    rnd = random.Random(seed)
    triples = {(rnd.choice("abcdef"), rnd.choice("pqr"), rnd.choice(["a", "b", "c", "d", '"a"', '"b"@en'])) for _ in range(40)}
    g = graph_of(spark, triples, counts)
    two = [("?x", "p", "?y"), ("?y", "q", "?z")]
    assert shown(g.match(*two).rows.collect()) == shown(naive(triples, two))
    three = [("?x", ("p", "q"), "?y"), ("?x", "r", "?z"), ("?z", "?w", "?y")]
    assert shown(g.match(*three).rows.collect()) == shown(naive(triples, three))
    assert shown(g.match(("?x", "?p", "?x")).rows.collect()) == shown(naive(triples, [("?x", "?p", "?x")]))
    left, right, third = naive(triples, [("?x", "p", "?y")]), naive(triples, [("?x", "q", "?z")]), naive(triples, [("?z", "r", "?y")])
    base, more = g.match(("?x", "p", "?y")), g.match(("?x", "q", "?z"))
    outer = [{**a, **b} for a in left for b in ([b for b in right if agree(a, b)] or [{}])]
    assert shown(base.optional(more).rows.collect()) == shown(outer)
    assert shown(base.exists(more).rows.collect()) == shown([a for a in left if any(agree(a, b) for b in right)])
    assert shown(base.not_exists(more).rows.collect()) == shown([a for a in left if not any(agree(a, b) for b in right)])
    held = lambda a, b: any(agree({**a, **b}, c) for c in third)
    inner = [{**a, **b} for a in left for b in ([b for b in right if agree(a, b) and held(a, b)] or [{}])]
    assert shown(base.optional(more, exists=[g.match(("?z", "r", "?y"))]).rows.collect()) == shown(inner)
    none = [{**a, **b} for a in left for b in ([b for b in right if agree(a, b) and not held(a, b)] or [{}])]
    assert shown(base.optional(more, not_exists=[g.match(("?z", "r", "?y"))]).rows.collect()) == shown(none)
    assert shown(base.union(more).rows.collect()) == shown(left + right)
    # a variable that an OPTIONAL may have left unbound fits anything
    again = naive(triples, [("?x", "r", "?z")])
    assert shown(base.optional(more).join(g.match(("?x", "r", "?z"))).rows.collect()) == shown([{**a, **b} for a in outer for b in again if agree(a, b)])
    assert shown(base.values("?y", ["a", literal("a")]).rows.collect()) == shown([a for a in left if a["y"] in ("a", '"a"')])


def test_terms_and_templates(spark):
    row = lambda o, lit, dt=None, lang=None: (o, lit, dt, lang)
    df = spark.createDataFrame([row("http://x", False), row("http://x", True), row('a "b"\n', True, "http://int"), row("c", True, None, "en")], "o string, l boolean, d string, g string")
    terms = df.select(term(F.col("o"), F.col("l"), F.col("d"), F.col("g")).alias("t"))
    assert [r.t for r in terms.collect()] == ["http://x", '"http://x"', '"a "b"\n"^^http://int', '"c"@en']
    assert [r[0] for r in terms.select(text_of(F.col("t"))).collect()] == ["http://x", "http://x", 'a "b"\n', "c"]
    assert iri("rdf:type").endswith("#type") and iri("qb:measure").startswith("http://purl.org") and iri("http://x") == "http://x"
    found = Solutions(spark.createDataFrame([("x", '"l"', None), ("x", '"l"', None)], "a string, b string, c string"), frozenset("ab"))
    assert sorted(map(tuple, found.construct(("?a", "qb:measure", "?b"), ("?b", "p", "?a"), ("?a", "p", "?c")).collect())) == [("x", iri("qb:measure"), '"l"')]


def test_products_are_refused(spark):
    g = graph_of(spark, {("a", "p", "b")})
    with pytest.raises(ValueError, match="shares no variable"):
        g.match(("?x", "p", "?y"), ("?z", "p", "?w"))
    with pytest.raises(ValueError, match="share no variable"):
        g.match(("?x", "p", "?y")).join(g.match(("?z", "p", "?w")))
    with pytest.raises(ValueError):
        g.match()


def test_layout_reads_only_the_predicates_that_are_asked_for(spark, tmp_path):
    rows = {(f"s{i}", f"http://p/{i % 3}#x", f'"{i}"') for i in range(90)}
    g = graph_of(spark, rows).write(f"{tmp_path}/g")
    assert g.counts == {f"http://p/{i}#x": 30 for i in range(3)}
    found = g.match(("?s", "http://p/1#x", "?o")).rows
    assert found.count() == 30
    assert "PartitionFilters: [" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "http://p/1#x" in plan.split("PartitionFilters")[1]
    assert {tuple(r) for r in g.triples.collect()} == rows


# The catalog


def cube_triples(rnd, tables=4, nodes=30):
    """The graph of a small catalog, in the shape that triples_of() gives."""
    out = set()
    kinds, above = {}, {}
    for i in range(nodes):
        kinds[i] = rnd.choice(["measure", "dimension", "code"])
    groups = [i for i, k in kinds.items() if k == "dimension"]
    node = lambda i: (NS.measure if kinds[i] == "measure" else NS.dimension) + f"n{i}"
    for i, kind in kinds.items():
        if kind == "code":
            above[i] = rnd.choice(groups)
            out.add((node(i), iri("skos:broader"), node(above[i])))
        mark = rnd.choice([None, None, TIME, GEO]) if kind != "measure" else None
        if mark:
            out.add((node(i), iri("rdf:type"), mark))
        if kind == "measure" and rnd.random() < 0.7:
            unit = rnd.choice(["EUR", "KiloEUR", "PERCENT"])
            at = "http://qudt.org/vocab/unit/"
            out |= {(node(i), iri("qudt:unit"), at + unit), (node(i), iri("qudt:unitOfSystem"), f'"x {unit}"'), (node(i), iri("qudt:conversionMultiplier"), f'"{float(i)}"')}
            if unit == "KiloEUR":
                out.add((at + unit, iri("qudt:scalingOf"), at + "EUR"))
            if unit == "PERCENT":
                out.add((at + unit, iri("qudt:hasQuantityKind"), cubegraph.DIMENSIONLESS[0]))
    held = {(t, i) for i in kinds for t in rnd.sample(range(tables), rnd.randint(1, 2))}
    for t, i in held:
        table, concept = f"{NS.table}T{t}", f"{NS.concept}T{t}.n{i}"
        out |= {(table, iri("dct:identifier"), f'"T{t}"'), (table, iri("dct:title"), f'"title {t}"'), (table, iri("dct:description"), f'"about {t}"')}
        out |= {(table, iri("qb:measure" if kinds[i] == "measure" else "qb:dimension"), node(i)), (node(i), iri("dct:identifier"), f'"n{i}"')}
        if rnd.random() < 0.9:
            out |= {(node(i), iri("qb:concept"), concept), (concept, iri("dct:isPartOf"), table), (concept, iri("skos:prefLabel"), f'"label {rnd.randint(0, 99)}"')}
            if rnd.random() < 0.5:
                out.add((concept, iri("skos:definition"), '"what it is"'))
    return sorted(out)


def contents(c):
    return {n: sorted(map(str, getattr(c, n).select(sorted(getattr(c, n).columns)).collect())) for n in ("tables", "nodes", "labels", "hierarchy", "units")}


def test_catalog_round_trip(spark):
    triples = cube_triples(random.Random(1))
    back = triples_of(catalog_of(graph_of(spark, triples)), NS)
    assert {tuple(r) for r in back.collect()} == set(triples)


def test_catalog_conflicts_and_nothing(spark):
    t, n, c = NS.table + "T", NS.dimension + "n", [NS.concept + x for x in "ab"]
    triples = {(t, iri("qb:dimension"), n), (t, iri("dct:title"), '"b"'), (t, iri("dct:title"), '"a"@en'), (NS.dimension + "up", iri("skos:narrower"), n), (n, iri("skos:broader"), NS.dimension + "up")}
    triples |= {x for k, name in enumerate(c) for x in ((n, iri("qb:concept"), name), (name, iri("dct:isPartOf"), t), (name, iri("skos:prefLabel"), f'"label {1 - k}"'))}
    found = catalog_of(graph_of(spark, triples))
    assert [(r.table_id, r.title) for r in found.tables.collect()] == [("T", "a")]
    assert [(r.node_id, r.label) for r in found.labels.collect()] == [("n", "label 0")]
    assert [tuple(r) for r in found.hierarchy.collect()] == [("up", "n")]
    empty = catalog_of(Graph(spark.createDataFrame([], "s string, p string, o string")))
    assert all(not rows for rows in contents(empty).values())


@pytest.mark.parametrize("seed", [1, 2])
def test_refreshed_catalog_is_the_one_made_anew(spark, seed):
    """Changes of every kind; rows that no changed subject touches are not even looked at."""
    rnd = random.Random(seed)
    order = cube_triples(rnd)
    before = set(order)
    gone = {x for x in order if rnd.random() < 0.04}
    new = {(s, p, rnd.choice([y for _, q, y in order if q == p])) for s, p, _ in order if rnd.random() < 0.04}
    new |= {(NS.dimension + f"n{i}", iri("skos:narrower"), NS.dimension + f"n{i + seed}") for i in range(0, 9 * seed, 4)}
    after = (before - gone) | new
    changed = {s for s, _, _ in before ^ after}
    old = catalog_of(graph_of(spark, before))
    now = graph_of(spark, after)
    subjects = spark.createDataFrame([(s,) for s in changed], "s string")
    got, want = contents(refreshed(old, now, subjects)), contents(catalog_of(now))
    assert got == want
    marked = Catalog(old.tables.withColumn("title", F.lit("old")), old.nodes, old.labels.withColumn("definition", F.lit("old")), old.hierarchy, old.units)
    labels = refreshed(marked, now, subjects).labels
    touched = labels.where("definition IS NULL OR definition <> 'old'").count()
    assert touched < labels.count()


def test_exploded_follows_its_cuts(spark):
    """Two tables of the three named, one of the two nodes; codes of time hold no tables together."""
    triples = cube_triples(random.Random(4), tables=3, nodes=12)
    g = graph_of(spark, triples)
    tables = [f"{NS.table}T{i}" for i in (2, 0, 1)]
    subjects = lambda df: {r.s for r in df.where(F.col("s").startswith(NS.table)).select("s").distinct().collect()}
    assert subjects(exploded(g, tables, NS, tables=2)) <= set(tables[:2])
    assert exploded(g, [], NS).collect() == []
    only = exploded(g, tables[:1], NS, full=False)
    assert {r.p for r in only.select("p").distinct().collect()} <= {iri("qb:measure"), iri("qb:dimension")}
    whole = {tuple(r) for r in table_graph(g, tables[0], with_codes=True).collect()}
    assert whole <= set(triples)
    assert {tuple(r) for r in table_graph(g, tables[0]).collect()} <= whole
