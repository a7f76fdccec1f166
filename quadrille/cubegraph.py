"""The graph of cubes: what is asked of it as patterns, the catalog out of it and back, and kept up to date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.catalog import Catalog
from quadrille.context import kept
from quadrille.functions.text import uri_to_code
from quadrille.plans.patterns import Graph, Solutions, iri, literal, text_of

KINDS = ("qb:measure", "qb:dimension")
TIME, GEO = literal("TimeDimension"), literal("GeoDimension")
MARKS = (TIME, GEO, "scot:Total", "scot:confidenceInterval")
#: Kinds of quantity without a dimension.
DIMENSIONLESS = ("http://qudt.org/vocab/quantitykind/Dimensionless", "http://qudt.org/vocab/quantitykind/DimensionlessRatio")


@dataclass(frozen=True)
class Namespaces:
    """What the IRIs of tables, measures, dimensions and concepts begin with."""

    table: str
    measure: str
    dimension: str
    concept: str


def _typed(graph: Graph, variable: str, kinds: Sequence[str] = (TIME, GEO)) -> Solutions:
    return graph.match((variable, "a", kinds)).select(variable)


def _codes(graph: Graph, variable: str, kinds: Sequence[str] = (TIME, GEO)) -> Solutions:
    """Codes below a group of time or geography, not the groups."""
    return graph.match((variable, "a", kinds), (variable, "skos:broader", "?_above")).select(variable)


def _held(graph: Graph, tables: Solutions, with_codes: bool) -> Solutions:
    """(s, p, obs): measures and dimensions of the tables, with or without the codes of time and geography."""
    held = tables.join(graph.match(("?s", "?p", "?obs")).values("?p", KINDS))
    return held if with_codes else held.not_exists(_codes(graph, "?obs"))


def _described(graph: Graph, tables: Solutions, with_codes: bool) -> DataFrame:
    """Triples of tables: titles, what they hold, its labels, definitions and units, its marks, and its hierarchy as far as
    both ends are in the same table."""
    found = _held(graph, tables, with_codes).join(graph.match(("?s", "dct:title", "?title")))
    found = found.join(graph.match(("?obs", "qb:concept", "?concept"), ("?concept", "skos:prefLabel", "?label"), ("?concept", "dct:isPartOf", "?s")))
    above = graph.match(("?obs", "?hierarchy", "?group")).values("?hierarchy", ("skos:broader", "skos:narrower"))
    found = found.optional(above, exists=[graph.match(("?s", "?p", "?group")).values("?p", KINDS)], not_exists=[] if with_codes else [_typed(graph, "?obs")])
    found = found.optional(graph.match(("?obs", "?has_type", "?type")).values("?type", MARKS))
    for predicate, variable in (("qudt:unitOfSystem", "?unit_string"), ("qudt:unit", "?unit")):
        found = found.optional(graph.match(("?obs", predicate, variable)))
    found = found.optional(graph.match(("?concept", "skos:definition", "?definition")))
    return found.construct(
        ("?s", "?p", "?obs"), ("?s", "dct:title", "?title"), ("?obs", "?hierarchy", "?group"), ("?obs", "?has_type", "?type"), ("?obs", "qb:concept", "?concept"), ("?obs", "qudt:unitOfSystem", "?unit_string"),
        ("?obs", "qudt:unit", "?unit"), ("?concept", "dct:isPartOf", "?s"), ("?concept", "skos:prefLabel", "?label"), ("?concept", "skos:definition", "?definition"),
    )


def table_graph(graph: Graph, table: str, with_codes: bool = False) -> DataFrame:
    """(s, p, o) about one table; with_codes also of the codes of time and geography, which can be very many."""
    return _described(graph, graph.match((table, "dct:title", "?_title")).values("?s", [table]).select("?s"), with_codes)


def exploded(graph: Graph, nodes: Sequence[str], names: Namespaces, tables: int = 5, others: int | None = None, full: bool = True) -> DataFrame:
    """(s, p, o) about the tables that are named, the first `tables` of them, and those that hold a named measure or
    dimension, the first `others` of these (10, or 20 without `full`). Time and geography hold nothing together. Without
    `full`, only what tables hold. No nodes, no triples."""
    others = others or (10 if full else 20)
    named = [n for n in nodes if n.startswith(names.table)][:tables]
    held = [n for n in nodes if n.startswith((names.measure, names.dimension))][:others]
    found = graph.match(("?s", KINDS, "?o")).not_exists(_typed(graph, "?o")).where(F.col("s").isin(named) | F.col("o").isin(held)).select("?s")
    return _described(graph, found, False) if full else _held(graph, found, False).construct(("?s", "?p", "?obs"))


def _labelled(graph: Graph, *more) -> Solutions:
    """(s, dim, id, concept, label) of the dimensions of tables."""
    return graph.match(("?s", "qb:dimension", "?dim"), ("?dim", "dct:identifier", "?id"), ("?dim", "qb:concept", "?concept"), ("?concept", "dct:isPartOf", "?s"), ("?concept", "skos:prefLabel", "?label"), *more)


def codes(graph: Graph, table: str, dimension: str | None = None, kind: str | None = None) -> DataFrame:
    """(code, label) of a table's codes: below a dimension, or of a kind (TIME or GEO)."""
    found = _labelled(graph, *([("?dim", "skos:broader", dimension)] if dimension else [])).values("?s", [table])
    found = found.exists(_codes(graph, "?dim", [kind])) if kind else found
    return found.rows.select(text_of(F.col("id")).alias("code"), text_of(F.col("label")).alias("label")).distinct()


def schema_labels(graph: Graph) -> DataFrame:
    """(table_id, kind, label) of all tables: names of measures, and of dimensions whose concepts have nothing above them
    and whose identifiers are words; the two are united after their own conditions."""
    dims = _labelled(graph).not_exists(graph.match(("?concept", "skos:broader", "?_above")).select("?concept"))
    name = text_of(F.col("id"))
    dims = dims.where(~name.rlike("[0-9]") & (F.length(name) > 3)).rows.select("s", F.lit("dimension").alias("kind"), "label")
    found = graph.match(("?s", "qb:measure", "?msr"), ("?msr", "qb:concept", "?concept"), ("?concept", "skos:prefLabel", "?label"))
    every = Solutions(dims.union(found.rows.select("s", F.lit("measure"), "label")), frozenset({"s", "kind", "label"}))
    every = every.join(graph.match(("?s", "dct:identifier", "?id")))
    return every.rows.select(text_of(F.col("id")).alias("table_id"), "kind", text_of(F.col("label")).alias("label")).distinct()


def time_coverage(graph: Graph) -> DataFrame:
    """(table_id, coverage): first and last year of a table's periods, or the one year."""
    from quadrille.catalog import time_coverage as coverage

    found = _labelled(graph).exists(_codes(graph, "?dim", [TIME])).select("?s", "?label").join(graph.match(("?s", "dct:identifier", "?table")))
    rows = found.rows.select(text_of(F.col("table")).alias("table_id"), text_of(F.col("label")).alias("label")).where("label RLIKE '^[0-9]{4}'")
    return coverage(rows, "table_id", F.col("label"))


def measure_units(graph: Graph, table_id: str | None = None) -> DataFrame:
    """(table_id, node_id, units, unit_strings): known units of each measure, of one table or all, without repeats; the word
    None is no unit."""
    found = graph.match(("?table", "dct:identifier", "?table_id"), ("?table", "qb:measure", "?node"), ("?node", "dct:identifier", "?node_id"))
    found = found if table_id is None else found.values("?table_id", [literal(table_id)])
    for predicate, variable in (("qudt:unit", "?unit"), ("qudt:unitOfSystem", "?string")):
        found = found.optional(graph.match(("?node", predicate, variable)))
    known = lambda c: F.array_sort(F.collect_set(F.when(~F.lower(text_of(F.col(c))).isin("none", ""), text_of(F.col(c)))))
    return found.rows.groupBy(text_of(F.col("table_id")).alias("table_id"), text_of(F.col("node_id")).alias("node_id")).agg(known("unit").alias("units"), known("string").alias("unit_strings"))


# The catalog

#: What a subject has one of; of several the smallest counts.
SINGLE = {
    "title": "dct:title", "description": "dct:description", "label": "skos:prefLabel", "alt_label": "skos:altLabel", "definition": "skos:definition",
    "unit_string": "qudt:unitOfSystem", "multiplier": "qudt:conversionMultiplier", "scaling_of": "qudt:scalingOf",
}


def _facts(triples: DataFrame) -> DataFrame:
    """A row for each subject with its single values and marks: one aggregation of fixed width, so that a subject of many
    triples is no long list; after the shuffle, as smallest texts are found by sorting, and a task reads more than it sorts."""
    p, o = F.col("p"), F.col("o")
    value = lambda name: F.min(F.when(p == iri(SINGLE[name]), text_of(o))).alias(name)
    has = lambda condition, name: F.coalesce(F.max(condition), F.lit(False)).alias(name)
    of_type = p == iri("rdf:type")
    return triples.where(p.isin([iri(x) for x in (*SINGLE.values(), "rdf:type", "skos:broader", "qudt:hasQuantityKind")])).repartition("s").groupBy("s").agg(
        *map(value, SINGLE), has(of_type & (o == TIME), "is_time"), has(of_type & (o == GEO), "is_geo"), has(p == iri("skos:broader"), "has_parent"),
        has((p == iri("qudt:hasQuantityKind")) & o.isin(*DIMENSIONLESS), "is_dimensionless"),
    )


def catalog_of(graph: Graph) -> Catalog:
    """The five tables of a catalog. Ids are the last parts of IRIs. A node of a table is a measure, a dimension, or a code if
    something is above it; its label in the table is the smallest of the concepts that belong to both. A measure has a
    row for each unit. Broader and narrower are one hierarchy."""
    t = graph.triples
    facts = kept(_facts(t), "facts")
    of = lambda *names: t.where(F.col("p").isin([iri(n) for n in names]))
    held = of(*KINDS).select(F.col("s").alias("t"), F.col("o").alias("n"), (F.col("p") == iri("qb:measure")).alias("is_measure"))
    tables = facts.join(held.select(F.col("t").alias("s")).distinct(), "s", "right").select(uri_to_code(F.col("s")).alias("table_id"), "title", "description")
    marks = facts.select(F.col("s").alias("n"), "is_time", "is_geo", "has_parent")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    nodes = held.join(marks, "n", "left").select(_id("t", "table_id"), _id("n", "node_id"), F.when(F.col("is_measure"), "measure").when(F.col("has_parent"), "code").otherwise("dimension").alias("kind"), *map(no, ("is_time", "is_geo", "has_parent")))
    concepts = of("qb:concept").select(F.col("s").alias("n"), F.col("o").alias("c"))
    parts = of("dct:isPartOf").select(F.col("s").alias("c"), F.col("o").alias("t"))
    named = facts.where("label IS NOT NULL").select(F.col("s").alias("c"), "label", "alt_label", "definition")
    pairs = parts.join(named, "c").join(concepts, "c").join(held.select("t", "n").distinct(), ["t", "n"], "left_semi")
    labels = pairs.groupBy("t", "n").agg(F.min(F.struct("label", "alt_label", "definition")).alias("x")).select(_id("t", "table_id"), _id("n", "node_id"), "x.*")
    above = of("skos:broader").select(_id("o", "parent"), _id("s", "child")).union(of("skos:narrower").select(_id("s", "parent"), _id("o", "child"))).distinct()
    units = of("qudt:unit").select(F.col("s").alias("n"), F.col("o").alias("u"))
    own = facts.where("unit_string IS NOT NULL OR multiplier IS NOT NULL").select(F.col("s").alias("n"), "unit_string", "multiplier")
    scales = facts.where("scaling_of IS NOT NULL OR is_dimensionless").select(F.col("s").alias("u"), "scaling_of", "is_dimensionless")
    units = own.join(units, "n", "full").join(scales, "u", "left")
    units = units.select(_id("n", "node_id"), _id("u", "unit"), "unit_string", F.col("multiplier").try_cast("double").alias("multiplier"), uri_to_code(F.col("scaling_of")).alias("scaling_of"), no("is_dimensionless"))
    return Catalog(tables, nodes, labels, above, units)


def _id(column: str, name: str) -> Column:
    return uri_to_code(F.col(column)).alias(name)


def triples_of(catalog: Catalog, names: Namespaces, unit: str = "http://qudt.org/vocab/unit/") -> DataFrame:
    """(s, p, o): the graph of a catalog. Concepts are named by table and node."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    named = lambda space, c: F.concat(F.lit(space), F.col(c))
    of_node = lambda kind, c: F.concat(F.when(F.col(kind) == "measure", names.measure).otherwise(names.dimension), F.col(c))
    concept = F.concat(F.lit(names.concept), F.col("table_id"), F.lit("."), F.col("node_id"))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(iri(p)).alias("p"), o.alias("o"))
    table, node = named(names.table, "table_id"), of_node("kind", "node_id")
    mark = lambda c, m: F.when(F.col(c), triple(node, "rdf:type", F.lit(m)))
    kind = F.when(F.col("kind") == "measure", triple(table, "qb:measure", node)).otherwise(triple(table, "qb:dimension", node))
    kinds = catalog.nodes.select("node_id", "kind").distinct()
    units = catalog.units.join(kinds, "node_id")
    parts = [
        (catalog.tables, [triple(table, "dct:identifier", quoted("table_id")), triple(table, "dct:title", quoted("title")), triple(table, "dct:description", quoted("description"))]),
        (catalog.nodes, [kind, triple(node, "dct:identifier", quoted("node_id")), mark("is_time", TIME), mark("is_geo", GEO)]),
        (catalog.labels.join(catalog.nodes.select("table_id", "node_id", "kind").distinct(), ["table_id", "node_id"]), [triple(node, "qb:concept", concept), triple(concept, "dct:isPartOf", table), *(triple(concept, p, quoted(c)) for p, c in (("skos:prefLabel", "label"), ("skos:altLabel", "alt_label"), ("skos:definition", "definition")))]),
        (catalog.hierarchy, [triple(named(names.dimension, "child"), "skos:broader", named(names.dimension, "parent"))]),
        (units, [triple(node, "qudt:unit", named(unit, "unit")), triple(node, "qudt:unitOfSystem", quoted("unit_string")), triple(node, "qudt:conversionMultiplier", quoted("multiplier")), triple(named(unit, "unit"), "qudt:scalingOf", named(unit, "scaling_of")), F.when(F.col("is_dimensionless"), triple(named(unit, "unit"), "qudt:hasQuantityKind", F.lit(DIMENSIONLESS[0])))]),
    ]
    out = None
    for df, made in parts:
        one = df.select(F.explode(F.array_compact(F.array(*made))).alias("t")).select("t.*").where("s IS NOT NULL AND o IS NOT NULL")
        out = one if out is None else out.union(one)
    return out.distinct()


def refreshed(catalog: Catalog, graph: Graph, changed: DataFrame) -> Catalog:
    """The catalog after subjects (column s) of the graph have changed: only rows that speak of them are made anew, from the
    part of the graph that they need; all others stay as they are.

    Rows depend on a node through itself, through its concepts and its units, and on a table through itself.
    """
    t = graph.triples
    gone = changed.select("s").distinct()
    link = lambda *names: t.where(F.col("p").isin([iri(n) for n in names]))
    through = link("qb:concept", "qudt:unit").join(gone.select(F.col("s").alias("o")), "o", "left_semi").select("s")
    below = link("skos:narrower").join(gone, "s", "left_semi").select(F.col("o").alias("s"))
    held = link(*KINDS)
    touched = gone.union(through).union(below).distinct()
    alike = held.select(F.col("o").alias("s")).distinct().withColumn("_id", uri_to_code(F.col("s"))).join(touched.select(_id("s", "_id")).distinct(), "_id", "left_semi").select("s")
    nodes = kept(touched.union(alike).distinct(), "changed_nodes")  # nodes of two namespaces may share an id, and so rows
    rows = held.join(nodes.select(F.col("s").alias("o")), "o", "left_semi").select("s", "p", "o").union(held.join(gone, "s", "left_semi").select("s", "p", "o")).distinct()
    about = nodes.union(rows.select("s")).union(rows.select("o"))
    needed = link("qb:concept", "qudt:unit").join(about.select("s").distinct(), "s", "left_semi").select("o")
    about = about.union(needed.select(F.col("o").alias("s"))).distinct()
    ends = lambda name, by: link(name).join(by.select(F.col("s").alias("o")), "o", "left_semi").select("s", "p", "o")  # noqa: E731  whose other end has changed
    part = t.where(~F.col("p").isin([iri(n) for n in KINDS])).join(about, "s", "left_semi").select("s", "p", "o").union(rows).union(ends("skos:broader", gone)).union(ends("skos:narrower", nodes)).distinct()
    new = catalog_of(Graph(kept(part, "changed_part")))
    ids = lambda df, name: df.select(_id("s", name)).distinct()

    def merged(old: DataFrame, fresh: DataFrame, *keys: tuple[DataFrame, str]) -> DataFrame:
        """Old rows without these keys, and new ones with them."""
        stays, comes = old, None
        for by, name in keys:
            stays = stays.join(ids(by, name), name, "left_anti")
            one = fresh.join(ids(by, name), name, "left_semi").select(*old.columns)
            comes = one if comes is None else comes.union(one)
        return stays.select(*old.columns).union(comes.distinct())

    of_rows = ((gone, "table_id"), (nodes, "node_id"))
    return Catalog(merged(catalog.tables, new.tables, (gone, "table_id")), merged(catalog.nodes, new.nodes, *of_rows), merged(catalog.labels, new.labels, *of_rows), merged(catalog.hierarchy, new.hierarchy, (nodes, "child"), (gone, "parent")), merged(catalog.units, new.units, (nodes, "node_id")))
