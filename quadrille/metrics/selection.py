"""Which measures and dimension codes a query selects, and how well two queries agree in them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.plans import sqltext
from quadrille.plans.expressions import Join, Value, read


def referenced(query: str) -> tuple[set[str], set[str]]:
    """(tables, names) that an expression or SQL text mentions; nothing of a text that can't be read."""
    if query.lstrip().startswith("("):
        try:
            todo, values = [read(query)], []
        except (SyntaxError, AssertionError, ValueError):
            return set(), set()
        while todo:
            node = todo.pop()
            if isinstance(node, Value):
                values.append(node)
            else:
                todo += node.inputs if isinstance(node, Join) else [node.inner]
        return {v.table for v in values}, {n for v in values for n in (*v.measures, *(c for g in v.groups for c in v.codes(g)))}
    ts = sqltext.tokens(query)
    tables = {m[1] for t in ts if t[:1] in "'\"" and (m := re.search(r"([^/\\]+)\.parquet$", t[1:-1]))}
    names = {t[1:-1] if t[:1] in "'\"" else t for t in ts if re.match(r"['\"A-Za-z_]", t)}
    return tables, names


def selections(names: DataFrame, nodes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(question, side, kind, node_id) of names (question, side, table_id, name): measures of the tables and codes of
    their dimensions. A dimension of which no code is named counts with all its codes."""
    known = names.select("question", "side", "table_id", F.col("name").alias("node_id")).distinct()
    measures = known.join(nodes.where("kind = 'measure'").select("table_id", "node_id").distinct(), ["table_id", "node_id"], "left_semi").select("question", "side", F.lit("measure").alias("kind"), "node_id")
    codes = nodes.where("kind = 'code'").join(hierarchy.select(F.col("child").alias("node_id"), "parent"), "node_id").select("table_id", "parent", "node_id").distinct()
    chosen = known.join(codes, ["table_id", "node_id"])
    filtered = chosen.select("question", "side", "table_id", "parent").distinct()
    asked = names.select("question", "side", "table_id").distinct().join(codes.select("table_id", "parent").distinct(), "table_id")
    free = asked.join(filtered, ["question", "side", "table_id", "parent"], "left_anti").join(codes, ["table_id", "parent"])
    return measures.union(chosen.unionByName(free).select("question", "side", F.lit("dimension").alias("kind"), "node_id")).distinct()


def selection_scores(found: DataFrame) -> DataFrame:
    """(question, measure_f1, dimension_f1, observation_f1, extra and missing counts) of selections(); sides are
    `predicted` and `truth`. Two empty sets agree. Without any common measure no observation is right."""
    has = lambda side: F.max((F.col("side") == side).cast("int"))
    marked = found.groupBy("question", "kind", "node_id").agg(has("predicted").alias("p"), has("truth").alias("t"))
    count = lambda kind, cond: F.count_if((F.col("kind") == kind) & cond)
    both, extra, missing = F.expr("p = 1 AND t = 1"), F.expr("p = 1 AND t = 0"), F.expr("p = 0 AND t = 1")
    counts = marked.groupBy("question").agg(*(count(k, c).alias(f"{n}_{k}s") for k in ("measure", "dimension") for n, c in (("common", both), ("extra", extra), ("missing", missing))))
    f1 = lambda c, e, m: F.when(c + e + m == 0, F.lit(1.0)).otherwise(2.0 * c / F.greatest(2 * c + e + m, F.lit(1)))
    part = lambda n: F.col(f"{n}_measures") + F.col(f"{n}_dimensions")
    of = lambda k: f1(*(F.col(f"{n}_{k}s") for n in ("common", "extra", "missing")))
    overall = F.when(of("measure") <= 0, F.lit(0.0)).otherwise(f1(part("common"), part("extra"), part("missing")))
    return counts.select("question", of("measure").alias("measure_f1"), of("dimension").alias("dimension_f1"), overall.alias("observation_f1"), "extra_measures", "missing_measures", "extra_dimensions", "missing_dimensions")
