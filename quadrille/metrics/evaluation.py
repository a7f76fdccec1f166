"""What goes wrong in a set of answered questions: outcomes, counters by type and theme, retrieval failures, overlap gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.text import overlap

PLACEHOLDER = "-- NOT GENERATED"
#: A prediction's title overlaps the right one's by more than this; a question's overlaps the right title by less.
NEAR_TITLE, FAR_TITLE = 0.6, 0.15


def completed(questions: DataFrame, generated: DataFrame, key: str = "question", query: str = "query") -> DataFrame:
    """Every question with its generated query; an empty or missing one is a comment, which counts as a failure."""
    found = questions.join(generated.select(key, F.col(query).alias("_query")), key, "left")
    return found.withColumn(query, F.when(F.trim(F.coalesce("_query", F.lit(""))) == "", PLACEHOLDER).otherwise(F.col("_query"))).drop("_query")


def outcomes(results: DataFrame) -> DataFrame:
    """Flags of each answered question, from (outcome, gold_tables, tables, gold_query, query, gold_type, type, exec, record,
    observation_f1, extra_measures, missing_measures, extra_dimensions, missing_dimensions): outcome is `ok`, `syntax`,
    `units` or `no_table`. What a query selects is judged whatever its outcome, its tables and type only if it reads."""
    reads = F.col("outcome") != "syntax"
    other = (F.size(F.array_except("gold_tables", "tables")) > 0) | (F.size(F.array_except("tables", "gold_tables")) > 0)
    wrong = (F.col("exec") != 1) & (F.col("record") != 1) & (F.col("observation_f1") != 1) & F.col("type").isNotNull() & (F.col("type") != F.col("gold_type"))
    flags = {
        "syntax_error": ~reads,
        "unit_error": F.col("outcome") == "units",
        "format_error": F.col("outcome") == "format",
        "table_mismatch": reads & other,
        "missing_pivot": reads & F.contains("gold_query", F.lit("PIVOT")) & ~F.contains("query", F.lit("PIVOT")),
        "wrong_function": reads & wrong,
        **{c: F.col(c) > 0 for c in ("extra_measures", "missing_measures", "extra_dimensions", "missing_dimensions")},
    }
    return results.select(*(c for c in results.columns if c not in flags), *(F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()))


ERRORS = ("syntax_error", "unit_error", "format_error", "table_mismatch", "missing_pivot", "wrong_function", "extra_measures", "missing_measures", "extra_dimensions", "missing_dimensions")


def error_counts(flagged: DataFrame, *by: str) -> DataFrame:
    """How many questions have each of ERRORS, by type, by theme, or of all."""
    return flagged.groupBy(*by).agg(F.count("*").alias("questions"), *(F.count_if(F.col(e)).alias(e) for e in ERRORS))


def averages(results: DataFrame, scores: list[str], by: str = "gold_type") -> DataFrame:
    """(by, questions, scores): the mean of each score by question type, and over all questions as type `all`."""
    found = results.select(F.explode(F.array(F.col(by), F.lit("all"))).alias(by), *scores)
    return found.groupBy(by).agg(F.count("*").alias("questions"), *(F.avg(s).alias(s) for s in scores))


def retrieval_failures(misses: DataFrame, question: Column, gold_title: Column, top_title: Column) -> DataFrame:
    """Adds label: `near_duplicate` if the first result's title is much like the right one's, `vocab_gap` if the question has
    few words of the right title, else `other`. Columns are arrays of tokens."""
    label = F.when(overlap(gold_title, top_title) > NEAR_TITLE, "near_duplicate").when(overlap(question, gold_title) < FAR_TITLE, "vocab_gap").otherwise("other")
    return misses.withColumn("label", label)


def overlap_gaps(ranking: DataFrame, target: DataFrame, k: int = 10, most: int = 5) -> DataFrame:
    """(query, hit, target_rank, target_overlap, confounders, mean_gap) for questions about one table: how much more of the
    question the first items above it have.

    ranking: (query, item, rank, asked, label) with arrays of tokens; target: (query, item, asked, label), whether ranked or
    not. Without the target among the first k, the first k stand above it.
    """
    own = target.select("query", F.col("item").alias("_target"), overlap(F.col("asked"), F.col("label")).alias("target_overlap"))
    placed = ranking.join(own, "query")
    rank = placed.groupBy("query").agg(F.min(F.when(F.col("item") == F.col("_target"), F.col("rank"))).alias("target_rank"))
    above = placed.join(rank, "query").where(F.col("item") != F.col("_target")).where((F.col("rank") <= k) & (F.col("target_rank").isNull() | (F.col("target_rank") > k) | (F.col("rank") < F.col("target_rank"))))
    gaps = above.where(F.col("rank") <= most).withColumn("_gap", overlap(F.col("asked"), F.col("label")) - F.col("target_overlap")).groupBy("query").agg(F.count("*").alias("confounders"), F.avg("_gap").alias("mean_gap"))
    hit = F.coalesce(F.col("target_rank") <= k, F.lit(False))
    return own.join(rank, "query", "left").join(gaps, "query", "left").select("query", hit.alias("hit"), "target_rank", "target_overlap", F.coalesce("confounders", F.lit(0)).cast("long").alias("confounders"), "mean_gap")
