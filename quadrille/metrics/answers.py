"""Metrics between answers and between rankings, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quadrille.operators.reshape import col


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def cells(df: DataFrame, precision: int = 5, numeric_only: bool = False) -> DataFrame:
    """(cell, n): the multiset of all cells, numbers rounded, nulls and NaN left out."""
    numbers = _numeric(df)
    shown = [F.round(col(c).cast("double"), precision).cast("string") if c in numbers else col(c).cast("string") for c in df.columns if c in numbers or not numeric_only]
    if not shown:
        return df.sparkSession.createDataFrame([], "cell string, n long")
    return df.select(F.explode(F.array(*shown)).alias("cell")).where("cell IS NOT NULL AND cell <> 'NaN'").groupBy("cell").agg(F.count("*").alias("n"))


def multiset_overlap(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row (common, n_truth, n_predicted) of two multisets (cell, n)."""
    both = truth.select("cell", F.col("n").alias("a")).join(predicted.select("cell", F.col("n").alias("b")), "cell", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return both.agg(total(F.least(zero("a"), zero("b"))).alias("common"), total(zero("a")).alias("n_truth"), total(zero("b")).alias("n_predicted"))


def numeric_recall(truth: DataFrame, predicted: DataFrame, precision: int = 5) -> DataFrame:
    """One row `score`: the share of the truth's numbers that the prediction has; 1 if there are none."""
    o = multiset_overlap(cells(truth, precision, True), cells(predicted, precision, True))
    return o.select(F.when(F.col("n_truth") == 0, F.lit(1.0)).otherwise(F.col("common") / F.col("n_truth")).alias("score"))


def lenient_match(truth: DataFrame, predicted: DataFrame, precision: int = 5) -> DataFrame:
    """One row `score`: 1 if both have the same multiset of cells, wherever they stand."""
    o = multiset_overlap(cells(truth, precision), cells(predicted, precision))
    return o.select(((F.col("common") == F.col("n_truth")) & (F.col("common") == F.col("n_predicted"))).cast("double").alias("score"))


def records(df: DataFrame, precision: int = 5) -> DataFrame:
    """(cell, n): the multiset of rows, each as the sorted array of its cells."""
    numbers = _numeric(df)
    row = F.array(*(F.round(col(c).cast("double"), precision).cast("string") if c in numbers else col(c).cast("string") for c in df.columns))
    return df.select(F.to_json(F.array_sort(F.filter(row, lambda x: x.isNotNull() & (x != "NaN")))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def _turned(truth: DataFrame, precision: int, most: int) -> DataFrame:
    """(cell, n): the columns of a table as records() has its rows; only columns of at most `most` cells that aren't null,
    as others equal no row of so many columns."""
    numbers = _numeric(truth)
    shown = [F.struct(F.lit(i).alias("column"), (F.round(col(c).cast("double"), precision).cast("string") if c in numbers else col(c).cast("string")).alias("cell")) for i, c in enumerate(truth.columns)]
    every = truth.select(F.explode(F.array(*shown)).alias("s")).select("s.*").where("cell IS NOT NULL AND cell <> 'NaN'")
    short = every.groupBy("column").count().where(F.col("count") <= most).select("column")
    rows = every.join(short, "column").groupBy("column").agg(F.to_json(F.array_sort(F.collect_list("cell"))).alias("cell"))
    return rows.groupBy("cell").agg(F.count("*").alias("n"))


def record_accuracy(truth: DataFrame, predicted: DataFrame, precision: int = 5) -> DataFrame:
    """One row `score`: the share of the truth's rows that the prediction has, as multisets of cells; further rows of the
    prediction do no harm. If the truth isn't square, its columns may stand for its rows, should that score better. Two
    empty tables agree, one is like nothing."""
    found = records(predicted, precision)
    o = multiset_overlap(records(truth, precision), found)
    width = len(truth.columns)
    if width:
        turned = multiset_overlap(_turned(truth, precision, len(predicted.columns)), found).select(F.col("common").alias("turned"))
    else:
        turned = o.select(F.lit(0).alias("turned"))
    both = o.crossJoin(F.broadcast(turned))  # one row each
    share = F.col("common") / F.col("n_truth")
    best = F.when(F.col("n_truth") == width, share).otherwise(F.greatest(share, F.col("turned") / max(1, width)))
    none = F.col("n_predicted") == 0
    return both.select(F.when(F.col("n_truth") == 0, none.cast("double")).when(none, F.lit(0.0)).otherwise(best).alias("score"))


def small(df: DataFrame, most: int = 1000) -> bool:
    """Whether an answer is small enough to be compared as a frame; reads no more rows than that tells."""
    return df.limit(most).count() < most


def frames_equal(a: DataFrame, b: DataFrame, precision: int = 5) -> DataFrame:
    """One row `equal`: the same rows as often, whatever their order and that of the columns."""
    if sorted(a.columns) != sorted(b.columns):
        return a.sparkSession.range(1).select(F.lit(False).alias("equal"))
    o = multiset_overlap(*(_ordered(df, precision) for df in (a, b)))
    return o.select(((F.col("common") == F.col("n_truth")) & (F.col("common") == F.col("n_predicted"))).alias("equal"))


def _ordered(df: DataFrame, precision: int) -> DataFrame:
    numbers = _numeric(df)
    parts = [F.coalesce((F.round(col(c).cast("double"), precision) if c in numbers else col(c)).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    return df.select(F.concat_ws("\x01", *parts).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def set_f1(predicted: Column, truth: Column) -> Column:
    """F1 of two arrays as sets: 1 if both are empty, 0 if one is."""
    p, t = F.array_distinct(predicted), F.array_distinct(truth)
    common = F.size(F.array_intersect(p, t))
    return F.when((F.size(p) == 0) & (F.size(t) == 0), F.lit(1.0)).otherwise(2.0 * common / F.greatest(F.size(p) + F.size(t), F.lit(1)))


def accuracy_curve(rankings: DataFrame, gold: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(rank, accuracy): the share of queries whose gold items are among the first `rank`, for each rank up to k."""
    n = gold.groupBy(query).agg(F.count("*").alias("_gold"))
    hits = rankings.where(F.col("rank") <= k).join(gold.select(query, item).withColumn("_hit", F.lit(1)), [query, item])
    w = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    done = hits.withColumn("_found", F.sum("_hit").over(w)).join(n, query).where("_found = _gold").select("rank")
    steps = n.sparkSession.range(1, k + 1).select(F.col("id").alias("rank"))
    total = n.agg(F.count("*").alias("_total"))
    per_rank = done.groupBy("rank").agg(F.count("*").alias("_n"))
    up_to = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    return steps.join(per_rank, "rank", "left").withColumn("_n", F.sum(F.coalesce("_n", F.lit(0))).over(up_to)).crossJoin(F.broadcast(total)).select("rank", (F.col("_n") / F.col("_total")).alias("accuracy"))
