"""Operator 7: optimal length buckets by dynamic programming, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import materialise, numbered

BUCKETS = 16
#: Tokens, padding included, that a batch may hold.
BUDGET = 65_536
#: Lengths up to 2**EXACT_BITS are told apart one by one, longer ones to as many leading bits.
EXACT_BITS = 14


def byte_tokens(text_col: str = "text") -> Column:
    """Length in byte-level tokens: the UTF-8 bytes and an end id. A null text has the end id only."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")


def step_of(length: str) -> str:
    """SQL of the step of a length: itself, or the next number with EXACT_BITS leading bits. So the histogram has some ten
    thousand steps for each doubling of the longest length at most, whatever the corpus."""
    shift = f"greatest(0, length(bin({length})) - {EXACT_BITS})"
    return f"shiftleft(shiftright({length} + shiftleft(1L, {shift}) - 1, {shift}), {shift})"


def _least(best: np.ndarray, b: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least best[i] + padding of a bucket of the steps from i to j, i < j, and the smallest such i. The
    smallest i never falls as j grows, so each round halves all ranges of j at once (divide and conquer)."""
    m = len(b)
    cost, choice = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64), np.zeros(m + 1, np.int64)
    ranges = np.array([[1, m, 0, m - 1]])  # of j, and of i
    while len(ranges):
        low, high, from_, to = ranges.T
        j = (low + high) // 2
        sizes = np.minimum(to, j - 1) - from_ + 1
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        of = np.repeat(np.arange(len(j)), sizes)
        i = np.arange(sizes.sum()) - starts[of] + from_[of]
        pad = best[i] + b[j[of] - 1] * (c[j[of]] - c[i]) - (s[j[of]] - s[i])
        cost[j] = np.minimum.reduceat(pad, starts)
        hit = np.flatnonzero(pad == cost[j][of])
        choice[j] = i[hit[np.unique(of[hit], return_index=True)[1]]]
        halves = np.concatenate((np.stack((low, j - 1, from_, choice[j]), axis=1), np.stack((j + 1, high, choice[j], to), axis=1)))
        ranges = halves[halves[:, 0] <= halves[:, 1]]
    return cost, choice


def best_boundaries(steps: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding, exactly: steps are (boundary, rows, tokens),
    ascending. Dynamic programming, O(buckets * steps * log steps); ties take the smallest boundaries."""
    if not steps:
        return []
    b, rows, tokens = (np.array(x, np.int64) for x in zip(*steps, strict=True))
    c, s = np.concatenate(([0], np.cumsum(rows))), np.concatenate(([0], np.cumsum(tokens)))
    best = np.full(len(b) + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, len(b))):
        cost, choice = _least(best, b, c, s)
        choices.append(np.where(cost < best, choice, -1))
        best = np.minimum(best, cost)
    out, j = [], len(b)
    for choice in reversed(choices):
        if choice[j] >= 0:
            out.append(int(b[j - 1]))
            j = int(choice[j])
    return out[::-1]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(id, n_tokens, bucket, boundary, batch, slot): every row is in one batch of its bucket; a batch times its
    boundary keeps to the budget, or is a single row that is longer. Within a bucket a hash of the id shuffles rows.

    The histogram of all rows, of a bounded number of steps at any size, comes to the driver for the dynamic programme. A
    boundary is the longest length of its step, so none exceeds the longest row; up to 2**EXACT_BITS tokens every length is
    a step and the padding the least there is, beyond it a boundary misses the best by one part in 2**(EXACT_BITS - 1) at
    most. Null lengths count as 0. Null and repeated ids are rows like any other. No rows, no batches.
    """
    sized = materialise(docs.select(F.col(id_col).alias("_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")).withColumn("_step", F.expr(step_of("n_tokens"))), "lengths")
    steps = sorted(tuple(r) for r in sized.groupBy("_step").agg(F.max("n_tokens"), F.count("*"), F.sum("n_tokens")).drop("_step").collect())
    bounds = best_boundaries(steps, buckets)
    if not bounds:
        return sized.select(F.col("_id").alias(id_col), "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("boundary"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"))
    known = F.array(*map(F.lit, bounds))
    bucketed = sized.withColumn("bucket", F.size(F.filter(known, lambda x: x < F.col("n_tokens"))))
    ranked = numbered(bucketed, ["bucket"], [F.xxhash64("_id"), F.col("_id"), F.col("n_tokens")], F.xxhash64("_id", F.lit(1)), sum(r[1] for r in steps), "_at")
    boundary = known[F.col("bucket")].cast("long")
    rows = F.greatest(F.lit(1), F.expr(f"{budget} div boundary"))
    return ranked.withColumn("boundary", boundary).withColumn("_rows", rows).select(
        F.col("_id").alias(id_col), "n_tokens", "bucket", "boundary", F.expr("_at div _rows").alias("batch"), (F.col("_at") % F.col("_rows")).cast("int").alias("slot")
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, batch, slot for every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_tokens())
