"""Exact quantiles by distributed selection: windows of values that are narrowed until few values are left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.context import kept
from quadrille.operators.reshape import col

#: Values strictly inside a window that are gathered at last, and cells that a window is cut into before.
GATHERED, CELLS = 1000, 64


def quantiles(df: DataFrame, by: list[str], value: Column, shares: Sequence[float], names: Sequence[str], rows: int = 100_000) -> DataFrame:
    """(by.., names..): the quantiles of a value in each group, linear between neighbours, as percentile() has them. Nulls don't
    count, NaN is above all numbers; a group without values has nulls. Values are doubles.

    Of each quantile's two neighbours the ranks are known, and a window of values that holds them. A pass counts what is
    below and inside each window and cuts it by a sketch; the cells around the rank are the next window. When no more
    than GATHERED values are strictly inside any, they are gathered, at last. So a task holds sketches and counts of
    its groups, map-side, however many values a group has; passes grow with the logarithm of the rows.
    """
    keys = [*by]
    data = df.select(*map(col, keys), value.cast("double").alias("_v")).where("_v IS NOT NULL")
    ranks = [(j, side) for j in range(len(shares)) for side in (0, 1)]
    first = data.groupBy(*map(col, keys)).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    at = lambda j: F.lit(float(shares[j])) * (F.col("_n") - 1)
    state = first.select(*map(col, keys), "_n", *(x for i, (j, side) in enumerate(ranks) for x in ((F.ceil(at(j)) if side else F.floor(at(j))).cast("long").alias(f"_r{i}"), F.col("_low").alias(f"_a{i}"), F.col("_high").alias(f"_b{i}"))))
    state = kept(state, "quantiles")
    v = F.col("_v")
    while True:
        side = F.broadcast(state) if state.limit(rows + 1).count() <= rows else state
        both = data.join(side, keys) if keys else data.crossJoin(side)  # without keys the state is one row
        inside = lambda i: (v > F.col(f"_a{i}")) & (v < F.col(f"_b{i}"))
        counts = [x for i in range(len(ranks)) for x in (F.count_if(v < F.col(f"_a{i}")).alias(f"_u{i}"), F.count_if(v == F.col(f"_a{i}")).alias(f"_e{i}"), F.count_if(inside(i)).alias(f"_m{i}"))]
        grid = [F.percentile_approx(F.when(inside(i), v), F.array(*(F.lit(x / CELLS) for x in range(CELLS + 1))), 10_000).alias(f"_g{i}") for i in range(len(ranks))]
        held = kept(both.groupBy(*map(col, keys)).agg(*counts, *grid).join(state, keys) if keys else both.agg(*counts, *grid).crossJoin(state), "quantiles")
        most = held.agg(F.greatest(F.lit(0), F.lit(0), *(F.max(f"_m{i}") for i in range(len(ranks))))).first()[0] or 0
        if most <= GATHERED:
            break
        state = kept(held.select(*map(col, keys), "_n", *(x for i in range(len(ranks)) for x in (F.col(f"_r{i}"), *_narrowed(i)))), "quantiles")
    side = held.drop(*(f"_g{i}" for i in range(len(ranks))))
    side = F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
    both = data.join(side, keys) if keys else data.crossJoin(side)
    lists = [F.array_sort(F.collect_list(F.when((v > F.col(f"_a{i}")) & (v < F.col(f"_b{i}")), v))).alias(f"_l{i}") for i in range(len(ranks))]
    last = both.groupBy(*map(col, keys)).agg(*lists).join(side, keys) if keys else both.agg(*lists).crossJoin(side)

    def found(i: int) -> Column:
        place = F.col(f"_r{i}") - F.col(f"_u{i}") - F.col(f"_e{i}")
        return F.when(place < 0, F.col(f"_a{i}")).when(place < F.col(f"_m{i}"), F.try_element_at(f"_l{i}", (place + 1).cast("int"))).otherwise(F.col(f"_b{i}"))

    def between(j: int) -> Column:
        low, high, share = found(2 * j), found(2 * j + 1), at(j) - F.floor(at(j))
        return F.when((low == high) | (share == 0), low).otherwise(low * (1 - share) + high * share)

    out = last.select(*map(col, keys), *(between(j).alias(n) for j, n in enumerate(names)))
    return df.select(*map(col, keys)).distinct().join(out, keys, "left") if keys else out


def _narrowed(i: int) -> tuple[Column, Column]:
    """The next window of a rank. If its value is that of an end, the window is that value; a cell more on each side is within
    the sketch's error."""
    low, high, grid = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_g{i}")
    place = F.col(f"_r{i}") - F.col(f"_u{i}") - F.col(f"_e{i}")
    cell = F.floor(place * CELLS / F.greatest(F.lit(1), F.col(f"_m{i}"))).cast("int")
    inner = (place >= 0) & (place < F.col(f"_m{i}"))
    a = F.when(cell < 1, low).otherwise(F.try_element_at(grid, F.greatest(F.lit(1), cell)))
    b = F.when(cell > CELLS - 3, high).otherwise(F.try_element_at(grid, F.least(F.lit(CELLS + 1), cell + 3)))
    small = F.col(f"_m{i}") <= GATHERED
    return F.when(small, low).when(place < 0, low).when(~inner, high).otherwise(a).alias(f"_a{i}"), F.when(small, high).when(place < 0, low).when(~inner, high).otherwise(b).alias(f"_b{i}")
