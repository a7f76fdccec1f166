"""Operator 13: hard negatives by bit-sliced integer products."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import discard, materialise

#: Vectors of a block, and their bytes in double precision; a task holds a block of rows and one of anchors.
BLOCK_VECTORS, BLOCK_BYTES = 65_536, 32 << 20
#: Blocks of rows that small tables are cut into for the sake of parallel tasks, of at least so many rows.
SPREAD, SPREAD_ROWS = 16, 256
#: Scores that a tile of anchors has at a time.
TILE = 2 << 20
#: Share of pairs below which single pairs go on instead of whole products.
SPARSE = 0.25
#: Products are exact in doubles below this.
EXACT = float(1 << 52)


class Planes:
    """Components of rows as bit-planes in two's complement: the sign, then bits from the most significant."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values.astype(np.int64)
        top = max(int(self.values.max(initial=0)), -int(self.values.min(initial=0)) - 1, 1)
        self.bits = top.bit_length()

    def weight(self, k: int) -> int:
        return -(1 << k) if k == self.bits else 1 << k

    def plane(self, k: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return (self.values[rows] >> k & 1).astype(np.float64)


def products(anchors: np.ndarray, planes: Planes, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], tighten: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, row, score) of the pairs that may qualify, and how many pairs went through how many planes in all.

    After plane k a score lies between the sum so far plus (2^k - 1) times the anchor's negative and its positive
    components. `keep` says of whole matrices of such intervals which pairs go on; once few are left, `tighten` does so of
    single pairs (anchor, row, low, high), and only those meet the planes below.
    """
    n, low_sum, high_sum = len(planes.values), np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)
    score = np.zeros((len(anchors), n))
    k, work = planes.bits, 0
    alive = np.ones(score.shape, np.bool_)
    while k >= 0:
        score += planes.weight(k) * (anchors @ planes.plane(k).T)
        work += score.size
        rest = float((1 << k) - 1)
        alive = keep(score + rest * low_sum[:, None], score + rest * high_sum[:, None])
        k -= 1
        if np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    a, r = np.nonzero(alive)
    found = score[a, r]
    while len(a):
        rest = float((1 << (k + 1)) - 1)
        on = tighten(a, r, found + rest * low_sum[a], found + rest * high_sum[a])
        a, r, found = a[on], r[on], found[on]
        if k < 0:
            break
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            found[part] += planes.weight(k) * np.einsum("ij,ij->i", anchors[a[part]], planes.plane(k, r[part]))
        work += len(a)
        k -= 1
    return a, r, found.astype(np.int64), work


def _kth(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest value of each group; -inf where it has fewer."""
    order = np.lexsort((-value, group))
    g = group[order]
    start = np.searchsorted(g, np.arange(groups))
    out = np.full(groups, -np.inf)
    has = np.flatnonzero(np.bincount(g, minlength=groups) >= k)
    out[has] = value[order[start[has] + k - 1]]
    return out


def best_of(anchors: np.ndarray, own: np.ndarray, planes: Planes, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, row, score) of each anchor's k best rows and of those that tie with the last; a row of the anchor's own id
    isn't one."""
    other = own[:, None] != ids[None, :]

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if low.shape[1] <= k:
            return other
        low = np.where(other, low, -np.inf)
        return other & (high >= np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k][:, None])

    def tighten(a: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= _kth(a, low, k, len(anchors))[a]

    return products(anchors, planes, keep, tighten)


def in_windows(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray, planes: Planes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, row, score) of rows that may be among the k best of one of the anchor's windows lows <= score <= highs, ties
    with the last included. Windows are rows of as many columns; an empty one has low above high."""
    sound = lows <= highs
    hull_low = np.where(sound, lows, np.inf).min(axis=1, initial=np.inf)
    hull_high = np.where(sound, highs, -np.inf).max(axis=1, initial=-np.inf)

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (high >= hull_low[:, None]) & (low <= hull_high[:, None])

    def tighten(a: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        on = np.zeros(len(a), np.bool_)
        for w in range(lows.shape[1]):
            least, most = lows[a, w], highs[a, w]
            sure = np.flatnonzero((low >= least) & (high <= most))
            floor = _kth(a[sure], low[sure], k, len(anchors))[a]
            on |= (high >= least) & (low <= most) & (high >= floor)
        return on

    return products(anchors, planes, keep, tighten)


def _exactly(anchors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, held to 64 bits at last."""
    big = np.array([[int(x) for x in row] for row in anchors], object).reshape(anchors.shape) @ np.array([[int(x) for x in row] for row in values], object).reshape(values.shape).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64) if big.size else np.zeros((len(anchors), len(values)), np.int64)


def _vectors(table: pa.Table, scale: int) -> np.ndarray:
    column = table.column("_v").combine_chunks()
    width = len(column[0]) if len(column) else 0
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), width)


def _tiles(anchors: pa.Table, rows: pa.Table, scale: int, of_rows: Callable[[int, np.ndarray], np.ndarray], solve: Callable) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Anchors of one label at a time meet the rows that of_rows(label, labels) names, by solve(anchors' positions,
    anchors' values, planes, rows' positions); where products could leave the doubles' whole numbers, they are made in Python's."""
    av, rv = _vectors(anchors, scale), _vectors(rows, scale)
    al, rl = (t.column("_label").to_numpy() for t in (anchors, rows))
    found: tuple[list, list, list] = ([], [], [])
    for label in np.unique(al):
        at, with_ = np.flatnonzero(al == label), np.flatnonzero(of_rows(label, rl))
        if not len(with_):
            continue
        reach = np.abs(av[at]).max(initial=1) * max(1, av.shape[1])
        wide = np.abs(rv[with_]).max(axis=1, initial=0) * 4 * reach >= EXACT
        plain = with_[~wide]
        planes = Planes(rv[plain])
        step = max(1, TILE // max(1, len(with_)))
        for i in range(0, len(at), step):
            tile = at[i : i + step]
            if len(plain):
                a, r, s, _ = solve(tile, av[tile], planes, plain)
                for x, y in zip(found, (tile[a], plain[r], s), strict=True):
                    x.append(y)
            if wide.any():
                s = _exactly(av[tile], rv[with_[wide]])
                a, r = np.indices(s.shape).reshape(2, -1)
                for x, y in zip(found, (tile[a], with_[wide][r], s.ravel()), strict=True):
                    x.append(y)
    return found


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _empty(names: list[str]) -> pa.Table:
    return pa.table({n: pa.array([], pa.int64()) for n in names})


def _positives(k: int, scale: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["_anchor", "_id", "_score"]

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _empty(names)
        own, ids = anchors.column("_id").to_numpy(), rows.column("_id").to_numpy()
        a, r, s = map(_joined, _tiles(anchors, rows, scale, lambda label, labels: labels == label, lambda tile, values, planes, at: best_of(values, own[tile], planes, ids[at], k)))
        on = own[a] != ids[r]
        return _first(anchors.column("_anchor").to_numpy()[a[on]], np.zeros(int(on.sum()), np.int64), ids[r[on]], s[on], k, names)

    return run


def _first(group: np.ndarray, window: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, names: list[str]) -> pa.Table:
    """The k rows of each group and window with the highest scores, smaller ids first."""
    order = np.lexsort((ids, -scores, window, group))
    g, w = group[order], window[order]
    new = np.ones(len(order), np.bool_)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    kept = order[np.arange(len(order)) - start < k]
    columns = {"_anchor": group[kept], "_window": window[kept], "_id": ids[kept], "_score": scores[kept]}
    return pa.table({n: pa.array(columns[n], pa.int64()) for n in names})


def _negatives(k: int, scale: int, least: tuple[int, int], most: tuple[int, int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["_anchor", "_window", "_id", "_score"]

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _empty(names)
        ids, numbers = rows.column("_id").to_numpy(), anchors.column("_anchor").to_numpy()
        lists = anchors.column("_scores").to_pylist()
        width = max(map(len, lists), default=0)
        lows, highs = np.ones((len(lists), width), np.int64), np.zeros((len(lists), width), np.int64)  # empty where there is no positive
        for i, own in enumerate(lists):
            lows[i, : len(own)] = [-(-least[0] * p // least[1]) for p in own]
            highs[i, : len(own)] = [most[0] * p // most[1] for p in own]
        a, r, s = map(_joined, _tiles(anchors, rows, scale, lambda label, labels: labels != label, lambda tile, values, planes, at: in_windows(values, lows[tile].astype(np.float64), highs[tile].astype(np.float64), planes, k)))
        out = [_empty(names)]
        for w in range(width):
            on = (s >= lows[a, w]) & (s <= highs[a, w])
            out.append(_first(numbers[a[on]], np.full(int(on.sum()), w), ids[r[on]], s[on], k, names))
        return pa.concat_tables(out)

    return run


def _meet(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(anchors, rows) of every block of anchors with every block of rows. A row is copied once for each block of anchors,
    an anchor once for each block of rows."""
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("_a", of("_anchor", blocks[0])).withColumn("_r", each(blocks[1]))
    right = rows.select(*(F.col(c).alias(c) for c in rows.columns), of("_row", blocks[1]).alias("_r"), each(blocks[0]).alias("_a"))  # columns of its own, which cogroup() tells apart
    cell = ["_dim", "_a", "_r"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, schema)


def mined(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3, least: tuple[int, int] = (50, 100), most: tuple[int, int] = (95, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor its first `positives`
    other rows of the same label, and for each of these the first `negatives` rows of other labels whose score is from
    least to most times the positive's. Scores are inner products of floor(scale * component); higher ones come first, then
    smaller ids.

    Rows with a null id, label or vector, or with components that are null or not finite (once scaled) take no part; rows of
    one id are no positives of each other, but otherwise rows of their own, and an anchor's id that repeats gives rows for
    each. Vectors of different lengths don't meet; empty ones score 0. Scores beyond 64 bits are held to the
    largest long. Anchors without positives, and positives without negatives, give no rows; no rows, no rows.

    Blocks of rows and of anchors, bounded in size, meet in pairs; each keeps the best of its rows only. There, components'
    bit-planes are multiplied from the most significant on, which leaves each score an interval that halves with every
    plane: rows whose intervals can't reach the best so far, or the window of any positive, are dropped, and only what is
    left meets the planes below. Two counts are all that comes to the driver.
    """
    v = F.col("_v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < float("inf")))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), (F.col("label") if label is None else label).cast("long").alias("_label"), is_anchor.alias("_is"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & v.isNotNull() & finite)
    written = materialise(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_label", "_v", F.size("_v").alias("_dim"), F.coalesce("_is", F.lit(False)).alias("_is")), "mined_rows")
    n, asked, dim = written.agg(F.count("*"), F.count_if("_is"), F.max("_dim")).first()
    most_in = min(BLOCK_VECTORS, max(1, BLOCK_BYTES // (8 * max(1, dim or 1))))
    blocks = max(1, -(-asked // most_in)), max(1, -(-n // most_in), min(SPREAD, n // SPREAD_ROWS))
    anchors = written.where("_is").select(F.col("_row").alias("_anchor"), "_id", "_label", "_v", "_dim")
    rows = written.drop("_is")
    first = Window.partitionBy("_anchor").orderBy(F.desc("_score"), "_id")
    near = _meet(anchors, rows, blocks, _positives(positives, scale), "_anchor long, _id long, _score long")
    near = near.withColumn("_window", F.row_number().over(first) - 1).where(F.col("_window") < positives)
    near = materialise(near, "mined_positives")
    lists = near.groupBy("_anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("_window", "_score"))), lambda x: x["_score"]).alias("_scores"))
    found = _meet(anchors.join(lists, "_anchor"), rows, blocks, _negatives(negatives, scale, least, most), "_anchor long, _window long, _id long, _score long")
    within = Window.partitionBy("_anchor", "_window").orderBy(F.desc("_score"), "_id")
    found = found.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= negatives).select("_anchor", "_window", "rank", F.col("_id").alias("negative_id"), F.col("_score").alias("negative_score"))
    of_anchor = anchors.select("_anchor", F.col("_id").alias("anchor_id"))
    named = near.join(of_anchor, "_anchor").select("_anchor", "_window", "anchor_id", F.col("_id").alias("positive_id"), F.col("_score").alias("positive_score"))
    out = found.join(named, ["_anchor", "_window"])
    out = materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined")
    discard(near, written)
    return out


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label=label)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""
