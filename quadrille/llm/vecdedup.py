"""Operator 4: near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import components, materialise

#: Vectors that the principal dimensions and the blocks' borders are fitted on; every vector is joined, whatever they are.
SAMPLE = 4096
DIMENSIONS = 8
LEAF = 256
#: Bytes of a block's vectors in double precision, and vectors; a task joins two blocks. Blocks for small tables, for the
#: sake of parallel tasks.
BLOCK_BYTES, BLOCK_VECTORS, LEAST_BLOCKS = 16 << 20, 32_768, 8


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    scaled = vectors / top
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Grid:
    """Leading principal dimensions of a sample and the grid order on them: cells of width epsilon, then the values."""

    def __init__(self, sample: np.ndarray, threshold: float, blocks: int, dimensions: int = DIMENSIONS) -> None:
        self.epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
        _, axes = np.linalg.eigh(sample.T @ sample)
        self.axes = axes[:, ::-1]
        self.dimensions = min(dimensions, sample.shape[1])
        points = self.project(sample)
        points = points[self.order(points)]
        self.borders = [self.key(points[i * len(points) // blocks : i * len(points) // blocks + 1])[0] for i in range(1, blocks)] if len(points) >= blocks else []

    def project(self, units: np.ndarray) -> np.ndarray:
        """All principal coordinates, so that distances are kept; the order uses the leading ones."""
        return units @ self.axes

    def key(self, points: np.ndarray) -> list[tuple[float, ...]]:
        lead = points[:, : self.dimensions]
        return list(map(tuple, np.concatenate((np.floor(lead / self.epsilon), lead), axis=1).tolist()))

    def order(self, points: np.ndarray) -> np.ndarray:
        lead = points[:, : self.dimensions]
        cells = np.floor(lead / self.epsilon)
        return np.lexsort((*lead.T[::-1], *cells.T[::-1]))

    def block(self, points: np.ndarray) -> list[int]:
        from bisect import bisect_right

        return [bisect_right(self.borders, k) for k in self.key(points)]


def gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """Least distance between two boxes."""
    return float(np.linalg.norm(np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))))


class Forest:
    """Union-find over positions; links come as arrays."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        first = np.concatenate((np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]))
        for part in (first, slice(None)):  # after the first link of each position few distinct pairs of roots are left
            root = self.roots()
            ra, rb = root[a[part]], root[b[part]]
            apart = ra != rb
            for x, y in np.unique(np.column_stack((ra[apart], rb[apart])), axis=0).tolist():
                while self.parent[x] != x:
                    x = self.parent[x]
                while self.parent[y] != y:
                    y = self.parent[y]
                self.parent[max(x, y)] = min(x, y)


class Boxes:
    """Of intervals: the box that its points fill, and a cap, the direction of their mean with the largest angle to it."""

    def __init__(self, points: np.ndarray, units: np.ndarray, threshold: float) -> None:
        self.points, self.units, self.reach = points, units, float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
        self.epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
        self.known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, float]] = {}

    def of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        if (a, b) not in self.known:
            part = self.points[a:b]
            middle = self.units[a:b].mean(axis=0)
            size = float(np.linalg.norm(middle))
            middle = middle / size if size > 0 else middle
            angle = float(np.arccos(np.clip((self.units[a:b] @ middle).min(), -1, 1))) if size > 0 else np.pi
            self.known[a, b] = part.min(axis=0), part.max(axis=0), middle, angle
        return self.known[a, b]

    def apart(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether no point of one interval can be linked with one of the other."""
        low, high, middle, angle = self.of(a, b)
        low_, high_, middle_, angle_ = self.of(c, d)
        if angle + angle_ < np.pi and np.arccos(np.clip(middle @ middle_, -1, 1)) - angle - angle_ > self.reach:
            return True
        return gap(low, high, low_, high_) > self.epsilon


def join(units: np.ndarray, weights: np.ndarray, split: int, grid: Grid, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(weighted links, root) of each vector, and how many pairs were compared. The first `split` vectors are one sequence interval and the rest another,
    joined with each other; with nothing after the split, the interval is joined with itself.

    Both are in grid order. Two intervals whose boxes are farther apart than epsilon, or whose caps than the angle of a
    link, are skipped; otherwise the longer one is halved, down to leaves, which one matrix product compares in double
    precision.
    """
    boxes, compared = Boxes(grid.project(units), units, threshold), 0
    links, forest = np.zeros(len(units), np.int64), Forest(len(units))
    whole = (0, split)
    todo = [(*whole, *(whole if split == len(units) else (split, len(units))))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or ((a, b) != (c, d) and boxes.apart(a, b, c, d)):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            compared += (b - a) * (d - c)
            near = units[a:b] @ units[c:d].T >= threshold
            if (a, b) == (c, d):
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                links[a:b] += near @ weights[c:d]
                links[c:d] += weights[a:b] @ near
                forest.link(a + i, c + j)
        elif (a, b) == (c, d):
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
        else:
            todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
    return links, forest.roots(), compared


def _pairs_joined(shared, dim: int, threshold: float):
    def solve(pair: int, side: np.ndarray, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch | None:
        grid = shared.value
        units = unit(vectors)
        points = grid.project(units)
        parts = [np.flatnonzero(side == k) for k in (0, 1)]
        at = np.concatenate([p[grid.order(points[p])] for p in parts])
        links, root, _ = join(units[at], weights[at], len(parts[0]), grid, threshold)
        hit = np.flatnonzero(links)
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[at][hit]), pa.array(links[hit]), pa.array(ids[at][root[hit]])], names=["a", "links", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair; a pair may go on in the next batch."""
        kept: list[tuple[np.ndarray, ...]] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if kept and (out := solve(now, *(np.concatenate(x) for x in zip(*kept, strict=True)))) is not None:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = batch.column(0).to_numpy()
            columns = [batch.column(i).to_numpy() for i in (1, 2, 3)] + [matrix(batch.column(4), dim)]
            cuts = [0, *(np.flatnonzero(np.diff(pairs)) + 1).tolist(), len(pairs)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if now is not None and pairs[x] != now:
                    yield from done()
                    kept = []
                now = int(pairs[x])
                kept.append(tuple(c[x:y] for c in columns))
        yield from done()

    return run


def _links_of(reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, links, b) over all pairs of blocks: rep a has so many weighted links there, and is connected with rep b."""
    spark = reps.sparkSession
    n = reps.count()
    blocks = int(max(1, min(LEAST_BLOCKS, n // LEAF), np.ceil(n / min(BLOCK_VECTORS, max(LEAF, BLOCK_BYTES // (8 * dim))))))
    rows = reps.orderBy(F.xxhash64("vector"), "rep").limit(max(SAMPLE, 4 * blocks)).select("vector").collect()
    grid = Grid(unit(np.array([r[0] for r in rows], np.float64)), threshold, blocks)
    shared = spark.sparkContext.broadcast(grid)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = shared.value.project(unit(matrix(batch.column(2), dim)))
            lead = points[:, : shared.value.dimensions]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.block(points), pa.int32()), pa.array(lead.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "block", "lead"])

    kind = reps.schema["vector"].dataType.simpleString()
    placed = materialise(reps.select("rep", "weight", "vector").mapInArrow(place, f"rep long, weight long, vector {kind}, block int, lead array<double>"), "blocks")
    k = grid.dimensions
    extent = placed.groupBy("block").agg(*(f(F.col("lead")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(k))).collect()
    boxes = {r["block"]: (np.array(r[1 : k + 1]), np.array(r[k + 1 :])) for r in extent}
    names = sorted(boxes)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pair, side, block) of the blocks that may have links; pairs are numbered by their blocks."""
        for batch in batches:
            for i in batch.column(0).to_pylist():
                found = [(i * len(names) + j, side, b) for j in range(i, len(names)) if i == j or gap(*boxes[names[i]], *boxes[names[j]]) <= grid.epsilon for side, b in enumerate((names[i], names[j]) if i != j else (names[i],))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["pair", "side", "block"])

    sides = materialise(spark.range(len(names)).mapInArrow(meeting, "pair long, side int, block int"), "block_pairs")
    dealt = placed.join(sides, "block").select("pair", "side", "rep", "weight", "vector")
    return dealt.repartition(max(1, min(len(names) * (len(names) + 1) // 2, 2000)), "pair").sortWithinPartitions("pair").mapInArrow(_pairs_joined(shared, dim, threshold), "a long, links long, b long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept): links are pairs with a cosine of at least the threshold (0 < threshold <= 1).

    Equal vectors are one weighted representative; no pair is lost, but only counts and a spanning forest of a block
    pair's links leave its task. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do those of different lengths with each other. Null ids are nobody's component_id unless all of a
    component's are null; repeated ids are vectors of their own. No rows, no rows.
    """
    v, x = F.col("_vector"), F.col("_id")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    valid = F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))
    reps = given.where(valid).groupBy("_vector").agg(F.min(x).alias("low"), F.count("*").alias("weight"))
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("rep"), "low", "weight", F.col("_vector").alias("vector")), "vectors")
    found = None
    for (dim,) in reps.select(F.size("vector")).distinct().collect():
        own = _links_of(reps.where(F.size("vector") == dim), dim, threshold)
        found = own if found is None else found.union(own)
    if found is None:
        return given.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "vector_links")
    roots = materialise(components(found.select("a", "b")), "vector_roots")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    rooted = reps.join(roots, reps["rep"] == roots["node"], "left").join(links, "rep", "left")
    rooted = rooted.select("rep", "vector", "low", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_vector = materialise(rooted.join(least, "root").select("vector", "n_links", "component_id"), "vector_components")
    out = given.join(of_vector, given["_vector"] == of_vector["vector"], "left")
    component = F.when(F.col("vector").isNull(), x).otherwise(F.col("component_id"))
    return out.select(x.alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == x, F.lit(True)).alias("kept"))


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every embedding."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a AS vec_id, a AS reached FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS low FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
