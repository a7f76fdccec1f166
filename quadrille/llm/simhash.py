"""Operator 8: SimHash fingerprints, linked within a Hamming radius through BK-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import components, map_batches, materialise, others_of, plus, texts_of

RADIUS = 2
#: Fingerprints of a BK-tree: how many are aimed at, and how many it may have.
SHARD_PRINTS, MOST_PRINTS = 256, 2048


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64 bits: a bit is 1 if over half of the word shingles' XXH64 have it. 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        set_bits += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """docs' other columns and `out`, the fingerprint as a signed long. A null text counts as empty."""
    others = others_of(docs, text_col, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(map(fingerprint, texts_of(batch, text_col)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(prints.view(np.int64))], names=[*others, out])

    return map_batches(docs.select(*others, text_col), run, plus(docs.select(*others), f"`{out}` long"))


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKTree:
    """A node is a fingerprint; its children are keyed by their integer Hamming distance to it.

    The tree is the one that inserting the distinct values in their order gives; it is built and searched a level at a
    time, for all values or queries at once. `visited` counts the nodes that searches have looked at.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.visited = values, 0
        self.child = np.full((len(values), 65), -1, np.int32)
        waiting = np.arange(1, len(values))
        parent = np.zeros(len(waiting), np.int64)
        while len(waiting):
            edge = parent * 65 + bits_apart(values[waiting], values[parent])
            _, first, which = np.unique(edge, return_index=True, return_inverse=True)
            self.child.reshape(-1)[edge[first]] = waiting[first]
            rest = np.ones(len(waiting), np.bool_)
            rest[first] = False
            parent, waiting = waiting[first][which][rest], waiting[rest]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of (query, value) within the radius: from each node only the edges from d - radius to d + radius of the
        query's distance d to it are followed."""
        asked, found = [], []
        query = np.arange(len(queries) if len(self.values) else 0)
        at = np.zeros(len(query), np.int64)
        while len(query):
            self.visited += len(query)
            d = bits_apart(queries[query], self.values[at])
            hit = d <= radius
            asked.append(query[hit])
            found.append(at[hit])
            edge = np.clip(d[:, None] + np.arange(-radius, radius + 1), 0, 64)  # no value is at 0 from another
            kids = self.child[at[:, None], edge]
            kids[:, 1:][edge[:, 1:] == edge[:, :-1]] = -1
            row, _ = np.nonzero(kids >= 0)
            query, at = query[row], kids[kids >= 0].astype(np.int64)
        return np.concatenate([np.zeros(0, np.int64), *asked]), np.concatenate([np.zeros(0, np.int64), *found])


def shard_links(prints: np.ndarray, radius: int, chunk: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links of a shard's distinct prints (int64), found by its BK-tree."""
    tree = BKTree(prints.view(np.uint64))
    group = np.arange(len(prints))
    out = []
    for begin in range(0, len(prints), chunk):
        a, b = tree.near(tree.values[begin : begin + chunk], radius)
        a += begin
        for i, j in zip(a[b < a].tolist(), b[b < a].tolist(), strict=True):
            if (x := group[i]) != (y := group[j]):
                group[group == max(x, y)] = min(x, y)
                out.append((int(prints[i]), int(prints[j])))
    return out


def _tree_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (combo, key, fp): a shard is a run of equal (combo, key), and may go on in the next batch."""
        parts: list[np.ndarray] = []
        shard = None

        def links() -> Iterator[pa.RecordBatch]:
            prints = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            if found := shard_links(prints, radius) if len(prints) > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            combo, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.concatenate(([0], np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1, [len(fp)]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i == j:
                    continue
                if shard != (combo[i], key[i]):
                    yield from links()
                    parts, shard = [], (combo[i], key[i])
                parts.append(fp[i:j])
        yield from links()

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split(free: int, parts: int) -> list[int]:
    """The set bits of `free` in masks of near equal size."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def refinements(masks: dict[int, int], radius: int) -> dict[int, list[tuple[int, int]]]:
    """For each mask of bits on which a shard's prints agree, with the bits on which linked prints have to agree there: the
    (mask, bits to agree on) of finer shards that have the same links. First the bits that linked prints share, then every
    choice of one block of radius + 1 of the others: at most radius of them can differ."""
    every = (1 << 64) - 1
    return {m: [(due, due)] if due != m else [(m | part, m | part) for part in _split(every & ~m, radius + 1)] for m, due in masks.items()}


def hamming_links(prints: DataFrame, radius: int = RADIUS, shard_prints: int = SHARD_PRINTS, most: int = MOST_PRINTS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `fp` within the radius of each other.

    64 bits fall into radius + 1 blocks, of which two prints that differ in at most `radius` bits agree on one. So for
    each block the prints are dealt into shards of about `shard_prints` by as many of its bits as that takes; each shard
    has a BK-tree, which all its prints search, following only edges within the radius. A shard of more than `most`
    prints, as near copies in great number make, is dealt again by the rest of its block's bits and then by blocks of the
    other bits, until all are within the bound: no task holds more, and no shard's work grows with its square.
    Only a spanning forest of a shard's links is emitted, however dense they are. Shards are dealt by a shuffle and not
    broadcast: together they are all fingerprints, which must not go through the driver.
    """
    if not 0 <= radius <= 15:
        raise ValueError("radius must be from 0 to 15")
    wanted = max(0, math.ceil(math.log2(max(1, prints.count()) / shard_prints)))
    masks = {0: 0}  # few enough for one shard
    if wanted:
        blocks = _split((1 << 64) - 1, radius + 1)
        masks = {sum(1 << b for b in [b for b in range(64) if block >> b & 1][-wanted:]): block for block in blocks}
    to = lambda pairs: F.explode(F.array(*(F.struct(F.lit(_signed(m)).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in pairs)))
    dealt = prints.select("fp", to(masks).alias("s")).select("s.combo", "s.key", "fp")
    ready: DataFrame | None = None
    while True:
        crowded = dealt.groupBy("combo", "key").count().where(F.col("count") > most).select("combo", "key")
        free = min(64 - m.bit_count() for m in masks)
        if 2**free <= most or crowded.isEmpty():
            ready = dealt if ready is None else ready.unionByName(dealt)
            break
        crowded = materialise(crowded, "crowded")
        fits = dealt.join(crowded, ["combo", "key"], "left_anti").select("combo", "key", "fp")
        ready = fits if ready is None else ready.unionByName(fits)
        finer = refinements(masks, radius)
        of = lambda pairs: F.array(*(F.struct(F.lit(_signed(m)).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m, _ in pairs))
        cases = None
        for m, pairs in finer.items():
            cases = F.when(F.col("combo") == _signed(m), of(pairs)) if cases is None else cases.when(F.col("combo") == _signed(m), of(pairs))
        again = dealt.join(crowded, ["combo", "key"], "left_semi").select("fp", F.explode(cases).alias("s")).select("s.combo", "s.key", "fp")
        dealt = materialise(again.distinct(), "finer_shards")
        masks = {m: due for pairs in finer.values() for m, due in pairs}
    return ready.repartition("combo", "key").sortWithinPartitions("combo", "key", "fp").mapInArrow(_tree_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links of at most `radius` bits.

    Null and empty texts have fingerprint 0 and link like any other. Null ids have fingerprints and component_ids but
    are nobody's component_id unless they are all that the component has. Repeated rows stay repeated. No rows, no rows.
    """
    prints = materialise(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text"), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("_id").alias("low")), "distinct_fp")
    roots = materialise(components(hamming_links(distinct.select("fp"))), "fp_roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = materialise(rooted.join(least, "root").select("fp", "component_id"), "fp_components")
    return prints.join(of_fp, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
