"""Near copies by word shingles: all links of Jaccard similarity 0.8 or more, found without comparing all pairs.

Fingerprints of such pairs differ in 11 bits and more, where no dealing of prints is selective, so BK-trees find the closest
copies only. The others come from shared prefix shingles, which all pairs at the similarity have, and a sketch that
provably bounds how far two sets are apart. Whatever is linked is checked on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm import shingles
from quadrille.llm.common import components, discard, map_batches, materialise, plus, texts_of
from quadrille.llm.simhash import hamming_links

#: Words of a shingle and Jaccard similarity of near copies.
WIDTH, SIMILARITY = 5, 0.8
#: Texts from which common shingles are learned, and how many of those count, for the order of shingles only.
ORDER_SAMPLE, ORDER_MOST = 4000, 200_000
#: Sets of one shingle that meet in a task; more are dealt in blocks.
BLOCK = 1024


def text_key(text: Column) -> Column:
    """128 bits that are equal for copies of a text; a null and an empty text are alike."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(7), whole).alias("b"))


def _set_of(text: bytes | None) -> np.ndarray:
    return shingles.shingle_sets([text], WIDTH)[0]


def _node(found: np.ndarray) -> int:
    """Equal for equal sets, a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).astype(np.int64))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingles.shingle_sets(texts_of(batch, "_text"), WIDTH)
        sketches = [shingles.sketch(x) for x in sets]
        prints = [np.packbits(2 * shingles.bit_counts(x) > len(x), bitorder="little").view("<i8")[0] for x in sets]
        made = [pa.array(list(map(_node, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(prints, pa.int64()), pa.array([x.tobytes() for x in sketches], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["_id", "_key", "node", "n", "fp", "sketch"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *shingles.shingle_sets(texts_of(batch, "_text"), WIDTH)]).view(np.int64))], names=["h"])


def _prefixes(common: np.ndarray, similarity: float):
    """(h, node, hot) of the prefixes of the sets; hot ones are common in the sample and so in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts, nodes = [np.zeros(0, np.uint64)], []
            for found in shingles.shingle_sets(texts_of(batch, "_text"), WIDTH):
                if len(found) and (node := _node(found)) not in seen:
                    seen.add(node)
                    parts.append(shingles.prefix(found, common, similarity))
                    nodes.append(np.full(len(parts[-1]), node, np.int64))
            h = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *nodes])), pa.array(np.isin(h, common))], names=["h", "node", "hot"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, node, hot), sorted by (h, node): those of shingles that several sets have, once each. Hot ones, whose rows
    are dealt to several tasks, all stay."""
    h, node, keep = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_)
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        h, node, keep = (np.concatenate(x) for x in zip((h, node, keep), columns, strict=True))
        if not len(h):
            continue
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1]))))
        h, node, keep = h[new], node[new], np.logical_or.reduceat(keep, new)
        same = h[1:] == h[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(h[:-1][keep[:-1]]), pa.array(node[:-1][keep[:-1]])], names=["h", "node"])
        h, node, keep = h[-1:], node[-1:], keep[-1:]
    yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(node[keep])], names=["h", "node"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The runs of equal first columns, whole; a run may go on in the next batch."""
    parts: list[list] = []
    last = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = np.stack([c.astype(np.int64) for c in columns[:keys]])
        cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if i == j:
                continue
            if last != (last := tuple(key[:, i].tolist())) and parts:
                yield [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts = []
            parts.append([c[i:j] for c in columns])
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


class _Sketches:
    """The sketches of a group, each folded to any smaller size once."""

    def __init__(self, raw: np.ndarray) -> None:
        self.words = [np.frombuffer(x, "<u8") for x in raw]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.folds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(the sketches of this size or more as rows, at which row each stands)."""
        if size not in self.folds:
            able = self.sizes >= size
            self.folds[size] = np.stack([shingles.folded(self.words[i], size) for i in np.flatnonzero(able).tolist()]), np.cumsum(able) - 1
        return self.folds[size]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the pairs differ, by the largest sketches that both have."""
        out, common = np.zeros(len(x), np.int64), np.minimum(self.sizes[x], self.sizes[y])
        for size in np.unique(common).tolist():
            rows, at = self.folded(size)
            pairs = np.flatnonzero(common == size)
            for i in range(0, len(pairs), step := max(1, (1 << 18) // size)):
                some = pairs[i : i + step]
                out[some] = np.bitwise_count(rows[at[x[some]]] ^ rows[at[y[some]]]).sum(axis=1, dtype=np.int64)
        return out


def _candidates(similarity: float, nearest: bool):
    """Rows (h, p, q, side, node, root, n, sketch) sorted by (h, p, q) to pairs of sets of different roots that may be
    similar by their sizes and sketches: all (a, b), or for each set its nearest (a, b, apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, side, node, root, n, raw in _groups(batches, 3):
            sketches = _Sketches(raw)
            coarse, _ = sketches.folded(int(sketches.sizes.min()))
            left, right = (np.flatnonzero(side != s) for s in (1, 0))
            for i in range(0, len(left), 64):
                rows = left[i : i + 64]
                total = n[rows][:, None] + n[right][None]
                fits = (root[rows][:, None] != root[right][None]) & (np.minimum(n[rows][:, None], n[right][None]) >= similarity * np.maximum(n[rows][:, None], n[right][None]) - 1e-9)
                fits &= np.bitwise_count(coarse[rows][:, None] ^ coarse[right][None]).sum(axis=2, dtype=np.int64) <= shingles.most_apart(total, similarity)
                x, y = np.nonzero(fits)
                apart = sketches.apart(rows[x], right[y])
                close = apart <= shingles.most_apart(total[x, y], similarity)
                x, y, share = x[close], y[close], apart[close] / total[x[close], y[close]]
                if not len(x):
                    continue
                if nearest:
                    order = np.lexsort((node[right[y]], share, x))
                    first = order[np.concatenate(([True], x[order][1:] != x[order][:-1]))]
                    out = [node[rows[x[first]]], node[right[y[first]]], share[first]]
                else:
                    ends = node[rows[x]], node[right[y]]
                    out = list(np.unique(np.stack((np.minimum(*ends), np.maximum(*ends))), axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out], names=["a", "b", "apart"][: len(out)])

    return run


def _near_enough(similarity: float):
    """Pairs whose whole sketches and sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(shingles.folded(x, size) ^ shingles.folded(y, size)).sum(dtype=np.int64))
                keep.append(min(n, m) >= similarity * max(n, m) - 1e-9 and apart <= shingles.most_apart(n + m, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(similarity: float, rows: int = 64):
    """Pairs whose sets are similar; the texts of a few pairs at a time are hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                texts = dict(zip(batch.column(0).to_pylist(), texts_of(batch, "ta"), strict=True)) | dict(zip(batch.column(1).to_pylist(), texts_of(batch, "tb"), strict=True))
                sets = dict(zip(texts, shingles.shingle_sets(list(texts.values()), WIDTH), strict=True))
                yield batch.select(["a", "b"]).filter(pa.array([shingles.jaccard(sets[a], sets[b]) >= similarity - 1e-12 for a, b in pairs], pa.bool_()))

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id, text_key, first) for each row: components over links of five-word shingle sets whose Jaccard
    similarity is `similarity` or more; component_id is the smallest id of the component.

    Candidates are checked on the whole sets, in three rounds, each over what the links so far leave apart: copies within
    reach of the BK-trees of fingerprints, and each shingle's least and greatest set with all others that share it; then
    each set's nearest by sketch; then all others that share a prefix shingle and that sizes and sketches allow. So in a
    large group of near copies most links come from the first rounds, whose candidates are as many as its sets; sketches
    are compared, in bounded blocks, for the pairs that those leave apart, and no link is lost.
    Texts without words are alike. A text shorter than a shingle is one. `first` marks the row of a component that stays
    if one does: the smallest id, then the smallest text_key; rows equal in id and text are one document, all first or
    none. Null ids come after all others; a component without ids has a null component_id. No rows, no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    sets = materialise(map_batches(rows, _facts, plus(rows.select("_id", "_key"), "node long, n long, fp long, sketch binary")), "sets")
    facts = materialise(sets.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("_key").alias("_key"), F.min("sketch").alias("sketch")), "facts")
    share = min(1.0, ORDER_SAMPLE / max(1, sets.count()))  # for the order alone: it decides costs, not results
    sampled = map_batches(rows.select("_text").sample(share, 42), _hashes, "h long").groupBy("h").count().where("count > 2")
    common = np.sort(np.array([r.h for r in sampled.orderBy(F.desc("count"), "h").limit(ORDER_MOST).collect()], dtype=np.int64).view(np.uint64))
    prefixes = map_batches(rows.select("_text"), _prefixes(common, similarity), "h long, node long, hot boolean")
    # rows of a shingle meet in one task to see whether it is shared; of hot ones that is known, and they are dealt by set
    dealt = prefixes.repartition(F.when(F.col("hot"), F.xxhash64("h", "node")).otherwise(F.col("h"))).sortWithinPartitions("h", "node")
    shared = materialise(dealt.mapInArrow(_shared, "h long, node long"), "shared_shingles")
    # texts that share a passage share many shingles: of those that the same sets have, one gives all the pairs
    owners = shared.groupBy("h").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    one = owners.groupBy("c", "x", "y").agg(F.min("h").alias("h")).select("h")
    buckets = materialise(shared.join(one, "h", "left_semi"), "buckets")
    discard(shared)
    tried: list[DataFrame] = []
    links: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        """(node, root) over all links so far and those of the new pairs."""
        for old in tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        of = lambda x: facts.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        able = pairs.distinct().join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        able = materialise(map_batches(able, _near_enough(similarity), "a long, b long"), "pairs")
        needed = able.select(F.col("a").alias("node")).union(able.select(F.col("b").alias("node"))).distinct().join(facts.select("node", "_key"), "node")
        texts = materialise(rows.select("_key", "_text").join(needed, "_key").groupBy("node").agg(F.first("_text").alias("_text")), "texts")
        text = lambda x: texts.select(F.col("node").alias(x), F.col("_text").alias(f"t{x}"))
        links.append(materialise(map_batches(able.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb"), _alike(similarity), "a long, b long"), "alike"))
        discard(texts)
        tried.append(able)
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        return materialise(components(every), "set_roots")

    def apart(roots: DataFrame) -> DataFrame:
        """The rows of shingles whose sets have several roots, dealt into bounded groups (h, p, q) in which all pairs of
        different roots meet: the sets of the most frequent root, and the others, in blocks."""
        rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_root = rooted.groupBy("h", "root").agg(F.count("*").alias("c"))
        by_h = by_root.groupBy("h").agg(F.sum("c").alias("c"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
        blocks = lambda x: F.greatest(F.lit(1), F.ceil(x / BLOCK)).cast("int")
        cut = by_h.select("h", "c", F.col("top.root").alias("top"), blocks(F.col("top.c")).alias("g"), blocks(F.col("c") - F.col("top.c")).alias("k"))
        found = rooted.join(cut, "h").withColumn("own", F.expr("cast(pmod(xxhash64(node), if(root = top, g, k)) as int)"))
        groups = F.expr(f"""
            CASE WHEN c <= {2 * BLOCK} THEN array(struct(0 AS p, 0 AS q, 2 AS side))
            WHEN root = top THEN transform(sequence(0, k - 1), p -> struct(p AS p, own AS q, 1 AS side))
            ELSE concat(transform(sequence(0, g - 1), q -> struct(own AS p, q AS q, 0 AS side)),
              transform(sequence(0, k - 1), j -> struct(least(own, j) AS p, -1 - greatest(own, j) AS q, if(j = own, 2, if(own < j, 0, 1)) AS side))) END""")
        spread = found.select("h", "node", "root", F.explode(groups).alias("s")).select("h", "s.*", "node", "root").join(facts.select("node", "n", "sketch"), "node")
        return spread.select("h", "p", "q", "side", "node", "root", "n", "sketch").repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")

    of_print = materialise(facts.groupBy("fp").agg(F.min("node").alias("lo")), "by_print")
    found = hamming_links(of_print.select("fp"))
    end = lambda x: of_print.select(F.col("fp").alias(x), F.col("lo").alias(f"lo_{x}"))
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    close = found.join(end("a"), "a").join(end("b"), "b").select(pair("lo_a", "lo_b").alias("s")).union(facts.join(of_print, "fp").select(pair("node", "lo")))
    ends = buckets.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    stars = buckets.join(ends, "h").select(F.explode(F.array(pair("node", "lo"), pair("node", "hi"))))
    roots = verify(close.union(stars).select("s.*").where("a < b"))
    best = apart(roots).mapInArrow(_candidates(similarity, True), "a long, b long, apart double").groupBy("a").agg(F.min(F.struct("apart", "b")).alias("s"))
    roots = verify(best.select(pair("a", "s.b").alias("s")).select("s.*"))
    roots = verify(apart(roots).mapInArrow(_candidates(similarity, False), "a long, b long"))
    rooted = sets.groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("low").alias("first"))
    of_node = materialise(rooted.join(least, "root").select("node", "first"), "set_components")
    discard(facts, buckets, of_print, *tried, *links)
    out = sets.select("_id", "_key", "node").join(of_node, "node")
    is_first = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_key") == F.col("first._key"))
    return out.select(F.col("_id").alias(id_col), F.col("first._id").alias("component_id"), F.col("_key").alias("text_key"), is_first.alias("first"))
