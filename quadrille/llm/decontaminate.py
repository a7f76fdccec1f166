"""Operator 1: benchmark decontamination with an FM-index per training shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, materialise, plus, texts_of, words_of

WINDOW = 13
#: Words of training text that one FM-index covers; a longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Bytes of benchmark text whose windows are broadcast at once, some 80 MB of them; a larger benchmark is searched in blocks.
BLOCK_BYTES = 8 << 20


class Ranks:
    """A bit vector with constant-time rank: 64-bit words, a running count before each, and a popcount."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.bool_)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.bool_)


class WaveletMatrix:
    """Ranks of symbols: a level for each bit, from the highest; zeros of a level go before its ones on the next."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels: list[Ranks] = []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b & 1).astype(np.bool_)
            self.levels.append(Ranks(ones))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(at)
        for k, level in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - k) & 1).astype(np.bool_)
            ones_at, ones_low = level.ones(at), level.ones(low)
            at = np.where(one, level.zeros + ones_at, at - ones_at)
            low = np.where(one, level.zeros + ones_low, low - ones_low)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for level in self.levels:
            one = level.get(at)
            ones_at, ones_low = level.ones(at), level.ones(low)
            symbol = symbol << 1 | one
            at = np.where(one, level.zeros + ones_at, at - ones_at)
            low = np.where(one, level.zeros + ones_low, low - ones_low)
        return symbol, at - low


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order, by prefix doubling on the groups that are still open. s ends in 0; each 0 is a symbol of
    its own, ordered by position, so no comparison runs past one and repeats end at the first of them."""
    order = np.argsort(s, kind="stable")
    sorted_s = s[order]
    slot = np.arange(len(s))
    head = np.concatenate(([True], sorted_s[1:] != sorted_s[:-1])) | (sorted_s == 0)
    first = np.maximum.accumulate(np.where(head, slot, 0))
    rank = np.empty(len(s), np.int64)
    rank[order] = first
    open_slots = slot[~head | np.append(~head[1:], False)]
    step = 1
    while len(open_slots):
        group = first[open_slots]
        at = order[open_slots]
        key = group * (len(s) + 1) + rank[at + step]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[open_slots] = at
        head = np.concatenate(([True], key[1:] != key[:-1]))
        start = open_slots[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        first[open_slots] = start
        rank[at] = start
        open_slots = open_slots[~head | np.append(~head[1:], False)]
        step *= 2
    return order


class FMIndex:
    """Over symbols 1..n_symbols and 0 for whatever no pattern holds. Patterns hold no 0."""

    def __init__(self, s: np.ndarray, n_symbols: int, sample: int = 32) -> None:
        order = suffix_order(s)
        before = s[order - 1]
        before[order == 0] = 0
        self.wavelet = WaveletMatrix(before, max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=n_symbols + 1)))).astype(np.int64)
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.samples = Ranks(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of the patterns (rows, padded on the right), found from the last symbol backwards."""
        last = patterns[np.arange(len(patterns)), lengths - 1]
        low, high = self.first[last].copy(), self.first[last + 1].copy()
        alive = np.flatnonzero((low < high) & (lengths > 1))
        k = 2
        while len(alive):
            c = patterns[alive, lengths[alive] - k]
            low[alive] = self.first[c] + self.wavelet.rank(c, low[alive])
            high[alive] = self.first[c] + self.wavelet.rank(c, high[alive])
            alive = alive[(low[alive] < high[alive]) & (lengths[alive] > k)]
            k += 1
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back until a row with a sampled position."""
        out, steps, todo = np.zeros_like(rows), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.kept.get(rows[todo])
            hit = todo[done]
            out[hit] = self.samples[self.kept.ones(rows[hit])] + steps
            todo = todo[~done]
            if len(todo):
                symbol, rank = self.wavelet.access(rows[todo])
                rows[todo] = self.first[symbol] + rank
                steps += 1
        return out


@dataclass(frozen=True)
class Windows:
    """Distinct windows as rows of word symbols, padded with 0, with their lengths; window w is in the items
    names[owner[first[w] : first[w + 1]]]."""

    symbols: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    names: list[str]

    def items_of(self, windows: np.ndarray) -> list[str]:
        found = [self.owner[self.first[w] : self.first[w + 1]] for w in windows.tolist()]
        return sorted({self.names[i] for i in np.unique(np.concatenate(found)).tolist()}) if found else []


def windows_of(items: list[tuple[object, bytes | None]], width: int = WINDOW) -> Windows:
    """An item shorter than a window is one window; an item without words has none. Items of one id are one, those without
    an id are one with an empty name."""
    symbols: dict[bytes, int] = {}
    names = sorted({"" if item is None else str(item) for item, _ in items})
    place = {name: i for i, name in enumerate(names)}
    rows, lengths, owner = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int8)], [np.zeros(0, np.int32)]
    for item, text in items:
        ids = np.array([symbols.setdefault(w, len(symbols) + 1) for w in words_of(text)], np.int32)
        if not len(ids):
            continue
        if len(ids) < width:
            found = np.zeros((1, width), np.int32)
            found[0, : len(ids)] = ids
        else:
            found = np.lib.stride_tricks.sliding_window_view(ids, width)
        rows.append(found)
        lengths.append(np.full(len(found), min(width, len(ids)), np.int8))
        owner.append(np.full(len(found), place["" if item is None else str(item)], np.int32))
    every, of, size = np.concatenate(rows), np.concatenate(owner), np.concatenate(lengths)
    order = np.lexsort((of, *every.T[::-1]))
    every, of, size = every[order], of[order], size[order]
    new = np.concatenate(([True], (every[1:] != every[:-1]).any(axis=1))) if len(every) else np.zeros(0, np.bool_)
    first = np.append(np.flatnonzero(new), len(every))
    return Windows(symbols, every[new], size[new].astype(np.int64), first, of, names)


def scan_shard(docs: list[list[bytes]], windows: Windows) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(n_hit, merged spans of word positions, sorted item ids) for each document of a shard, by its FM-index."""
    symbols, patterns, lengths = windows.symbols, windows.rows, windows.lengths
    sizes = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    text = np.zeros(starts[-1], np.int64)
    for words, at in zip(docs, starts.tolist(), strict=False):
        text[at : at + len(words)] = np.fromiter(map(symbols.get, words, repeat(0)), np.int64, len(words))
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(0, [], []) for _ in docs]
    if not len(patterns) or not text.any():
        return out
    keep = np.flatnonzero((text != 0) | np.concatenate(([True], text[:-1] != 0)))  # of a run of zeros the first is enough
    if text[keep[-1]]:
        keep = np.append(keep, len(text) - 1)
    index = FMIndex(text[keep], len(symbols))
    low, high = index.search(patterns, lengths)
    hit = np.flatnonzero(low < high)
    if not len(hit):
        return out
    times = (high - low)[hit]
    which = np.repeat(hit, times)
    rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[hit], times)
    at = keep[index.locate(rows)]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths[which], -1)
    covered = np.cumsum(edge[:-1]) > 0
    doc = np.searchsorted(starts, at, side="right") - 1
    pairs = np.unique(doc * len(patterns) + which)
    owners_doc, owners_window = pairs // len(patterns), pairs % len(patterns)
    for d, window in zip(*(np.split(x, np.flatnonzero(np.diff(owners_doc)) + 1) for x in (owners_doc, owners_window)), strict=True):
        d = int(d[0])
        mine = np.flatnonzero(np.diff(np.concatenate(([False], covered[starts[d] : starts[d + 1]], [False]))))
        spans = list(zip(mine[::2].tolist(), mine[1::2].tolist(), strict=True))
        out[d] = (sum(b - a for a, b in spans), spans, windows.items_of(window))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(shared, shard_words: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        docs: list[list[bytes]] = []
        words = 0

        def flush() -> pa.RecordBatch:
            found = scan_shard(docs, shared.value)
            items = [x[2] for x in found]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(map(len, docs), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in found], _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=[id_col, "n_words", "n_hit", "spans", "items"],
            )

        for batch in batches:
            column, texts, from_ = batch.column(batch.schema.get_field_index(id_col)), texts_of(batch, text_col), 0
            for i, text in enumerate(texts):
                docs.append(words_of(text))
                words += len(docs[-1])
                if words >= shard_words:
                    ids.append(column.slice(from_, i + 1 - from_))
                    yield flush()
                    ids, docs, words, from_ = [], [], 0, i + 1
            if from_ < len(texts):
                ids.append(column.slice(from_))
        if docs:
            yield flush()

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, spans, items) for each document: spans are the merged word intervals [start, end) to remove,
    items the sorted ids of benchmark items of which a window occurs.

    Null and empty texts have no words and no hits; items without a text no windows; items without an id count as one,
    listed as an empty string; repeated item rows count once; repeated document rows stay. An empty benchmark hits nothing. The benchmark's size is checked: beyond block_bytes its items
    are searched in blocks, one broadcast at a time, and each document's spans are merged afterwards.
    """
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    ddl = "n_words long, n_hit long, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    own = docs.select(id_col, text_col) if blocks == 1 else materialise(docs.select(id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    parts = []
    for k in range(blocks):
        block = benchmark.where(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == k) if blocks > 1 else benchmark
        rows = [(r[0], r[1].encode() if r[1] is not None else None) for r in block.select(item_col, item_text_col).collect()]
        shared = spark.sparkContext.broadcast(windows_of(rows, width))
        if blocks == 1:
            return map_batches(own, _scan(shared, shard_words, id_col, text_col), plus(docs.select(id_col), ddl))
        keyed = own.select(F.struct("_row", id_col).alias("_key"), text_col)
        parts.append(materialise(map_batches(keyed, _scan(shared, shard_words, "_key", text_col), plus(keyed.select("_key"), ddl)), "decontaminate_block"))
        shared.unpersist()
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    merged = every.groupBy("_key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) -> if(size(a) > 0 and element_at(a, -1).end >= s.start, concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))), concat(a, array(s))))"
    merged = merged.withColumn("spans", F.expr(step)).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"))
    return merged.select(f"_key.{id_col}", "n_words", "n_hit", "spans", "items")


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds n_items, items_sha256 and contaminated: at least one word in twenty is hit."""
    return (
        found.withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the removal spans, for every document."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = with_verdict(overlaps(docs, items))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias("spans"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(words), 13) AS n, array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, p, n, array_to_string(words[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM w, lens WHERE len(words) >= n)),
hits AS (SELECT g.doc_id, g.p, g.n, wins.item FROM grams g JOIN wins ON g.win = wins.win AND g.n = wins.n),
words_hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
cover AS (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS island FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits)),
spans AS (SELECT doc_id, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM (SELECT doc_id, min(q) - 1 AS a, max(q) AS z FROM cover GROUP BY doc_id, island) GROUP BY doc_id)
SELECT w.doc_id, coalesce(CAST(len(words) AS BIGINT), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(words), 0) AS contaminated, coalesce(spans, '') AS spans
FROM w LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
