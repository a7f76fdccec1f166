"""Training sets for retrieval models: enrichment, splits, negatives, checks, lengths, and small analyses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.context import kept
from quadrille.functions.text import near_equal
from quadrille.operators.quantiles import quantiles
from quadrille.retrieval import ranking


def enriched(docs: DataFrame, members: DataFrame, key: str, member: str, heading: str) -> DataFrame:
    """Bodies with their title in brackets before and the sorted members after; aggregated before it is joined."""
    lists = members.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(member)), ", ").alias("_members"))
    return docs.join(lists, key).withColumn("body", F.concat(F.lit("["), F.col("title"), F.lit("] "), F.col("body"), F.lit(f". {heading}: "), F.col("_members"))).drop("_members")


def split(df: DataFrame, group: str, test_share: int = 10, seed: int = 42) -> DataFrame:
    """Adds part, `train` or `test`: a hash of the group decides, so no group is in both."""
    place = F.conv(F.substring(F.md5(F.concat(F.col(group).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("part", F.when(place < test_share, "test").otherwise("train"))


def positives(questions: DataFrame, node_map: DataFrame, question: str = "question", ids: Column | None = None) -> DataFrame:
    """(question, pid) of the tables or nodes that a question's expression names."""
    from quadrille.functions.text import table_ids

    return questions.select(F.col(question), F.explode(ids if ids is not None else table_ids(F.col("sexp"))).alias("id")).join(node_map, "id").select(question, "pid")


def cosine_negatives(vectors: DataFrame, queries: DataFrame, query: str, item: str, group: str, n: int, body: str | None = None, block: int = 4096) -> DataFrame:
    """(query, item, kind): half (rounded up) of the n negatives are the most similar items of another group, half the least.
    vectors: (item, vector, group[, body]); queries: (query, query_vector, group[, body]). The stated queries meet all items
    in blocks, some at once, and a batch passes on only what may be among a query's negatives; near-duplicate bodies are left out where
    bodies are given."""
    halves = {"near": -(-n // 2), "far": n // 2}
    extra = [group, *([body] if body else [])]

    def score(columns: list[list], part: list, items: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = ranking._cosines([r[1] for r in part], columns[0])
        known: dict = {}
        of = lambda values: np.array([-1 if g is None else known.setdefault(g, len(known)) for g in values], np.int64)
        groups, own = of(columns[1].to_pylist()), of(r[2] for r in part)
        allowed = (groups != own[:, None]) & (groups >= 0) & (own >= 0)[:, None]
        if body:
            bodies = columns[2].to_pylist()
            allowed &= np.array([[not ok or not near_equal(x, r[3]) for x, ok in zip(bodies, oks, strict=True)] for r, oks in zip(part, allowed.tolist(), strict=True)], np.bool_).reshape(scores.shape)
        kept = np.where(allowed, scores, np.nan)
        q, r = np.nonzero((ranking._best(kept, halves["near"]) | ranking._best(kept, halves["far"], largest=False)) & allowed)
        return q, r, scores[q, r]

    scored = ranking._against_blocks(vectors.select(item, "vector", *extra), queries.select(query, "query_vector", *extra), ["vector", *extra], score, item, query, block)
    by = Window.partitionBy(query)
    picked = [scored.withColumn("r", F.row_number().over(by.orderBy(order, item))).where(F.col("r") <= halves[kind]).select(query, item, F.lit(kind).alias("kind")) for kind, order in (("near", F.desc_nulls_last("score")), ("far", F.asc_nulls_last("score")))]
    return picked[0].unionByName(picked[1])


def hard_negatives(scores: DataFrame, positives_: DataFrame | Column, query: str, item: str, n: int, random_pool: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(query, item, rank): the first n items by score that are no positives; a query with fewer is padded at random from the
    items of random_pool (item), each as likely as the others. A query without a scored item is in no list, unless it is in
    positives_, which may also be a condition on the scores' rows: then nothing is joined. Each partition keeps n items a
    query before they are shuffled."""
    if random_pool is not None:
        scores = kept(scores, "scores")  # read several times
    if isinstance(positives_, Column):
        others, positives_ = scores.where(~F.coalesce(positives_, F.lit(False))), scores.where(positives_).select(query, item)
    else:
        others = scores.join(positives_, [query, item], "left_anti")
    found = ranking.ranked(others, [query], item, k=n).select(query, item, "rank")
    if random_pool is None:
        return found
    found = kept(found, "found")
    taken = found.select(query, item).union(positives_.select(query, item)).distinct()
    asked = taken.select(query).distinct()
    pad = drawn(asked, random_pool, taken, query, item, n, seed).select(query, item, (n + F.col("rank")).alias("rank"))
    return ranking.ranked(found.unionByName(pad).withColumn("score", -F.col("rank")).drop("rank"), [query], item, k=n).select(query, item, "rank")


def drawn(queries: DataFrame, pool: DataFrame, taken: DataFrame, query: str, item: str, n: int, seed: int = 42) -> DataFrame:
    """(query, item, rank): n items of the pool for each query, at random and without repeats, none that the query has in
    `taken`; all that are left, if they are fewer. No query meets the whole pool, but one that takes nearly all of it.

    Items are numbered without gaps by a hash; a query draws numbers by hashes of its own in rounds of twice what it lacks,
    and draws that are taken or repeat are rejected, which leaves all others as likely. Queries for which less than four
    times what they want is free get all of it, ordered by a hash.
    """
    items = kept(_numbered(pool.select(item).where(F.col(item).isNotNull()).distinct(), item), "pool")
    size = items.count()
    held = taken.join(items.select(item), item, "left_semi").select(query, item).distinct()
    of = queries.select(query).distinct().join(held.groupBy(query).agg(F.count("*").alias("_h")), query, "left").select(query, (F.lit(size) - F.coalesce("_h", F.lit(0))).alias("_free"))
    few = of.where(F.col("_free") < 4 * n)
    number = lambda x: F.lit(x).cast("long")
    whole = few.select(query, F.explode(F.sequence(number(0), number(max(0, size - 1)))).alias("_number"))
    rest = whole.join(items, "_number").select(query, item).join(held, [query, item], "left_anti")
    out = ranking.ranked(rest.withColumn("score", F.xxhash64(query, item, F.lit(seed))), [query], item, k=n).select(query, item, "rank")
    open_ = kept(of.where(F.col("_free") >= 4 * n).select(query), "open")
    found, at = None, 0
    while size and not open_.isEmpty():
        draws = open_.select(query, F.explode(F.sequence(F.lit(at), F.lit(at + 2 * n - 1))).alias("_draw"))
        draws = draws.withColumn("_number", F.pmod(F.xxhash64(query, "_draw", F.lit(seed)), F.lit(size)))
        new = draws.join(items, "_number").select(query, item, "_draw").join(held, [query, item], "left_anti")
        every = new if found is None else found.unionByName(new)
        found = kept(every.groupBy(query, item).agg(F.min("_draw").alias("_draw")), "draws")
        enough = found.groupBy(query).agg(F.count("*").alias("_c")).where(F.col("_c") >= n)
        open_, at = kept(open_.join(enough, query, "left_anti"), "open"), at + 2 * n
    if found is None:
        return out
    first = ranking.ranked(found.withColumn("score", -F.col("_draw")), [query], item, k=n).select(query, item, "rank")
    return out.unionByName(first)


def _numbered(items: DataFrame, item: str, buckets: int = 1024) -> DataFrame:
    """Distinct items with _number, from 0 without gaps, in order of a hash: buckets are numbered apart, and the sizes of those
    before give each its first number."""
    placed = kept(items.withColumn("_hash", F.xxhash64(item)).withColumn("_bucket", F.shiftright("_hash", 54)), "placed")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # of at most 1,024 rows
    bases = placed.groupBy("_bucket").agg(F.count("*").alias("_c")).select("_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", item)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(bases), "_bucket").select(item, (F.col("_base") + F.col("_own")).alias("_number"))


def missing(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.join(known.select(key).distinct(), key, "left_anti")


def lengths(docs: DataFrame, length: Column) -> DataFrame:
    """One row: percentiles 50, 95 and 99, the longest, and the next power of two of the 99th."""
    p = quantiles(docs, [], length, (0.5, 0.95, 0.99), ("p50", "p95", "p99"))
    longest = docs.agg(F.max(length.cast("long")).alias("longest"))
    return p.crossJoin(longest).select("p50", "p95", "p99", "longest", F.pow(F.lit(2.0), F.ceil(F.log2("p99"))).cast("long").alias("maxlen"))  # one row each


def value_counts(df: DataFrame, column: str, places: int = 2) -> DataFrame:
    """(value, n, pct); the total is summed over the counts, not the rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(column, "n", F.round(F.col("n") * 100.0 / F.col("_all"), places).alias("pct"))  # one row


def code_errors(errors: DataFrame, hinted: DataFrame, real: DataFrame) -> DataFrame:
    """Adds why a code is wrong: hint_gap (the right one was not hinted), model_ignored (it was), and whether a predicted
    code is real_but_wrong or invented."""
    out = errors.join(hinted.withColumn("_hinted", F.lit(True)), ["question", "code"], "left").join(real.withColumn("_real", F.lit(True)), "code", "left")
    missing_ = F.when(F.col("_hinted").isNotNull(), "model_ignored").otherwise("hint_gap")
    extra = F.when(F.col("_hinted").isNotNull(), "hinted_wrong").when(F.col("_real").isNotNull(), "real_but_wrong").otherwise("invented")
    return out.withColumn("cause", F.when(F.col("kind") == "missing", missing_).otherwise(extra)).drop("_hinted", "_real")


def projected_f1(counts: DataFrame, thresholds: tuple[int, ...] = (40, 50, 60, 70)) -> DataFrame:
    """What F1 would be if a threshold's share of the extra codes (tp, extra, missing) were pruned."""
    t = counts.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    left = F.col("extra") * (1 - F.col("threshold") / 100.0)
    return t.withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + left + F.col("missing")))
