"""A kept inverted index for BM25+: postings in blocks with bounds, by kind and term, with deltas for new documents."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from quadrille.context import kept
from quadrille.retrieval.ranking import ranked, small

#: A quarter of the documents of a part, and levels of weight that a term's postings are put into, the heaviest apart from the
#: lightest. A block holds a term's postings of a part and a level.
BLOCK, LEVELS = 512, 12
#: Rows of a plan that meet a part in one task.
PLAN = 100_000
#: The rarest terms of a query, from whose postings comes the score that the k-th document has at least.
PILOTS = 4


@dataclass(frozen=True)
class TextIndex:
    """Written under `path`, a part of each for each build and each delta: postings (build, kind, term, level, parts, part, n,
    most_tf, least_dl, docs array<(doc, tf, dl)>), a document in the part that its hash says, and once under the null term
    too; terms (kind, term, df, most_tf, least_dl); sizes (kind, n, length)."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @staticmethod
    def build(docs: DataFrame, doc: str, tokens: Column, path: str, kind: Column | None = None) -> TextIndex:
        """Tokenises all documents once. doc may not repeat. Documents without tokens count in sizes; those of a null kind are
        in no index; without `kind`, all are of one."""
        index = TextIndex(docs.sparkSession, path)
        index._write(docs, doc, tokens, kind, "overwrite")
        return index

    def add(self, docs: DataFrame, doc: str, tokens: Column, kind: Column | None = None) -> TextIndex:
        """New documents as a delta: their postings, terms and sizes come beside those that are there, which are not read."""
        self._write(docs, doc, tokens, kind, "append")
        return self

    def _write(self, docs: DataFrame, doc: str, tokens: Column, kind: Column | None, mode: str) -> None:
        rows = docs.where((F.lit("") if kind is None else kind).isNotNull())
        build, parts = uuid.uuid4().hex, max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // (4 * BLOCK)))
        # texts are dealt by part once, and no posting is shuffled: terms are counted and blocks made in their part
        placed = rows.withColumn("parts", F.lit(parts)).withColumn("part", _part(doc)).repartitionById(parts, F.col("part"))
        sized = placed.select("parts", "part", (F.lit("") if kind is None else kind.cast("string")).alias("kind"), F.col(doc).alias("doc"), F.coalesce(tokens, F.array().cast("array<string>")).alias("_t"))
        words = sized.select("parts", "part", "kind", "doc", F.size("_t").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_compact("_t"))).alias("term"))
        held = words.groupBy("part", "parts", "kind", "doc", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        # the level is by tf against length alone, so that it needs no average; what a block holds at most is measured
        weight = F.col("tf") * F.greatest(F.lit(1.0), 4096.0 / F.greatest(F.lit(1), "dl"))
        held = held.withColumn("level", F.least(F.lit(LEVELS - 1), F.floor(F.log2(weight) / 1.5)).cast("int"))
        of = dict(held.dtypes)["doc"]
        made = held.groupBy("part").applyInArrow(_blocks, f"kind string, term string, level int, parts int, part int, n int, most_tf int, least_dl int, docs array<struct<doc:{of},tf:int,dl:int>>")
        made.select(F.lit(build).alias("build"), "*").sortWithinPartitions("kind", "term").write.mode(mode).parquet(f"{self.path}/postings")
        written = self.table("postings").where(F.col("build") == build)
        terms = written.where("term IS NOT NULL").groupBy("kind", "term").agg(F.sum("n").alias("df"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl"))
        terms.repartitionByRange("kind", "term").sortWithinPartitions("kind", "term").write.mode(mode).parquet(f"{self.path}/terms")
        length = F.aggregate("docs", F.lit(0).cast("long"), lambda n, d: n + d["dl"])
        written.where("term IS NULL").groupBy("kind").agg(F.sum("n").alias("n"), F.sum(length).alias("length")).coalesce(1).write.mode(mode).parquet(f"{self.path}/sizes")

    def _worth(self, queries: DataFrame, query: str, tokens: Column, k1: float, b: float) -> DataFrame:
        """(query, kind, term, idf, avgdl, most): the queries' terms that the index has, and what a posting adds at most."""
        asked = queries.select(F.col(query), F.explode(F.array_distinct(tokens)).alias("term"))
        wanted = small(asked.select("term").distinct())
        terms = self.table("terms").join(wanted, "term", "left_semi").groupBy("kind", "term").agg(F.sum("df").alias("df"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl"))
        sizes = self.table("sizes").groupBy("kind").agg(F.sum("n").alias("_n"), (F.sum("length") / F.sum("n")).alias("avgdl"))
        found = asked.join(terms.join(sizes, "kind"), "term").withColumn("idf", F.log((F.col("_n") + 1) / F.col("df")))
        return found.withColumn("most", F.col("idf") * _weight(F.col("most_tf"), F.col("least_dl"), k1, b)).select(query, "kind", "term", "df", "idf", "avgdl", "most")

    def _plan(self, queries: DataFrame, query: str, tokens: Column, k: int, k1: float, b: float) -> DataFrame:
        """(query, kind, term, idf, avgdl, most, all, floor, below): the queries' terms, with the largest score of all together,
        a score that the k-th document has at least (null if that isn't known), and the largest of this term and all of less
        weight together."""
        worth = kept(self._worth(queries, query, tokens, k1, b), "worth")
        rare = ranked(worth.withColumn("score", -F.col("df")), [query, "kind"], "term", k=PILOTS).drop("rank", "score")
        pilot = self._scored(rare.join(self.table("postings"), ["kind", "term"]), query, k1, b)
        floors = ranked(pilot, [query, "kind"], "doc", k=k).groupBy(query, "kind").agg(F.min("score").alias("floor"), F.count("*").alias("_found"))
        floors = floors.where(F.col("_found") >= k).select(query, "kind", (F.col("floor") - 1e-6).alias("floor"))
        own = Window.partitionBy(query, "kind")
        sums = worth.withColumn("all", F.sum("most").over(own)).withColumn("below", F.sum("most").over(own.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)))  # of a query's terms
        return kept(sums.join(floors, [query, "kind"], "left"), "plan")

    def _first_blocks(self, plan: DataFrame, query: str, k1: float, b: float) -> DataFrame:
        """The blocks of terms without which no document reaches the floor, as far as the block's bound and the largest of all
        other terms do."""
        needed = plan.where(F.col("floor").isNull() | (F.col("below") >= F.col("floor")))
        heads = self.table("postings").select("kind", "term", "level", "parts", "part", "n", "most_tf", "least_dl").join(small(plan.select("term").distinct()), "term", "left_semi")
        bound = F.col("idf") * _weight(F.col("most_tf"), F.col("least_dl"), k1, b)
        met = needed.join(heads, ["kind", "term"]).where(F.col("floor").isNull() | (F.col("all") - F.col("most") + bound >= F.col("floor")))
        return met.select(query, "kind", "term", "level", "parts", "part", "idf", "avgdl").distinct()  # a delta's block may have the name of another

    def _scored(self, postings: DataFrame, query: str, k1: float, b: float) -> DataFrame:
        each = postings.select(query, "kind", "idf", "avgdl", F.explode("docs").alias("d")).select(query, "kind", "idf", "avgdl", "d.*")
        return each.groupBy(query, "kind", "doc").agg(F.sum(F.col("idf") * _weight(F.col("tf"), F.col("dl"), k1, b)).alias("score"))

    def read(self, queries: DataFrame, query: str, tokens: Column, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query, kind, term, level, parts, part): the blocks that a search needs for each query, once each: first ones, and those
        of the other terms in the parts of documents that are then still in question."""
        plan = self._plan(queries, query, tokens, k, k1, b)
        first = kept(self._first_blocks(plan, query, k1, b), "blocks")
        partial = self._scored(first.join(self.table("postings"), _NAME), query, k1, b)
        others = plan.where(F.col("below") < F.col("floor"))
        spare = others.groupBy(query, "kind").agg(F.max("below").alias("_spare"), F.first("floor").alias("_floor"))
        few = partial.join(spare, [query, "kind"], "left").where(F.col("_floor").isNull() | (F.col("score") + F.col("_spare") >= F.col("_floor")))
        shapes = self.table("postings").select("kind", "term", "level", "parts").join(small(others.select("term").distinct()), "term", "left_semi").distinct()
        more = few.select(query, "kind", "doc").join(others.select(query, "kind", "term"), [query, "kind"]).join(shapes, ["kind", "term"]).withColumn("part", _part("doc"))
        return first.select(query, *_NAME).union(more.select(query, *_NAME)).distinct()

    def search(self, queries: DataFrame, query: str, tokens: Column, k: int = 10, k1: float = 1.5, b: float = 0.75, delta: float = 1.0, constant: bool = True) -> DataFrame:
        """(query, kind, doc, score, rank): the first k documents of each kind, as bm25() has them; no text is read. Queries with
        no term of the index find nothing.

        A query's rarest terms give lower bounds of scores, the k-th largest of which is a floor. Terms whose largest weights
        don't reach it together bring in no document; of the others, blocks that can't are left out; and the postings of
        the former are added where a part has documents that are still in question. The blocks of asked terms are dealt by part,
        so that a document is scored in one task, which passes on the first k of each query.
        """
        plan = self._plan(queries, query, tokens, k, k1, b)
        postings = self.table("postings")
        of_plan = -(-plan.count() // PLAN) or 1
        places = postings.select(F.col("build").alias("build"), F.col("part").alias("part")).distinct()  # some thousands of documents each
        asked = plan.withColumn("_block", F.pmod(F.xxhash64(query), F.lit(of_plan))).crossJoin(F.broadcast(places))
        blocks = postings.join(small(plan.select("term").distinct()), "term", "left_semi").select("build", "part", "kind", "term", "most_tf", "least_dl", "docs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_plan - 1).cast("long"))).alias("_block"))
        of = postings.schema["docs"].dataType.elementType["doc"].dataType.simpleString()
        schema = f"`{query}` {dict(plan.dtypes)[query]}, kind string, doc {of}, score double"
        empty = to_arrow_schema(self.spark.createDataFrame([], schema).schema).empty_table()

        def best(rows: pa.Table, held: pa.Table) -> pa.Table:
            return _best_of_part(rows, held, query, k, k1, b, empty) if rows.num_rows and held.num_rows else empty

        key = ["build", "part", "_block"]
        scores = asked.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(best, schema)
        found = ranked(scores.withColumn("score", F.round("score", 9)), [query, "kind"], "doc", k=k)
        if not constant or not delta:
            return found
        base = plan.groupBy(query, "kind").agg((F.sum("idf") * delta).alias("_base"))
        return found.join(base, [query, "kind"]).withColumn("score", F.col("score") + F.col("_base")).drop("_base")


def _blocks(rows: pa.Table) -> pa.Table:
    """The postings of a part as blocks."""
    rows = rows.combine_chunks()
    codes = [pc.fill_null(rows.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy() for c in ("kind", "term")]
    level = rows.column("level").to_numpy()
    order = np.lexsort((level, *codes[::-1]))
    ordered = np.stack([x[order] for x in (*codes, level)])
    starts = np.flatnonzero(np.r_[True, (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)])
    docs = [rows.column(c).combine_chunks().take(pa.array(order)) for c in ("doc", "tf", "dl")]
    ends = pa.array(np.r_[starts, len(order)].astype(np.int32))
    firsts = rows.take(pa.array(order[starts]))
    sizes = [np.diff(np.r_[starts, len(order)]), np.maximum.reduceat(docs[1].to_numpy(), starts), np.minimum.reduceat(docs[2].to_numpy(), starts)]
    made = dict(zip(("n", "most_tf", "least_dl"), (pa.array(x.astype(np.int32)) for x in sizes), strict=True))
    return pa.table({c: firsts.column(c) for c in _NAME} | made | {"docs": pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(docs, ["doc", "tf", "dl"]))})


def _best_of_part(rows: pa.Table, held: pa.Table, query: str, k: int, k1: float, b: float, empty: pa.Table) -> pa.Table:
    """The documents of a part that may be among the first k of the plan's queries, with their scores."""
    plan = rows.sort_by([(query, "ascending"), ("kind", "ascending")]).to_pylist()
    average = {r["kind"]: r["avgdl"] for r in plan}
    held = held.sort_by([("kind", "ascending"), ("term", "ascending")]).combine_chunks()
    docs = held.column("docs").combine_chunks()
    ends = np.cumsum([0, *docs.value_lengths().to_numpy()])
    flat = docs.flatten()
    names = flat.field("doc").dictionary_encode()
    at, tf, dl = (x.to_numpy(zero_copy_only=False) for x in (names.indices, flat.field("tf"), flat.field("dl")))
    mean = np.array([average.get(x, 1.0) for x in held.column("kind").to_pylist()])
    weight = lambda tf, dl, mean: tf * (k1 + 1) / (k1 * (1 - b + b * dl / mean) + tf)
    weights, bounds = weight(tf, dl, np.repeat(mean, np.diff(ends))), weight(held.column("most_tf").to_numpy(), held.column("least_dl").to_numpy(), mean)
    of: dict[tuple, list[int]] = {}
    for i, name in enumerate(zip(held.column("kind").to_pylist(), held.column("term").to_pylist(), strict=True)):
        of.setdefault(name, [i, i])[1] = i + 1

    def added(scores: np.ndarray, term: dict, least: float) -> None:
        first, last = of.get((term["kind"], term["term"]), (0, 0))
        wanted = term["idf"] * bounds[first:last] >= least
        for i, j in [(first, last)] if wanted.all() else [(first + i, first + i + 1) for i in np.flatnonzero(wanted).tolist()]:
            scores[at[ends[i] : ends[j]]] += term["idf"] * weights[ends[i] : ends[j]]  # a term's blocks share no document

    out: list[tuple] = []
    start = 0
    while start < len(plan):
        end, own = start, (plan[start][query], plan[start]["kind"])
        while end < len(plan) and (plan[end][query], plan[end]["kind"]) == own:
            end += 1
        terms, start = plan[start:end], end
        floor = -np.inf if terms[0]["floor"] is None else terms[0]["floor"]
        others = [t for t in terms if t["below"] < floor]
        scores = np.zeros(len(names.dictionary))
        for t in terms:
            if t["below"] >= floor:
                added(scores, t, floor - t["all"] + t["most"])
        few = np.flatnonzero((scores > 0) & (scores + max((t["below"] for t in others), default=0.0) >= floor))
        if not len(few):
            continue
        for t in others:
            added(scores, t, -np.inf)
        last = np.partition(scores[few], len(few) - k)[len(few) - k] if len(few) > k else -np.inf
        few = few[scores[few] >= last - 1e-8]  # ranks are by rounded scores
        out += [(*own, i, x) for i, x in zip(few.tolist(), scores[few].tolist(), strict=True)]
    if not out:
        return empty
    found = [pa.array(list(x)) for x in zip(*out, strict=True)]
    found[2] = names.dictionary.take(found[2])
    return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(found, empty.schema, strict=True)], schema=empty.schema)


#: What names a block.
_NAME = ["kind", "term", "level", "parts", "part"]


def _part(doc: str) -> Column:
    return F.pmod(F.xxhash64(doc), F.col("parts")).cast("int")


def _weight(tf: Column, dl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (k1 * (1 - b + b * dl / F.col("avgdl")) + tf)
