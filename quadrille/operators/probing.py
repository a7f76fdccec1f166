"""Probing cubes for the codes that a query names: distinct values, existence, pruning, verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quadrille.functions import fuzzy
from quadrille.functions.text import camel_words, grounded, is_period_code, partial_ratio
from quadrille.operators.reshape import col

#: Texts of a block that meets a block of others in a task.
TEXTS = 4096
#: Most labels of a block; most asked texts of one, but so few that there are some blocks, though no fewer than stated; most characters.
LABELS, ASKED, BLOCKS, FEW, CHARS = 1 << 18, 1 << 15, 64, 512, 1 << 23
#: Labels of a dimension that are searched on their own.
OWN = 512


def distinct_codes(df: DataFrame, dimension: str, most: int = 100) -> DataFrame:
    """The first codes of a dimension in order; only its column is read."""
    return df.select(col(dimension).alias("code")).where("code IS NOT NULL").distinct().orderBy("code").limit(most)


def code_exists(df: DataFrame | None, dimension: str, code: str) -> bool:
    """Whether a code is there; a missing cube (None) can't deny it."""
    return df is None or not df.where(col(dimension) == code).select(col(dimension)).limit(1).isEmpty()


def verified(df: DataFrame, wanted: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, code, found) for each wanted (dimension, code); one pass for all dimensions, map-side distinct."""
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), col(d).cast("string").alias("code")) for d in dimensions))).alias("x")).select("x.*").distinct()
    return wanted.join(pairs.withColumn("found", F.lit(True)), ["dimension", "code"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def pruned(wanted: DataFrame, probed: DataFrame) -> DataFrame:
    """Wanted codes without those that were not found, unless that would leave a dimension without any; period codes stay."""
    found = wanted.join(probed.select("dimension", "code", F.lit(True).alias("_there")), ["dimension", "code"], "left")
    keep = F.coalesce("_there", F.lit(False)) | is_period_code(F.col("code"))
    any_kept = F.max(keep.cast("int")).over(Window.partitionBy("dimension"))
    return found.withColumn("_keep", keep).withColumn("_any", any_kept).where("_keep OR _any = 0").drop("_there", "_keep", "_any")


def similar_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left, right): pairs of distinct texts (each side's column `text`) that have a partial ratio of at least the threshold, which
    is above 0."""
    return similar_scores(left, right, threshold).select("left", "right")


def similar_scores(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left, right, score): pairs of distinct texts with a partial ratio of at least the threshold, which is above 0.

    Both sides are dealt to blocks, and each two blocks meet in a task, so that no gram's texts are one task's and no pair is
    shuffled. There a product of the shorter texts' grams and the longer ones' leaves pairs that share as many as the
    threshold promises, and these are compared in arrays.
    """
    sides = [df.select(F.col("text")).where("text IS NOT NULL").distinct() for df in (left, right)]
    of = [max(1, -(-side.count() // TEXTS)) for side in sides]
    place = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    given = sides[0].select("text", place(of[0]).alias("_l")).select("text", "_l", every(of[1]).alias("_r"))
    asked = sides[1].select("text", place(of[1]).alias("_r")).select("text", "_r", every(of[0]).alias("_l"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"left": pa.array([], pa.string()), "right": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        a, b = a.column("text").combine_chunks(), b.column("text").combine_chunks()
        i, j, score = fuzzy.similar(a.to_pylist(), b.to_pylist(), threshold)
        return pa.table({"left": a.take(pa.array(i)), "right": b.take(pa.array(j)), "score": score})

    given, asked = (x.repartition(of[0] * of[1], "_l", "_r") for x in (given, asked))  # a stated number, so that small bytes of much work stay apart
    return given.groupBy("_l", "_r").cogroup(asked.groupBy("_l", "_r")).applyInArrow(meet, "left string, right string, score double")


def nearest_labels(asked: DataFrame, labels: DataFrame, k: int, threshold: float) -> DataFrame:
    """(text, dimension, label, score): labels of the best partial ratio with each asked `text`, of those of at least the threshold,
    which is above 0: the k best of each dimension at least, of equal ones those of the lower codes.

    labels: distinct (dimension, label) with the lowest code of each. Both sides are dealt to blocks, and each two blocks meet
    in a task of their own, where the threshold rises to the k-th best ratio that a text has found. A block of labels is as large as
    a task can hold, as fewer pairs are compared the more labels the k best are found among.
    """
    asked, labels = asked.select("text").where("text IS NOT NULL").distinct(), labels.where("label IS NOT NULL")
    size = lambda df, text: df.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    (many, chars), (n, m) = size(asked, "text"), size(labels, "label")
    of = max(1, -(-many // ASKED), -(-chars // CHARS), min(BLOCKS, -(-many // FEW))), max(1, -(-n // LABELS), -(-m // CHARS))
    place = lambda text, n: F.pmod(F.xxhash64(text), F.lit(n)).cast("int")
    first, other = place("text", of[0]) * of[1], place("label", of[1])
    given = asked.select("text", F.explode(F.sequence(first, first + F.lit(of[1] - 1))).alias("_block"))
    found = labels.select("dimension", "label", "code", F.explode(F.sequence(other, other + F.lit((of[0] - 1) * of[1]), F.lit(of[1]))).alias("_block"))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("dimension", labels.schema["dimension"].dataType), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pc.sort_indices(b, sort_keys=[("code", "ascending")], null_placement="at_start")).combine_chunks()
        texts, names, parts = a.column("text").to_pylist(), b.column("label").to_pylist(), [np.zeros((3, 0))]
        if texts and names:
            coded = pc.dictionary_encode(b.column("dimension"), null_encoding="encode").combine_chunks()
            coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy()
            own = np.bincount(coded) >= OWN
            for at in [*(np.flatnonzero(coded == d) for d in np.flatnonzero(own)), np.flatnonzero(~own[coded])]:
                groups = None if len(at) and (coded[at] == coded[at[0]]).all() else coded[at]
                if len(at):
                    i, j, score = fuzzy.nearest(texts, [names[x] for x in at.tolist()], k, threshold, groups)
                    parts.append(np.array([i, at[j], score]))
        i, j, score = np.concatenate(parts, axis=1)
        i, j = pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64))
        return pa.table({"text": a.column("text").take(i), "dimension": b.column("dimension").take(j), "label": b.column("label").take(j), "score": score})

    given, found = (x.repartitionById(of[0] * of[1], F.col("_block")) for x in (given, found))  # no two blocks in one task
    return given.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(meet, schema)


def ranked_codes(questions: DataFrame, codes: DataFrame, question: Column, label: Column, k: int = 1, threshold: float = 80.0, gate: bool = False) -> DataFrame:
    """(.., score, rank): the codes whose labels fit a stated question best, per question and dimension. With the gate, a
    label of meaningful words has to have one of them in the question. Pairs that can't share grams enough aren't compared; a threshold of 0, which every pair reaches, asks for all pairs.
    Without the gate only a text's k best labels leave the search, each with its k lowest codes, and are then given to all
    questions of that text."""
    codes, questions = codes.withColumn("_l", F.lower(label)), questions.withColumn("_q", F.lower(question))
    if threshold > 0 and not gate:
        lowest = Window.partitionBy("dimension", "_l").orderBy("code")
        codes = codes.where("_l IS NOT NULL").withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") <= k)
        scores = nearest_labels(questions.select(F.col("_q").alias("text")), codes.where("_n = 1").select("dimension", F.col("_l").alias("label"), "code"), k, threshold)
        scores = scores.select(F.col("text").alias("right"), F.col("dimension").alias("_d"), F.col("label").alias("left"), "score")
        best = Window.partitionBy("right", "dimension").orderBy(F.desc("score"), "code")
        pairs = codes.join(scores, (F.col("_l") == F.col("left")) & F.col("dimension").eqNullSafe(F.col("_d"))).drop("_n", "_d")
        pairs = pairs.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
        pairs = pairs.join(questions, F.col("_q") == F.col("right")).drop("left", "right")
    elif threshold > 0:
        scores = similar_scores(codes.select(F.col("_l").alias("text")), questions.select(F.col("_q").alias("text")), threshold)
        pairs = codes.join(scores, F.col("_l") == F.col("left")).join(questions, F.col("_q") == F.col("right")).drop("left", "right")
    else:
        pairs = codes.crossJoin(questions).withColumn("score", partial_ratio(F.col("_l"), F.col("_q")))  # every pair is asked for
    if gate:
        pairs = pairs.where(grounded(F.regexp_extract_all(F.col("_l"), F.lit(r"(\b[a-z]{4,}\b)"), F.lit(1)), F.col("_q")))
    w = Window.partitionBy("question_id", "dimension").orderBy(F.desc("score"), "code")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("_l", "_q")


def resolved_codes(questions: DataFrame, codes: DataFrame, question: Column, label: Column, threshold: float = 80.0) -> DataFrame:
    """(question_id, dimension, code, label): the best code of each dimension that a question names."""
    return ranked_codes(questions, codes.withColumn("_label", label), question, F.col("_label"), 1, threshold, gate=True).select("question_id", "dimension", "code", F.col("_label").alias("label"))


def schema_dimension_labels(dimensions: DataFrame, labels: DataFrame) -> DataFrame:
    """(table_id, node_id, label) of dimensions (table_id, node_id); one without a label has its name's words."""
    found = dimensions.join(labels.select("table_id", "node_id", "label"), ["table_id", "node_id"], "left")
    return found.select("table_id", "node_id", F.coalesce(F.nullif(F.nullif("label", F.lit("None")), F.lit("")), camel_words(F.col("node_id"))).alias("label"))


def hints(named: DataFrame, ranked: DataFrame, tables: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(question_id, dimension, codes): for each question the likely codes of the dimensions of its tables, best first.

    named: (question_id, table_id, dimension, code, label) by resolved_codes() on all of a question's tables, of which those
    not `present` (table_id, dimension, code) in the data are left out and the best table (lowest rank in `tables`:
    question_id, table_id, rank) decides; ranked: (question_id, dimension, code, label, rank) of probed codes, which replace
    them.
    """
    if present is not None:
        named = named.join(present.select("table_id", "dimension", "code").distinct(), ["table_id", "dimension", "code"], "left_semi")
    placed = named.join(tables.select("question_id", "table_id", "rank"), ["question_id", "table_id"])
    floor = placed.groupBy("question_id", "dimension").agg(F.min_by(F.array(F.struct("code", "label")), F.struct("rank", "code")).alias("_floor"))
    probed = ranked.groupBy("question_id", "dimension").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "label"))), lambda x: F.struct(x["code"], x["label"])).alias("_probed"))
    return floor.join(probed, ["question_id", "dimension"], "full").select("question_id", "dimension", F.coalesce("_probed", "_floor").alias("codes"))
