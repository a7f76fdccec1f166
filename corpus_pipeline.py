"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing. Each stage's rows are written as
Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, nearcopies, packing, secrets, toxicity
from quadrille.llm.common import discard, fresh, materialise

MASK = "[SECRET]"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    copy, score = fresh(docs, "_text"), fresh(docs, "_score")
    return toxicity.scored(docs.withColumn(copy, F.col("text")), model, copy, score).where(F.col(score) < 0.5).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest doc_id stays.
    Each row's own text decides, whatever its id; documents without an id come last in their group, and rows that repeat
    the kept id and text are the same document."""
    own, other = fresh(docs, "_key"), fresh(docs, "_id")
    gone = nearcopies.near_copies(docs).where("NOT first").select(F.col("doc_id").alias(other), F.col("text_key").alias(f"{own}_gone")).distinct()
    rows = docs.withColumn(own, nearcopies.text_key(F.col("text")))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(own) == F.col(f"{own}_gone")), "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; others stay whole."""
    own = fresh(docs, "_digest")
    rows = docs.withColumn(own, F.sha2("text", 256))  # a row's verdict is its text's, whatever its id
    found = decontaminate.with_verdict(decontaminate.overlaps(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=own))
    return rows.join(found.where("contaminated").select(own).distinct(), own, "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; n_chars follows the text."""
    spans = fresh(docs, "_spans")
    found = secrets.scan(docs, secrets.learn(secrets.labelled_credentials()), mask=MASK, base_col=fresh(docs, "_base"), spans_col=spans)
    masked = F.size(spans) > 0
    return found.withColumn("n_chars", F.when(masked, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, batch, slot."""
    return packing.pack(docs, packing.byte_tokens())


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Fingerprints by XXH64, learned scores and the dynamic programme are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's documents go once the next ones are written; the last ones, which the result reads,
    when the driver ends."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
