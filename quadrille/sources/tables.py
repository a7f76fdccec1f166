"""Sources and sinks: cubes in Parquet, JSON lines, TSV collections, catalogs from quads, and resumable results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURE = re.compile(r"[A-Za-z][A-Za-z0-9]*_\d+")


def cube(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A cube: filters and the chosen columns reach the scan."""
    return spark.read.parquet(f"{root}/{table}.parquet")


def measure_columns(df: DataFrame) -> list[str]:
    """Columns named like measures, from the schema alone."""
    return [c for c in df.columns if MEASURE.fullmatch(c)]


def describe(df: DataFrame) -> DataFrame:
    """(position, column, kind): a row for each column; no data is read."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position long, `column` string, kind string")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question-answer pairs, one JSON object a line; a missing field is null."""
    return spark.read.schema("question string, sexp string, sql string, simplified_sql string").json(path)


def write_collection(docs: DataFrame, path: str, pid: str = "pid", body: str = "body") -> None:
    """`pid, body` as TSV; tabs and line ends in bodies become blanks."""
    docs.select(pid, F.regexp_replace(body, r"\s+", " ").alias(body)).write.mode("overwrite").option("sep", "\t").csv(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """Training triples as JSON arrays, one a line."""
    triples.select(F.to_json(F.array(*triples.columns))).write.mode("overwrite").text(path)


def write_summary(results: DataFrame, path: str, by: list[str]) -> None:
    """A CSV with header, sorted by the given columns."""
    results.orderBy(*by).coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a report of a few rows


def remaining(questions_: DataFrame, done: DataFrame, key: str = "question") -> DataFrame:
    """Questions without a result yet: an interrupted run resumes with these and appends."""
    return questions_.join(done.select(key).distinct(), key, "left_anti")


def quads(spark: SparkSession, path: str) -> DataFrame:
    """N-Quads as (s, p, o, g, o_is_literal, o_datatype, o_lang)."""
    line = r'^\s*(\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(?:<([^>]*)>)?\s*\.\s*$'
    raw = spark.read.text(path).where(F.col("value").rlike(line))
    part = lambda i: F.regexp_extract("value", line, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    o = part(3)
    literal = o.startswith('"')
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1), r'\\"', '"'), r"\\\\", r"\\")
    return raw.select(
        bare(part(1)).alias("s"), part(2).alias("p"), F.when(literal, text).otherwise(bare(o)).alias("o"), F.nullif(part(4), F.lit("")).alias("g"), literal.alias("o_is_literal"),
        F.when(literal, F.nullif(F.regexp_extract(o, r'\^\^<([^>]*)>$', 1), F.lit(""))).alias("o_datatype"), F.when(literal, F.nullif(F.regexp_extract(o, r"@([A-Za-z0-9-]+)$", 1), F.lit(""))).alias("o_lang"),
    )


def updated(triples: DataFrame, deleted: DataFrame, inserted: DataFrame) -> DataFrame:
    """A new snapshot of triples (s, p, o): without the deleted ones, with the inserted, each once."""
    return triples.join(deleted, ["s", "p", "o"], "left_anti").unionByName(inserted.select(*triples.columns)).distinct()
