"""Reshaping between wide cubes, long observations and pivoted answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_COLUMNS = 10_000
#: Combinations up to which a pivot looks at each for every row.
ONE_PASS = 16


def col(name: str) -> Column:
    """A column by its exact name, dots, digits and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unpivot(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Long rows (ids, Measure, Value) without null values; only the listed measures are read."""
    values = [col(m).cast("double").alias(m) for m in measures]
    return df.select(*map(col, ids), *values).unpivot([col(i) for i in ids], [col(m) for m in measures], "Measure", "Value").where("Value IS NOT NULL")


def members(df: DataFrame, group: str, most: int = MOST_COLUMNS) -> list[str]:
    """All codes of a dimension, sorted; more than could be columns are an error."""
    found = sorted(r[0] for r in df.select(col(group).cast("string")).where(col(group).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{group} has more than {most} members")
    return found


def pivot(df: DataFrame, index: list[str], keys: list[tuple[str, Iterable[str]]], aggregate: Callable[[Column], Column] = F.max, value: str = "Value", keep_empty: bool = False) -> DataFrame:
    """One row for each index, one column for each combination of the keys' codes, named by the codes with `_` between.

    Rows outside the code lists are filtered out before the shuffle, so that the filter reaches the scan; keep_empty
    leaves them, and with them the index rows that have no cell. The aggregate must pass over nulls; a combination without
    rows has what it gives without any, such as null for a sum and 0 for a count, however many combinations there are. Each column
    carries its dimensions and codes in its metadata, through joins and renames; levels() reads them.
    """
    keys = [(g, list(codes)) for g, codes in keys]
    combinations = prod(len(codes) for _, codes in keys)
    if combinations > MOST_COLUMNS:
        raise ValueError(f"{combinations} combinations are more than {MOST_COLUMNS} columns")
    if not keep_empty:
        df = reduce(lambda d, k: d.where(col(k[0]).isin(k[1])), keys, df)
    if combinations > ONE_PASS:  # each combination first has its row, and only those are spread over the columns
        named = df.select(*map(col, index), col(value), *(F.when(col(g).isin(codes), col(g)).alias(g) for g, codes in keys))
        kind = df.schema[value].dataType
        df = named.groupBy(*map(col, index), *(col(g) for g, _ in keys)).agg(aggregate(col(value)).alias(value))
        without = aggregate(F.when(F.lit(False), F.lit(None).cast(kind)))
        aggregate = lambda c: F.coalesce(F.max(c), without)
    cells = []
    for combination in product(*(codes for _, codes in keys)):
        hit = reduce(lambda a, b: a & b, (col(g) == c for (g, _), c in zip(keys, combination, strict=True)), F.lit(True))
        cells.append(aggregate(F.when(hit, col(value)) if keys else col(value)).alias("_".join(combination) or value, **({"metadata": {"dimensions": [g for g, _ in keys], "codes": list(combination)}} if keys else {})))
    return df.groupBy(*map(col, index)).agg(*cells)


def full_align(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of any number of tables on keys, each key the first that is not null."""
    out = tables[0]
    for right in tables[1:]:
        renamed = right.select(*(col(k).alias(f"_right_{k}") for k in keys), *(col(c) for c in right.columns if c not in keys))
        on = reduce(lambda a, b: a & b, (col(k) == col(f"_right_{k}") for k in keys))
        both = out.join(renamed, on, "full")
        out = both.select(*(F.coalesce(col(k), col(f"_right_{k}")).alias(k) for k in keys), *(col(c) for c in both.columns if c not in keys and not c.startswith("_right_")))
    return out


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*map(col, sorted(df.columns)))


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Drops the columns that hold nothing but nulls: one aggregation over all rows."""
    if not df.columns:
        return df
    counts = df.agg(*(F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return df.select(*(col(c) for i, c in enumerate(df.columns) if counts[i]))


def without_repeated_columns(columns: list[str]) -> list[str]:
    """Names without those that repeat another with a number of up to two digits after `_`."""
    return [c for c in columns if not ((m := re.fullmatch(r"(.*)_(\d{0,2})", c)) and m[1] in columns)]


def presented(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """An answer as it is shown: without columns that hold nothing, without repeated columns of a join, the key
    `Dimension_Measure` as `Measure`, columns named by their labels, in order of their names."""
    df = without_empty_columns(df)
    df = df.select(*map(col, without_repeated_columns(df.columns)))
    labels, parts = labels or {}, levels(df)
    name = lambda c: labels[c] if c in labels else "_".join(labels.get(code, code) for _, code in parts[c]) if parts[c] else c
    names = {c: "Measure" if c == "Dimension_Measure" else name(c) for c in df.columns}
    return sorted_columns(df.select(*(col(c).alias(n) for c, n in names.items())))


def indexed(df: DataFrame, selectors: list[str]) -> DataFrame:
    """The selectors' columns first. A selector that is no column is a measure: only its rows stay, and Measure (and Unit, if
    there is one) come first; if it has no rows either, the answer stays as it is."""
    missing = [s for s in selectors if s not in df.columns]
    if not missing:
        return df.select(*map(col, selectors), *(col(c) for c in df.columns if c not in selectors))
    rows = df.where(col("Measure") == missing[0]) if "Measure" in df.columns else df.limit(0)
    if rows.isEmpty():
        return df
    first = [c for c in ("Measure", "Unit") if c in df.columns]
    return rows.select(*map(col, first), *(col(c) for c in df.columns if c not in first))


def code_levels(columns: list[str]) -> list[tuple[str, ...]]:
    """The codes in pivoted column names: `_` separates them where three characters or more follow."""
    return [tuple(re.split(r"_(?=[^_]{3,})", c)) for c in columns]


def levels(df: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """(dimension, code) of each column that a pivot made, whatever its codes look like and its name is now; none for others."""
    return {f.name: list(zip(f.metadata.get("dimensions", []), f.metadata.get("codes", []), strict=True)) for f in df.schema.fields}


def markdown(df: DataFrame, most: int = 1000) -> str:
    """The first `most` rows as a table in Markdown; for answers."""
    shown = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([shown(v) for v in r] for r in df.limit(most).collect())]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def transpose(df: DataFrame, key: str) -> DataFrame:
    """Columns become rows (`column`), key values columns; for answers, whose size is bounded by members()."""
    others = [c for c in df.columns if c != key]
    long = df.select(col(key).cast("string").alias("_key"), *(col(c).cast("double").alias(c) for c in others)).unpivot(["_key"], [col(c) for c in others], "column", "Value")
    return pivot(long, ["column"], [("_key", members(df, key))], F.max)
