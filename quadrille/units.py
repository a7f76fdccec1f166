"""Units of measures: whether measures may be aggregated together, and their multipliers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.context import small


class UnitCompatibilityError(ValueError):
    """Measures that must not be aggregated together."""


def measure_units(units: DataFrame, measures: Iterable[str]) -> list[dict]:
    """Facts (node_id, unit, multiplier, scaling_of, is_dimensionless) of the measures; a few rows for an expression."""
    wanted = list(dict.fromkeys(measures))
    rows = units.where(F.col("node_id").isin(wanted)).select("node_id", "unit", "multiplier", "scaling_of", "is_dimensionless").distinct().collect()
    return [r.asDict() for r in rows]


def check(units: DataFrame, measures: Iterable[str], allow_scaling: bool = True, strict: bool = False) -> dict[str, dict]:
    """The measures' units, or UnitCompatibilityError.

    Several measures may not include a dimensionless unit other than a count. Equal units are compatible, though not
    with different multipliers unless scaling is allowed; with scaling, units that scale the same unit are too.
    Measures without known units raise only in strict mode.
    """
    wanted = list(dict.fromkeys(measures))
    facts = measure_units(units, wanted)
    if strict and not facts:
        raise UnitCompatibilityError(f"no units are known of {', '.join(wanted)}")
    if len(wanted) > 1 and any(f["is_dimensionless"] and f["unit"] != "COUNT" for f in facts):
        raise UnitCompatibilityError("measures with a dimensionless unit can't be aggregated together")
    names = {f["unit"] for f in facts if strict or f["unit"] is not None}
    if len(names) > 1:
        scaled = {f["scaling_of"] or f["unit"] for f in facts if f["unit"] is not None}
        if not allow_scaling or len(scaled) > 1 or None in names:
            raise UnitCompatibilityError(f"measures with a different unit can't be aggregated together: {', '.join(map(str, sorted(names, key=str)))}")
    if not allow_scaling and len({f["multiplier"] or 1 for f in facts}) > 1:
        raise UnitCompatibilityError("measures with different conversion multipliers can't be aggregated together")
    return {f["node_id"]: f for f in facts}


def errors(selected: DataFrame, units: DataFrame, question: str, allow_scaling: bool = True) -> DataFrame:
    """(question, error): check() of many questions at once, each with the measures (node_id) it aggregates; empty where they
    go together, else dimensionless, different unit or multipliers. Measures without known units pass."""
    facts = selected.select(question, "node_id").distinct().join(units.select("node_id", "unit", "multiplier", "scaling_of", "is_dimensionless").distinct(), "node_id", "left")
    unit = F.col("unit")
    per = facts.groupBy(question).agg(
        F.countDistinct("node_id").alias("_n"), F.max(F.coalesce(F.col("is_dimensionless") & (F.coalesce(unit, F.lit("")) != "COUNT"), F.lit(False))).alias("_bare"),
        F.countDistinct("unit").alias("_units"), F.countDistinct(F.when(unit.isNotNull(), F.coalesce("scaling_of", "unit"))).alias("_scaled"), F.countDistinct(F.when(unit.isNotNull() | F.col("multiplier").isNotNull() | F.col("is_dimensionless").isNotNull(), F.coalesce("multiplier", F.lit(1.0)))).alias("_multipliers"),
    )
    apart = (F.col("_units") > 1) & (F.lit(not allow_scaling) | (F.col("_scaled") > 1))
    error = F.when((F.col("_n") > 1) & F.col("_bare"), "dimensionless").when(apart, "different unit").when(F.lit(not allow_scaling) & (F.col("_multipliers") > 1), "multipliers").otherwise("")
    return per.select(question, error.alias("error"))


def scaled(long: DataFrame, units: DataFrame, unit_name: str = "number") -> DataFrame:
    """Long observations with Value times its measure's multiplier and Unit `unit_name`, where multipliers differ.

    The multipliers of a catalog are few and are broadcast: by Measure all observations would meet in a task for each measure."""
    of = units.groupBy(F.col("node_id").alias("Measure")).agg(F.max("multiplier").alias("_m"))
    return long.join(small(of), "Measure", "left").withColumn("Value", F.col("Value") * F.coalesce(F.col("_m").cast("double"), F.lit(1.0))).withColumn("Unit", F.lit(unit_name)).drop("_m")


def with_units(long: DataFrame, units: DataFrame) -> DataFrame:
    """Adds Unit, empty where none is known; a composite measure `A;B` has its parts' distinct units, joined."""
    of = units.groupBy(F.col("node_id").alias("_part")).agg(F.max("unit_string").alias("_u"))
    parts = long.select("Measure").distinct().select("Measure", F.posexplode(F.split("Measure", ";")).alias("_i", "_part"))
    found = parts.join(of, "_part", "left").groupBy("Measure").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("_u").isNotNull(), F.struct("_i", "_u")))), lambda s: s["_u"])), ";").alias("Unit"))
    return long.join(found, "Measure", "left").withColumn("Unit", F.coalesce("Unit", F.lit("")))
