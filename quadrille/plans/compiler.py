"""From cube expressions to DataFrames: a pure function of the node, the mode and the context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille import units as unit_rules
from quadrille.operators.reshape import col, full_align, members, pivot, unpivot
from quadrille.plans.expressions import Aggregate, Join, Node, Proportion, Value, read

MODES = ("pivoted", "simplified", "native", "long")
_FUNCTIONS: dict[str, Callable[[Column], Column]] = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
_COMPARE = {"<": Column.__lt__, ">": Column.__gt__, "!=": Column.__ne__, "<=": Column.__le__, ">=": Column.__ge__, "=": Column.__eq__}


@dataclass(frozen=True)
class CubeContext:
    """Where cubes are: `cubes` by name, else Parquet under `root`; `units` and `labels` are catalog tables, if any."""

    spark: SparkSession
    root: str = ""
    cubes: dict[str, DataFrame] | None = None
    units: DataFrame | None = None
    labels: DataFrame | None = None
    language: str = "en"

    def cube(self, table: str) -> DataFrame:
        if self.cubes and table in self.cubes:
            return self.cubes[table]
        return self.spark.read.parquet(f"{self.root}/{table}.parquet")


def code_filter(group: str, codes: tuple[str, ...], match: str = "equal") -> Column:
    """group in codes; with match="substring", the cell contains one of them. No codes: every row."""
    if not codes:
        return F.lit(True)
    if match == "substring":
        return reduce(lambda a, b: a | b, (col(group).contains(c) for c in codes))
    return col(group).isin(list(codes)) if len(codes) > 1 else col(group) == codes[0]


def selected(value: Value, context: CubeContext, match: str = "equal") -> DataFrame:
    """Dimensions and measures of the rows that the expression selects: all predicates reach the scan."""
    df = context.cube(value.table)
    for group, codes in value.dims:
        df = df.where(code_filter(group, codes, match))
    if value.compare:
        op, number = value.compare
        df = df.where(_COMPARE[op](col(value.measures[0]), F.lit(number)))
    return df.select(*map(col, value.groups), *(col(m) for m in value.measures if m not in value.groups))


def long_form(value: Value, context: CubeContext, match: str = "equal") -> DataFrame:
    return unpivot(selected(value, context, match), list(value.groups), list(value.measures))


def _keys(value: Value, df: DataFrame, without: set[str] = frozenset()) -> list[tuple[str, list[str]]]:
    return [(g, list(codes) or members(df, g)) for g, codes in value.dims if g not in without]


def _value(v: Value, mode: str, context: CubeContext) -> DataFrame:
    if mode == "simplified":
        return selected(v, context)
    df = long_form(v, context)
    if mode == "long":
        return df
    return pivot(df, ["Measure"], _keys(v, df), F.max if mode == "pivoted" else F.avg)


def _aggregate(a: Aggregate, mode: str, context: CubeContext) -> DataFrame:
    if isinstance(a.inner, Join):
        return _aggregate_join(a, mode, context)
    v, f = a.inner, _FUNCTIONS[a.function]
    if context.units is not None and a.selector is None and mode != "simplified":
        unit_rules.check(context.units, v.measures, allow_scaling=mode in ("native", "long"))
    if mode == "simplified":
        return _ranked(a, context) if a.function in ("MIN", "MAX") else _total(a, context)
    df = long_form(v, context)
    rest = [g for g in v.groups if g != a.selector]
    if mode == "pivoted":
        if a.selector is None:
            return pivot(df, [], _keys(v, df), f).withColumn("Measure", F.lit(";".join(v.measures)))
        keys = _keys(v, df, {a.selector})
        return pivot(df, ["Measure"], keys, f) if keys else pivot(df, [], [("Measure", v.measures)], f)
    if context.units is not None and a.selector is None and len({u["multiplier"] or 1 for u in unit_rules.measure_units(context.units, v.measures)}) > 1:
        df = unit_rules.scaled(df, context.units).drop("Unit")
    keys = [*rest, *(["Measure"] if a.selector else [])]
    if a.function in ("SUM", "AVG"):
        return df.groupBy(*map(col, keys)).agg((F.coalesce(f("Value"), F.lit(0.0)) if a.function == "SUM" else f("Value")).alias("Value"))
    over = a.selector or "Measure"
    order = list(v.codes(a.selector)) if a.selector else list(v.measures)
    place = F.array_position(F.array(*map(F.lit, order)), col(over)) if order else F.lit(0)
    best = (F.max if a.function == "MAX" else F.min)(F.struct(F.col("Value"), *((-place).alias("p"), col(over).alias("label")) if a.function == "MAX" else (place.alias("p"), col(over).alias("label"))))
    # first by label, where a hash table holds the numbers: of structs every row would be sorted
    df = df.groupBy(*map(col, dict.fromkeys([*keys, over]))).agg(f("Value").alias("Value"))
    out = df.groupBy(*map(col, keys)).agg(best.alias("best")).select(*map(col, keys), F.col("best.label").alias("label"), F.col("best.Value").alias("Value"))
    if a.selector is None and context.units is not None:  # the best measure, with its unit
        named = unit_rules.with_units(out.withColumn("Measure", F.col("label")), context.units)
        return named.select(*map(col, keys), "label", "Unit", "Value")
    return out


def _total(a: Aggregate, context: CubeContext) -> DataFrame:
    """Totals of the measures' row sums for each tuple of all dimensions: null if any addend is."""
    row = reduce(lambda x, y: x + y, map(col, a.inner.measures))
    return selected(a.inner, context).groupBy(*map(col, a.inner.groups)).agg(_FUNCTIONS[a.function](row).alias("Value"))


def _ranked(a: Aggregate, context: CubeContext) -> DataFrame:
    """Rows that hold the extreme, ties and all: the aggregate comes from a partial aggregation and is joined back as a
    single row, so no task ranks everything."""
    v = a.inner
    df = long_form(v, context)
    best = df.agg(_FUNCTIONS[a.function]("Value").alias("_best"))
    hit = df.join(F.broadcast(best), F.col("Value") == F.col("_best")).drop("_best")  # one row
    if a.selector:
        return hit.select(col(a.selector).alias(f"{a.function}[{a.selector}]"), "Measure", "Value")
    return hit.select("Measure", *map(col, v.groups), F.col("Value").alias(f"{a.function}[Value]"))


def _axis(v: Value, selectors: tuple[str, ...], context: CubeContext) -> DataFrame:
    """A VALUE with the selectors as rows, and the other dimensions (measures, if there are none) as columns."""
    df = long_form(v, context)
    keys = _keys(v, df, set(selectors))
    if not keys or len(v.measures) > 1:
        keys = [("Measure", list(v.measures)), *keys]
    return pivot(df, list(selectors), keys)


def _join(j: Join, mode: str, context: CubeContext) -> DataFrame:
    """Full outer join of any number of VALUEs.

    pivoted: rows are the selectors' members (joined by ", " in Measure, from the first input only), or measures if a
    selector is one. simplified: rows of the tables, on the dimensions that all share; keys are coalesced.
    """
    if mode == "simplified":
        tables = [selected(v, context) for v in j.inputs]
        keys = [g for g in j.inputs[0].groups if all(g in v.groups for v in j.inputs)]
        if not any(s in keys for s in j.selectors):
            keys += [m for m in j.inputs[0].measures if m in j.selectors and all(m in v.measures for v in j.inputs)]
        taken: set[str] = set(keys)
        parts = []
        for i, t in enumerate(tables):
            names = {c: c if c not in taken else f"{c}_{i}" for c in t.columns if c not in keys}
            taken |= set(names.values())
            parts.append(t.select(*map(col, keys), *(col(c).alias(n) for c, n in names.items())))
        return full_align(parts, keys)
    of_measure = not all(s in v.groups for s in j.selectors for v in j.inputs)
    axis = ("Measure",) if of_measure else j.selectors
    tables, taken = [], set(axis)
    for i, v in enumerate(j.inputs):
        t = _value(v, "pivoted", context) if of_measure else _axis(v, axis, context)
        names = {c: c if c not in taken else f"{c}_{i}" for c in t.columns if c not in axis}
        taken |= set(names.values())
        tables.append(t.select(*map(col, axis), *(col(c).alias(n) for c, n in names.items())))
    first = tables[0].withColumn("_first", F.lit(True)) if mode == "pivoted" else tables[0]
    out = full_align([first, *tables[1:]], list(axis))
    if of_measure:
        return out.drop("_first")
    key = F.concat_ws(", ", *map(col, axis)) if len(axis) > 1 else col(axis[0])
    if mode == "pivoted":
        key = F.when(F.col("_first"), key).otherwise(F.lit("") if len(axis) > 1 else F.lit(None))
    return out.select(key.alias("Measure"), *(col(c) for c in out.columns if c not in axis and c != "_first"))


def _aggregate_join(a: Aggregate, mode: str, context: CubeContext) -> DataFrame:
    j, f = a.inner, _FUNCTIONS[a.function]
    if context.units is not None:
        unit_rules.check(context.units, [m for v in j.inputs for m in v.measures], allow_scaling=mode != "pivoted")
    if mode == "simplified":
        measure = next((s for s in j.selectors if all(s in v.measures for v in j.inputs)), j.inputs[0].measures[0])
        return _join(j, mode, context).agg(f(col(measure)).alias("Value")).select(F.lit(measure).alias("Measure"), "Value")
    joined = _join(j, mode, context)
    cells = [c for c in joined.columns if "Measure" not in c]
    return joined.unpivot(["Measure"], [col(c) for c in cells], "name", "Value").where("Value IS NOT NULL").groupBy("Measure").agg(f("Value").alias("Value"))


def _proportion(p: Proportion, mode: str, context: CubeContext) -> DataFrame:
    """Total over the group, the selected codes' part and its percentage, for each tuple of the others."""
    v = p.inner
    df = long_form(v, context)
    rest = sorted(g for g in v.groups if g != p.group)
    codes = p.selected[:1] if mode == "native" else p.selected
    keys = [*map(col, rest), F.col("Measure")]
    part = F.sum(F.when(col(p.group).isin(list(codes)), F.col("Value")).otherwise(0.0))
    by = keys if mode == "native" else [F.concat_ws(", ", *keys).alias("Measure")]
    out = df.groupBy(*by).agg(F.sum("Value").alias("_total"), part.alias("_part"))
    percent = F.try_divide(F.col("_part") * 100.0, F.col("_total"))
    shown = [col(c) for c in (*rest, "Measure")] if mode == "native" else [F.col("Measure")]
    return out.select(*shown, F.col("_total").alias(f"SUM[{p.group}]"), F.col("_part").alias("_".join(codes)), (percent if mode == "native" else F.round(percent, 2)).alias("%"))


def compile(node: Node | str, context: CubeContext, mode: str = "pivoted") -> DataFrame:
    """The plan of an expression; nothing runs but lookups of members and units, which are bounded."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    node = read(node) if isinstance(node, str) else node
    match node:
        case Value():
            return _value(node, mode, context)
        case Join():
            return _join(node, mode, context)
        case Aggregate():
            return _aggregate(node, mode, context)
        case Proportion():
            return _proportion(node, mode, context)
    raise TypeError(node)
