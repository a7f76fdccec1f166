"""The catalog: tables of tables, nodes, labels, hierarchy and units, and the lookups over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.operators.reshape import col


@dataclass(frozen=True)
class Catalog:
    """tables(table_id, title, description), nodes(table_id, node_id, kind, is_time, is_geo, has_parent),
    labels(table_id, node_id, label, alt_label, definition), hierarchy(parent, child),
    units(node_id, unit, unit_string, multiplier, scaling_of, is_dimensionless)."""

    tables: DataFrame
    nodes: DataFrame
    labels: DataFrame
    hierarchy: DataFrame
    units: DataFrame

    def table_graph(self, table: str, include_time_geo: bool = True) -> DataFrame:
        """Nodes of a table with labels, parents and units."""
        nodes = self.nodes.where(F.col("table_id") == table)
        if not include_time_geo:
            nodes = nodes.where(~F.col("is_time") & ~F.col("is_geo"))
        labels = self.labels.select("table_id", "node_id", "label", "alt_label")
        parents = self.hierarchy.select(F.col("child").alias("node_id"), "parent")
        units = self.units.select("node_id", "unit", "multiplier")
        return nodes.join(labels, ["table_id", "node_id"], "left").join(parents, "node_id", "left").join(units, "node_id", "left")

    def subgraph(self, node_ids: DataFrame) -> DataFrame:
        """Nodes of all tables that hold one of the given nodes (column node_id) or are given themselves."""
        held = self.nodes.join(node_ids, "node_id", "left_semi").select("table_id")
        named = self.tables.join(node_ids.select(F.col("node_id").alias("table_id")), "table_id", "left_semi").select("table_id")
        return self.nodes.join(held.union(named).distinct(), "table_id", "left_semi")

    def measures_and_dimensions(self, node_ids: DataFrame) -> DataFrame:
        return self.subgraph(node_ids).where(F.col("kind").isin("measure", "dimension")).select("table_id", "node_id", "kind")

    def codes(self, table: str, dimension: str | None = None, time: bool | None = None, geo: bool | None = None) -> DataFrame:
        """(node_id, label) of a table's codes: of a dimension, or of its time or geography."""
        nodes = self.nodes.where((F.col("table_id") == table) & (F.col("kind") == "code"))
        for name, wanted in (("is_time", time), ("is_geo", geo)):
            nodes = nodes if wanted is None else nodes.where(F.col(name) == wanted)
        if dimension is not None:
            nodes = nodes.join(self.hierarchy.where(F.col("parent") == dimension).select(F.col("child").alias("node_id")), "node_id", "left_semi")
        return nodes.join(self.labels, ["table_id", "node_id"], "left").select("node_id", "label")

    def measure_units(self, table: str) -> DataFrame:
        """(node_id, units): the known units of each measure, without nulls."""
        measures = self.nodes.where((F.col("table_id") == table) & (F.col("kind") == "measure")).select("node_id")
        return measures.join(self.units, "node_id", "left").groupBy("node_id").agg(F.array_sort(F.collect_set("unit")).alias("units"))

    def schema_dimensions(self) -> DataFrame:
        """Dimensions that have no parent and are neither time nor geography."""
        dims = self.nodes.where("kind = 'dimension'")
        return dims.join(self.hierarchy.select(F.col("child").alias("node_id")), "node_id", "left_anti").join(self.nodes.where("is_time OR is_geo").select("node_id"), "node_id", "left_anti").select("table_id", "node_id")


def prompt_nodes(nodes: DataFrame, hierarchy: DataFrame, scores: DataFrame, most: int = 500) -> DataFrame:
    """(table_id, position, node_id, kind, score): the order in which a prompt names a table's nodes, the first `most`.

    nodes: (table_id, node_id, kind), kind `measure`, `dimension` for a group or `code`; scores: (table_id, node_id, score).
    Measures come first, then each group with its codes below it, groups by the best score among themselves and their
    codes, then codes without a group; within each, scored ones first and best first, then by node_id.
    """
    scored = nodes.join(scores, ["table_id", "node_id"], "left")
    parents = hierarchy.select(F.col("child").alias("node_id"), "parent")
    groups = nodes.where("kind = 'dimension'").select("table_id", F.col("node_id").alias("parent"), F.lit(True).alias("_known"))
    owned = scored.join(parents, "node_id", "left").join(groups, ["table_id", "parent"], "left")
    group = F.when(F.col("kind") == "dimension", F.col("node_id")).when((F.col("kind") == "code") & F.col("_known"), F.col("parent"))
    best = F.max("score").over(Window.partitionBy("table_id", "_group"))
    part = F.when(F.col("kind") == "measure", 0).when(F.col("_group").isNotNull(), 1).otherwise(2)
    placed = owned.withColumn("_group", group).withColumn("_part", part).withColumn("_best", F.when(F.col("_part") == 1, best))
    order = Window.partitionBy("table_id").orderBy("_part", F.desc_nulls_last("_best"), F.asc_nulls_first("_group"), (F.col("kind") != "dimension").cast("int") * F.col("_group").isNotNull().cast("int"), F.desc_nulls_last("score"), "node_id")
    return placed.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= most).select("table_id", "position", "node_id", "kind", "score")


def enriched_bodies(tables: DataFrame, nodes: DataFrame, labels: DataFrame, enrich: bool = True) -> DataFrame:
    """(table_id, body): a table's texts (table_id, text; several rows each), each ending in a full stop, and, if enrich, the
    labels and other labels of its measures and dimensions' codes that are neither time nor geography."""
    sentence = F.when(F.trim("text").endswith("."), F.trim("text")).otherwise(F.concat(F.trim("text"), F.lit(".")))
    base = tables.where("trim(text) <> ''").groupBy("table_id").agg(F.array_join(F.array_sort(F.collect_list(sentence)), " ").alias("body"))
    if not enrich:
        return base
    telling = nodes.where("NOT is_time AND NOT is_geo").select("table_id", "node_id").distinct().join(labels, ["table_id", "node_id"])
    words = telling.select("table_id", F.explode(F.array_compact(F.array("label", "alt_label"))).alias("l")).groupBy("table_id").agg(F.array_join(F.array_sort(F.collect_set("l")), " ").alias("_labels"))
    return base.join(words, "table_id", "left").select("table_id", F.concat_ws(" ", "body", "_labels").alias("body"))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, kept as Parquet at `path`: read from there if it was written to the end, else built and written."""
    sc = spark.sparkContext
    done = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def time_coverage(rows: DataFrame, table: str, label: Column) -> DataFrame:
    """(table, coverage): first and last year of the labels with a dash between, or the one year."""
    years = rows.groupBy(table).agg(F.min(label).alias("a"), F.max(label).alias("b")).select(table, F.substring("a", 1, 4).alias("a"), F.substring("b", 1, 4).alias("b"))
    return years.select(table, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws("–", "a", "b")).alias("coverage"))


def schema_labels(labels: DataFrame, by: list[str], label: str) -> DataFrame:
    """Distinct labels of each group, sorted."""
    return labels.groupBy(*by).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def translated(df: DataFrame, column: str, labels: DataFrame, composite: bool = False) -> DataFrame:
    """Codes as labels, unknown ones as they are. Labels are looked up exactly, without blanks at the end of a code; with
    composite, a cell is several codes with ", " between."""
    of = labels.groupBy(F.rtrim("node_id").alias("_code")).agg(F.max("label").alias("_label"))
    if not composite:
        out = df.join(of, F.rtrim(col(column)) == F.col("_code"), "left")
        return out.withColumn(column, F.coalesce("_label", col(column))).drop("_code", "_label")
    cells = df.select(col(column)).distinct().select(col(column).alias("_cell"), F.posexplode(F.split(col(column), ", ")).alias("_i", "_part"))
    named = cells.join(of, F.rtrim("_part") == F.col("_code"), "left").groupBy("_cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_label", "_part").alias("l")))), lambda s: s["l"]), ", ").alias("_label"))
    return df.join(named, col(column) == F.col("_cell"), "left").withColumn(column, F.coalesce("_label", col(column))).drop("_cell", "_label")


def refreshed_units(units: DataFrame, unit_dict: DataFrame) -> DataFrame:
    """Units and multipliers as unit_dict (unit_string, unit, multiplier) has them, others as they were."""
    new = unit_dict.select("unit_string", F.col("unit").alias("_unit"), F.col("multiplier").cast("double").alias("_multiplier"), F.lit(True).alias("_known"))
    out = units.join(new, "unit_string", "left")
    return out.withColumn("unit", F.when(F.col("_known"), F.col("_unit")).otherwise(F.col("unit"))).withColumn("multiplier", F.when(F.col("_known"), F.col("_multiplier")).otherwise(F.col("multiplier"))).drop("_unit", "_multiplier", "_known")
