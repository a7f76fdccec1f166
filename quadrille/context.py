"""Sessions: what every entry point sets or ships before it builds a plan, and tables that are written on the way."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for a SparkContext, so that functions in it unpickle there."""
    sc = spark.sparkContext
    if not getattr(sc, "_quadrille_shipped", False):
        folder = tempfile.mkdtemp(prefix="quadrille-")
        sc.addPyFile(shutil.make_archive(f"{folder}/quadrille", "zip", PACKAGE.parent, PACKAGE.name))
        sc._quadrille_shipped = True
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share, spark.checkpoint.dir; what is there goes when the driver ends. Only a
    local session without that setting gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet and read from there: for tables that several parts of a plan read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The table to be broadcast if it has no more rows than that, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def weigh_files(spark: SparkSession, factor: float = 40.0) -> None:
    """Files count as so many times their bytes where Spark decides what to broadcast: terms of a graph share most of their
    letters and take some forty times as much in memory, where a table of a million would go through the driver as a small
    one. A setting of the session, raised for good; tables that turn out small while a plan runs are still broadcast."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) < factor:
        spark.conf.set(name, str(factor))
