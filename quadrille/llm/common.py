"""What several training-data operators share: the shared folder, byte words, ranks in buckets, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that a Python worker is handed at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: Lower-cases A-Z; ASCII that is neither a letter nor a digit becomes a blank; bytes from 0x80 stay.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased UTF-8 text; none for a null."""
    return text.translate(WORD_TABLE).split() if text else []


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def plus(df: DataFrame, ddl: str) -> T.StructType:
    """df's schema with the columns of ddl after it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def others_of(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those of these names, in any case: an operator's own columns replace given ones of their names."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows and BATCH_BYTES bytes, as whole texts at the session's default of
    10,000 rows fill Python workers and Arrow buffers. These are settings of the session, read when the plan runs, so they
    are lowered there for good; limits that the session sets below them stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(-?\d+)b?", conf.get(f"spark.sql.execution.arrow.{name}"), re.IGNORECASE)
        if not now or not 0 < int(now[1]) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", most)
    return df.mapInArrow(f, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only a local session without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: this cuts the lineage, survives lost executors,
    and gives the planner true sizes. The path is kept as .written_to for discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _path(df: DataFrame, at: str) -> tuple:
    """Hadoop's file system and path."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def remove_at_exit(df: DataFrame, at: str) -> None:
    """Has the driver remove what is at a path when it ends, if nothing did before."""
    store, path = _path(df, at)
    store.deleteOnExit(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialise() that nothing will read again."""
    for df in tables:
        store, path = _path(df, df.written_to)
        store.delete(path, True)


def numbered(df: DataFrame, key: list[str], order: list[Column], salt: Column, rows: int, out: str, per_bucket: int = 1000, most: int = 4096) -> DataFrame:
    """Adds `out`: a gapless number from 0 within each key, whatever the key's size.

    Rows of a key are dealt to buckets by `salt` (a hash of the row): about one for per_bucket of all `rows`, and `most`
    at most, which keeps the table of counts small. Buckets are counted with map-side aggregation, a running sum over
    the counts gives each bucket its base, and only rows of one bucket meet in a task.
    """
    n = min(max(1, -(-rows // per_bucket)), most)
    spread = df.withColumn("_bucket", F.pmod(salt, F.lit(n)).cast("int"))
    counts = spread.groupBy(*key, "_bucket").agg(F.count("*").alias("_n"))
    base = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*key, "_bucket", F.coalesce(F.sum("_n").over(base), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, "_bucket").orderBy(*order)
    ranked = spread.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(bases, [*key, "_bucket"]).withColumn(out, (F.col("_base") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_base")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges that this task holds: at most one edge (child, smallest node) for each node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    kids = list(parent)
    for i in range(0, len(kids), 50_000):
        part = kids[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(k) for k in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: (node, root) for every node with an edge; root is the smallest node.

    Each task first replaces its edges by a spanning forest; then large-star and small-star rounds (Kiveris et al.)
    go on until nothing changes, O(log n) of them in practice. Minima are aggregated map-side and joined from written
    tables, so that a hub's edges can be split between tasks. Self-loops and repeats are harmless; no edges, no rows.
    """
    forest = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "a long, b long")
    now = materialise(forest.distinct(), "edges")
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        discard(low, now)
        low = materialise(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "minima")
        kept = large.join(low, large["a"] == low["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = materialise(kept.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        discard(low, large)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
