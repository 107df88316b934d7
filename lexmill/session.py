"""Session helpers: a local session for tests, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def local_session(app: str = "lexmill", cores: str = "8", **conf: str) -> SparkSession:
    """A local session as used by the tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master gets a temporary folder when the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="lexmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lexmill-{uuid.uuid4().hex}/{name}"


# Bytes of a row group of wide rows, which a task buffers as it writes or reads.
GROUP_BYTES = 16 << 20


def written(df: DataFrame, name: str = "table", wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Ends the lineage, survives lost executors, and gives Catalyst the table's
    true size, so joins against it are broadcast only when it really is small.
    ``wide`` rows (packed documents, blocks of them) go to smaller row groups.
    """
    path = new_folder(df.sparkSession, name)
    writer = df.write.option("parquet.block.size", str(GROUP_BYTES)) if wide else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of whole texts in an Arrow batch, and bytes of any batch
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def bounded_batches(spark) -> None:
    """Let no Arrow batch of the session hold more than ``BATCH_ROWS`` rows or about
    ``BATCH_BYTES`` bytes.

    The defaults of 10,000 rows and 64 MiB suit numbers; with whole texts, packed documents or
    stored blocks they cost tens or hundreds of megabytes for each copy of a batch, in the
    executor and in its Python workers, and batches that leave the processor's cache take longer.
    """
    rows, size = (
        f"spark.sql.execution.arrow.max{kind}PerBatch" for kind in ("Records", "Bytes")
    )
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < as_bytes(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


@contextmanager
def wide_rows(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside read Parquet row by row.

    A column vector takes 4,096 rows, whatever their size: hundreds of megabytes of a task's heap
    for packed documents, and all blocks of a file for stored blocks of them.
    """
    name = "spark.sql.parquet.enableVectorizedReader"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written for one job, which deletes each when its last reader is done."""

    def __init__(self) -> None:
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = new_folder(df.sparkSession, name)
        df.write.parquet(path)
        table = df.sparkSession.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that nothing reads any more."""
        for table in tables:
            _, path = self._paths.pop(id(table))
            jvm, context = table.sparkSession._jvm, table.sparkSession._jsc
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context.hadoopConfiguration()).delete(folder, True)


def measured(df: DataFrame) -> DataFrame:
    """Cache an aggregated lookup and count it.

    The cached relation has exact size statistics: Catalyst broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    cached = df.persist()
    cached.count()
    return cached


def numbered(
    df: DataFrame, order: list[Column], name: str = "number", kind: str = "int"
) -> DataFrame:
    """Rows with their number, from 1, in a total order, without one task for all rows.

    Rows are range-sorted and written with their range's number; a row per range says how
    many rows come before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as partitions, whatever the table's size
    starts = (
        ranged.groupBy("_range")
        .count()
        .select("_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn(name, (F.col("_before") + place).cast(kind))
        .drop("_range", "_before")
    )


# Largest table sent to every executor on purpose.
BROADCAST_BYTES = 256 * 1024 * 1024


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table for broadcast after measuring it; a larger one is left to a shuffle.

    Catalyst judges the other side of such joins by the size of its files, which says
    little once texts have been exploded into terms.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    letters = sum((F.octet_length(c) for c in strings), F.lit(0))
    fixed = 16 * len(df.columns) + 16
    row = df.agg(F.coalesce(F.sum(letters + fixed), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if row["bytes"] <= limit else df


def task_count(spark: SparkSession) -> int:
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a *scan* over the cluster when it has fewer splits than cores.

    A file with a single row group is read by one task however large the cluster
    is. Large tables have plenty of splits and are returned unchanged.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(task_count(spark), *([F.col(key)] if key else []))


# Rows of a task whose work is per row, whatever their size.
TASK_ROWS = 50_000


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of a table, dealt out so that a task has about ``TASK_ROWS`` rows.

    Files of short rows hold millions per split; a task that builds and masks a text per row would
    grow with its split. Only the columns named are moved.
    """
    tasks = -(-df.count() // TASK_ROWS)
    return df.select(*columns).repartition(max(tasks, task_count(df.sparkSession)))
