"""Session settings and the shared staging folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Sized by data, not by guess: AQE merges small shuffle partitions and splits skewed ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Wide projections over VARIANT outgrow what HotSpot compiles; then use split projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "creatorlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one in one-process local mode only.

    Each run writes folders of its own names there and removes none: a later run may still read them, so
    expiring them is left to the folder's owner (a lifecycle rule, or a sweep after the job)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="creatorlake-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the staging folder and read it back: later uses cost a scan, and a lost
    executor costs one task, not the whole lineage."""
    spark = df.sparkSession
    path = new_staging_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Names the partition count a caller wants inputs dealt out to; unset, ``dealt`` decides by the rows of scan tasks.
INPUT_PARTITIONS = "spark.creatorlake.inputPartitions"
#: Dealt out: a task with more rows than LEAST_ROWS and twice a core's even share; into tasks of ROWS_PER_TASK rows at most.
LEAST_ROWS, ROWS_PER_TASK = 1000, 500_000


def dealt(df: DataFrame) -> DataFrame:
    """Parsing payloads costs far more than reading them, and a file with one row group is one task, however many rows it
    has. So rows are counted per scan task first, which reads the files' footers only; where one task holds far more than
    its share, rows are dealt out over all cores. Scans that are even stay as they are."""
    spark = df.sparkSession
    wanted = spark.conf.get(INPUT_PARTITIONS, None)
    if wanted:
        return df.repartition(int(wanted))
    held = df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
    most, total = held["most"] or 0, held["total"] or 0
    cores = spark.sparkContext.defaultParallelism
    if most <= max(LEAST_ROWS, 2 * total / cores):
        return df
    return df.repartition(max(min(2 * cores, total // LEAST_ROWS + 1), total // ROWS_PER_TASK + 1))
