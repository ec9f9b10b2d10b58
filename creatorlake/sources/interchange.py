"""The nested export document: one JSON object holding all entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from creatorlake.schemas import INTERCHANGE_DOCUMENT

ENTITIES = ["profiles", "posts", "comments", "profile_hashtag_relations"]


def read_documents(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Whole documents, byte order mark allowed; unreadable files raise."""
    return (
        spark.read.schema(INTERCHANGE_DOCUMENT)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def entity_records(documents: DataFrame, entity: str) -> DataFrame:
    """``(record_pos, record)`` of one entity. A document is one task, so spread right after the explode."""
    rows = documents.select("source_file", F.posexplode(entity).alias("item_pos", "record"))
    return rows.select(F.struct("source_file", "item_pos").alias("record_pos"), "record").repartition("record_pos")


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The scalable landing form: one record per line, read in parallel splits. A line that does not
    parse stays as text, so that it ends in quarantine with its content."""
    # Splits are ordered by their start, lines inside a split by the running id.
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_id"),
        ).alias("record_pos"),
        "value",
    )
    return lines.select("record_pos", F.coalesce(F.try_parse_json("value"), F.col("value").cast("variant")).alias("record"))


def rows_as_records(df: DataFrame, record_pos: list[str], columns: list[str] | None = None) -> DataFrame:
    """Typed rows (for instance a Parquet landing table) as records."""
    chosen = columns or [c for c in df.columns if c not in record_pos]
    return df.select(
        F.struct(*record_pos).alias("record_pos"),
        F.to_variant_object(F.struct(*chosen)).alias("record"),
    )
