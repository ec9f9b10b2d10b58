"""Streaming queries: the events table arrives as a file stream, results land in a staged table."""

from __future__ import annotations

from creatorlake.catalog import inputs
from creatorlake.catalog.registry import query
from creatorlake.session import new_staging_path
from creatorlake.streaming import ingest


def _event_stream(spark, sf_dir):
    schema = inputs.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).selectExpr(
        # Watermarks need a zoned time; the session zone only moves both ends alike.
        "*", "CAST(ts AS TIMESTAMP) AS event_time")


def _landed(spark, df, name):
    path = new_staging_path(spark, name)
    ingest.append_stream(df, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/table")


@query("""
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, hashtag, count(*) AS uses
    FROM (SELECT date_trunc('hour', ts) AS window_start, event_type AS hashtag FROM events)
    GROUP BY 1, 2, 3""")
def stream_tag_counts(spark, sf_dir):
    tags = _event_stream(spark, sf_dir).selectExpr("event_time", "event_type AS hashtag")
    closed = _landed(spark, ingest.tag_count_stream(tags, "event_time", "2 hours", "1 hour"), "tag-counts")
    seen = inputs.table(spark, sf_dir, "events").selectExpr("CAST(ts AS TIMESTAMP) AS event_time", "event_type AS hashtag")
    df = ingest.with_open_windows(closed, seen, "event_time", "1 hour")
    return df.selectExpr("CAST(window_start AS TIMESTAMP_NTZ) AS window_start", "CAST(window_end AS TIMESTAMP_NTZ) AS window_end",
                         "hashtag", "uses")


@query("SELECT DISTINCT event_type AS hashtag, CAST(user_id AS VARCHAR) AS user_id FROM events")
def stream_dedup(spark, sf_dir):
    edges = _event_stream(spark, sf_dir).selectExpr("event_time", "event_type AS hashtag", "CAST(user_id AS STRING) AS user_id")
    landed = _landed(spark, ingest.dedup_stream(edges, ["hashtag", "user_id"], "event_time", "1 hour"), "dedup")
    return ingest.distinct_on_read(landed, ["hashtag", "user_id"])
