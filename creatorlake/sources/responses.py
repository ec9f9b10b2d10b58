"""Captured API responses: the bronze table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from creatorlake.constants import LARGE_RESPONSE_BYTES
from creatorlake.functions.bodies import first_of_list, is_large_response, parse_text
from creatorlake.functions.sql import matches
from creatorlake.functions.times import timestamp_literal
from creatorlake.schemas import RESPONSE


def read_responses(spark: SparkSession, path: str | list[str], fmt: str = "json") -> DataFrame:
    """Landed responses, one JSON object per line or Parquet rows."""
    reader = spark.read.schema(RESPONSE) if fmt == "json" else spark.read
    return reader.format(fmt).load(path)


def decoded(responses: DataFrame) -> DataFrame:
    """Bodies as parsed JSON; text that does not parse stays text; failed captures stay NULL."""
    # Two projections, so that each body is parsed once although its parse is used twice.
    parsed = responses.withColumn("body", F.expr(parse_text("body", "is_base64")))
    return parsed.withColumn("body", F.expr(first_of_list("body")))


def with_large_flag(responses: DataFrame) -> DataFrame:
    return responses.withColumn("is_large_response", F.expr(is_large_response("headers", LARGE_RESPONSE_BYTES)))


def routed(responses: DataFrame, endpoint: str) -> DataFrame:
    """Responses of one endpoint. ``url`` is a plain column, so the test runs before any body is parsed."""
    return responses.where(matches("url", f"(?i){endpoint}"))


def captured(responses: DataFrame) -> DataFrame:
    return responses.where("body IS NOT NULL AND NOT is_variant_null(body)")


def failed(responses: DataFrame) -> DataFrame:
    return responses.where("body IS NULL OR is_variant_null(body)")


def capture_errors(responses: DataFrame, run_ts) -> DataFrame:
    """One error row per failed capture, in the form of the error log. ``responses`` have an ``endpoint``."""
    return failed(responses).selectExpr(
        f"{timestamp_literal(run_ts)} AS timestamp", "upper(endpoint) AS phase", "'RESPONSE_ERROR' AS error_type",
        "concat('No body from ', url) AS message", "coalesce(ctx_hashtag, ctx_post_id, ctx_user_id) AS item_id",
        "CAST(NULL AS STRING) AS exception_str")
