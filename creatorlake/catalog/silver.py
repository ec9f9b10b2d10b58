"""Fields read from payloads that were written whole."""

from __future__ import annotations

from creatorlake.catalog import inputs
from creatorlake.catalog.registry import query
from creatorlake.session import stage
from creatorlake.sources import silver


@query("""
    SELECT doc_id AS record_pos, source AS user_id, text AS description, doc_id % 2 AS is_ad, CASE WHEN lang = 'en' THEN n_chars END AS likes,
        CASE WHEN lang = 'en' THEN doc_id % 97 + 0.5::DOUBLE END AS comments, CAST(NULL AS BIGINT) AS extras FROM documents""")
def silver_typed_fields(spark, sf_dir):
    table = stage(inputs.post_records(spark, sf_dir), "silver-posts")
    # A list is no number.
    return silver.typed_fields(table, "record", {
        "user_id": ("$.user_id", "string"), "description": ("$.raw_post_data.desc", "string"), "is_ad": ("$.raw_post_data.isAd", "bigint"),
        "likes": ("$.raw_post_data.stats.diggCount", "bigint"), "comments": ("$.raw_post_data.stats.commentCount", "double"),
        "extras": ("$.raw_post_data.textExtra", "bigint")})


@query("""
    SELECT doc_id AS record_pos, CASE WHEN lang = 'en' THEN '"' || format('{:,}', n_chars) || '"' ELSE '0' END AS plays,
        '0' AS through_text, '"none"' AS missing FROM documents""")
def silver_defaulted_fields(spark, sf_dir):
    table = stage(inputs.post_records(spark, sf_dir), "silver-posts")
    fields = {"plays": ("raw_post_data.stats.playCount", "0"), "through_text": ("raw_post_data.desc.x", "0"), "missing": ("raw_post_data.gone", '"none"')}
    return silver.defaulted_fields(table, "record", fields).selectExpr("record_pos", *[f"to_json({name}) AS {name}" for name in fields])
