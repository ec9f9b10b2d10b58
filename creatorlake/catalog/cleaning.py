"""Cleaning, quarantine and hashtag frequency."""

from __future__ import annotations

from creatorlake.catalog import inputs
from creatorlake.catalog.registry import query
from creatorlake.operators import cleaning
from creatorlake.operators.quality import error_log, quarantine

RUN = f"TIMESTAMP '{inputs.RUN_TS}'"
SPLIT = "regexp_split_to_array(lower(text), '\\s+')"

PROFILE_RULES = """
    concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'follower_count: integer, 0 or more' END,
        CASE WHEN c_mktsegment = 'BUILDING' AND (c_acctbal < 0 OR c_acctbal <> floor(c_acctbal)) THEN 'total_likes: integer, 0 or more' END,
        CASE WHEN c_nationkey % 5 = 4 THEN 'comment_setting: null or 0 to 3' END)"""

POST_RULES = """
    concat_ws('; ', CASE WHEN length(text) > 2000 THEN 'description: text, up to 2000' END,
        CASE WHEN n_chars % 700 NOT BETWEEN 1 AND 600 THEN 'duration: integer, 1 to 600' END,
        CASE WHEN lang = 'de' AND n_chars * 1000000000 > 67768036191676799 THEN 'posted_at: time' END)"""

COMMENT_RULES = """
    concat_ws('; ', CASE WHEN l_discount = 0 THEN 'digg_count: integer, 0 or more' END,
        CASE WHEN l_tax = 0 THEN 'reply_comment_total: integer' END)"""

# Every word of every text; a text's tags end at its first word that is no valid tag.
WORDS = f"SELECT source, doc_id, unnest({SPLIT}) AS tag, generate_subscripts({SPLIT}, 1) AS pos FROM documents"
BAD = "tag <> '' AND NOT (regexp_full_match(tag, '[a-z0-9_]+') AND length(tag) <= 100)"
KEPT = f"""
    SELECT source, doc_id, tag FROM ({WORDS}) LEFT JOIN (SELECT doc_id, min(pos) AS cut FROM ({WORDS}) WHERE {BAD} GROUP BY 1) USING (doc_id)
    WHERE tag <> '' AND (cut IS NULL OR pos < cut)"""


def checked_profiles(spark, sf_dir):
    return cleaning.check_profiles(inputs.profile_records(spark, sf_dir), inputs.RUN_TS)


def checked_posts(spark, sf_dir):
    return cleaning.check_posts(inputs.post_records(spark, sf_dir), inputs.RUN_TS, with_hashtags=False)


def checked_documents(spark, sf_dir, on_bad_hashtag="cut"):
    return cleaning.check_posts(inputs.tagged_documents(spark, sf_dir), inputs.RUN_TS, on_bad_hashtag)


def checked_comments(spark, sf_dir):
    return cleaning.check_comments(inputs.comment_records(spark, sf_dir), inputs.RUN_TS)


def checked_replies(spark, sf_dir):
    return cleaning.check_replies(cleaning.check_comments(inputs.reply_records(spark, sf_dir), inputs.RUN_TS))


def _rejected(checked, entity, record_id):
    return quarantine(checked, entity, record_id).selectExpr(
        "entity", "record_id", "array_join(violations, '; ') AS violations")


@query(f"""
    SELECT CAST(c_custkey AS VARCHAR) AS tiktok_id, c_name AS username, 'sec' || c_custkey AS sec_uid, lower(c_name) AS display_name,
        c_mktsegment AS bio_text, c_nationkey % 2 = 0 AS is_verified, false AS is_private,
        'https://www.example.com/@' || c_name AS profile_url, 'http://cdn.example.com/a%20b.png' AS avatar_thumb,
        CAST(NULL AS VARCHAR) AS avatar_medium, CAST(NULL AS VARCHAR) AS avatar_large,
        CAST(floor(c_acctbal) AS BIGINT) AS follower_count, CAST(c_nationkey AS BIGINT) AS following_count,
        CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_acctbal AS BIGINT) ELSE c_custkey END AS total_likes,
        CAST(0 AS BIGINT) AS video_count, c_nationkey % 5 AS comment_setting, CASE WHEN c_nationkey <> 7 THEN 3 END AS duet_setting,
        CAST(NULL AS INTEGER) AS stitch_setting, CAST(NULL AS INTEGER) AS download_setting,
        {RUN} AS created_at, {RUN} AS updated_at
    FROM customer WHERE {PROFILE_RULES} = ''""")
def clean_profiles(spark, sf_dir):
    return cleaning.influencers(checked_profiles(spark, sf_dir))


@query(f"SELECT 'profile' AS entity, CAST(c_custkey AS VARCHAR) AS record_id, {PROFILE_RULES} AS violations FROM customer WHERE {PROFILE_RULES} <> ''")
def quarantine_profiles(spark, sf_dir):
    return _rejected(checked_profiles(spark, sf_dir), "profile", "tiktok_id")


@query(f"""
    SELECT CAST(doc_id AS VARCHAR) AS post_id, source AS influencer_tiktok_id, text AS description, n_chars % 700 AS duration,
        CASE lang WHEN 'en' THEN n_chars ELSE 0 END AS view_count, CASE lang WHEN 'en' THEN n_chars ELSE 0 END AS like_count,
        CAST(0 AS BIGINT) AS comment_count, CAST(CASE lang WHEN 'en' THEN 7 ELSE 0 END AS BIGINT) AS share_count,
        CAST(CASE lang WHEN 'en' THEN 0 ELSE 12 END AS BIGINT) AS collect_count, doc_id % 2 = 1 AS is_ad, false AS is_pinned,
        CASE WHEN lang <> 'de' THEN TIMESTAMP '1970-01-01' + to_days(CAST(doc_id AS INTEGER))
            WHEN n_chars * 1000000000 <= 253402300799 THEN TIMESTAMP '1970-01-01' + to_seconds(n_chars * 1000000000)
            ELSE {RUN} END AS posted_at, {RUN} AS created_at
    FROM documents WHERE {POST_RULES} = ''""")
def clean_posts(spark, sf_dir):
    return cleaning.posts(checked_posts(spark, sf_dir))


@query(f"SELECT 'post' AS entity, CAST(doc_id AS VARCHAR) AS record_id, {POST_RULES} AS violations FROM documents WHERE {POST_RULES} <> ''")
def quarantine_posts(spark, sf_dir):
    return _rejected(checked_posts(spark, sf_dir), "post", "post_id")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS post_id, tag AS hashtag FROM ({KEPT})")
def post_hashtags(spark, sf_dir):
    return cleaning.post_hashtags(checked_documents(spark, sf_dir))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS post_id, tag AS hashtag FROM ({WORDS}) WHERE tag <> '' AND NOT ({BAD})")
def post_hashtags_skip(spark, sf_dir):
    return cleaning.post_hashtags(checked_documents(spark, sf_dir, "skip"))


@query(f"""
    SELECT influencer_tiktok_id, hashtag, count(*) AS frequency FROM (
        SELECT source AS influencer_tiktok_id, tag AS hashtag FROM ({KEPT})
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), lower(c_mktsegment) FROM customer, range(2) WHERE {PROFILE_RULES} = '')
    GROUP BY 1, 2""")
def hashtag_frequency(spark, sf_dir):
    counts = cleaning.tag_counts(
        cleaning.profile_tags(checked_profiles(spark, sf_dir)), cleaning.post_tags(checked_documents(spark, sf_dir)))
    return cleaning.hashtag_frequency(counts)


@query(f"""
    SELECT l_orderkey || '-' || l_linenumber AS comment_id, CAST(l_orderkey AS VARCHAR) AS post_id,
        CAST(l_suppkey AS VARCHAR) AS influencer_tiktok_id, l_shipdate AS create_time,
        CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag || l_linestatus END AS comment_text,
        CAST(l_quantity AS BIGINT) AS digg_count, CAST(l_linenumber AS BIGINT) AS reply_comment_total,
        CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE '' END AS share_title, '' AS share_desc
    FROM lineitem WHERE {COMMENT_RULES} = ''""")
def clean_comments(spark, sf_dir):
    return cleaning.comments(checked_comments(spark, sf_dir))


@query(f"""
    SELECT 'comment' AS entity, l_orderkey || '-' || l_linenumber AS record_id, {COMMENT_RULES} AS violations
    FROM lineitem WHERE {COMMENT_RULES} <> ''""")
def quarantine_comments(spark, sf_dir):
    return _rejected(checked_comments(spark, sf_dir), "comment", "comment_id")


@query(f"""
    SELECT {RUN} AS timestamp, 'CLEANING' AS phase, 'COMMENT_VALIDATION_ERROR' AS error_type,
        unnest(string_split({COMMENT_RULES}, '; ')) AS message, l_orderkey || '-' || l_linenumber AS item_id,
        CAST(NULL AS VARCHAR) AS exception_str
    FROM lineitem WHERE {COMMENT_RULES} <> ''""")
def comment_errors(spark, sf_dir):
    rejected = quarantine(checked_comments(spark, sf_dir), "comment", "comment_id")
    return error_log(rejected, "CLEANING", inputs.RUN_TS)


REPLIES = """
    SELECT conv_id || '-' || turn AS main_comment_id, conv_id || '-' || turn || n AS reply_comment_id, CAST(conv_id AS VARCHAR) AS replier_id,
        text AS reply_text, CASE n WHEN 'a' THEN turn ELSE 0 END AS digg_count, CASE n WHEN 'a' THEN role END AS label_text
    FROM conversations, (VALUES ('a'), ('c')) v(n) WHERE n = 'a' OR role = 'assistant'"""


@query(REPLIES)
def reply_rows(spark, sf_dir):
    return cleaning.reply_comments(checked_replies(spark, sf_dir))


@query(f"SELECT main_comment_id, count(*) AS reply_count FROM ({REPLIES}) GROUP BY 1")
def reply_counts(spark, sf_dir):
    return reply_rows(spark, sf_dir).groupBy("main_comment_id").count().withColumnRenamed("count", "reply_count")


@query("""
    SELECT 'reply' AS entity, conv_id || '-' || turn || 'b' AS record_id, 'digg_count: integer, 0 or more' AS violations
    FROM conversations WHERE role = 'assistant'""")
def quarantine_replies(spark, sf_dir):
    return _rejected(checked_replies(spark, sf_dir), "reply", "reply_comment_id")


@query(f"""
    SELECT influencer_tiktok_id, hashtag, count(*) AS frequency FROM (
        SELECT source AS influencer_tiktok_id, tag AS hashtag FROM ({WORDS}) WHERE tag <> '' AND NOT ({BAD})
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), lower(c_mktsegment) FROM customer, range(2) WHERE {PROFILE_RULES} = '')
    GROUP BY 1, 2""")
def hashtag_frequency_skip(spark, sf_dir):
    counts = cleaning.tag_counts(
        cleaning.profile_tags(checked_profiles(spark, sf_dir)), cleaning.post_tags(checked_documents(spark, sf_dir, "skip")))
    return cleaning.hashtag_frequency(counts)
