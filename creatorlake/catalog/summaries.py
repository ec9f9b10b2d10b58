"""Summaries."""

from __future__ import annotations

from creatorlake.catalog import captures, inputs
from creatorlake.catalog.cleaning import checked_documents, checked_profiles
from creatorlake.catalog.registry import query
from creatorlake.operators import cleaning, relations, summaries
from creatorlake.session import stage

REQUESTED = "SELECT DISTINCT event_type AS hashtag FROM events UNION SELECT DISTINCT ' #' || lower(c_mktsegment) FROM customer"


@query(f"""
    SELECT count(*) AS total_unique_profiles, avg(follower_count) AS avg_followers, max(follower_count) AS max_followers,
        avg(heart_count) AS avg_hearts, max(heart_count) AS max_hearts,
        (SELECT count(*) FROM events) AS total_api_responses
    FROM ({captures._kept(captures.AUTHORS_SQL, "*", "user_id", captures.LAST)})""")
def search_summary(spark, sf_dir):
    responses = inputs.search_captures(spark, sf_dir)
    return summaries.search_summary(captures.dedup.keep_last(captures.authors(spark, sf_dir), ["user_id"]), responses)


@query(f"SELECT hashtag, count(*) AS profile_count FROM ({captures.RANKED_SQL}) GROUP BY 1")
def profiles_per_hashtag(spark, sf_dir):
    return summaries.profiles_per_hashtag(captures.ranked(spark, sf_dir))


@query("SELECT '#' || event_type AS hashtag, count(DISTINCT user_id) AS profile_count FROM events GROUP BY 1")
def hashtag_distribution(spark, sf_dir):
    return summaries.hashtag_distribution(inputs.tag_edges(spark, sf_dir))


@query(f"""
    SELECT hashtag, TIMESTAMP '{inputs.RUN_TS}' AS search_timestamp, coalesce(n, 0) AS profiles_found
    FROM (SELECT DISTINCT '#' || event_type AS hashtag FROM events UNION SELECT DISTINCT '#' || lower(c_mktsegment) FROM customer)
    LEFT JOIN (SELECT '#' || event_type AS hashtag, count(DISTINCT user_id) AS n FROM events GROUP BY 1) USING (hashtag)""")
def hashtag_metadata(spark, sf_dir):
    from creatorlake.functions.tags import with_hash

    requested = inputs.requested_hashtags(spark, sf_dir).selectExpr(f"{with_hash('hashtag')} AS hashtag")
    edges = relations.hashtag_profile_edges(inputs.tag_edges(spark, sf_dir))
    return summaries.hashtag_metadata(requested, edges, inputs.RUN_TS)


@query("""
    SELECT a AS total_profiles_attempted, ok AS successful_loads, a - ok AS failed_loads, ok / a * 100 AS success_rate,
        n AS total_posts_collected, n / ok AS average_posts_per_profile
    FROM (SELECT (SELECT count(*) FROM customer) AS a, (SELECT count(DISTINCT o_custkey) FROM orders) AS ok,
        (SELECT count(*) FROM orders) AS n)""")
def load_summary(spark, sf_dir):
    return summaries.load_summary(inputs.profiles(spark, sf_dir), inputs.posts(spark, sf_dir))


@query("""
    SELECT a AS total_posts_attempted, ok AS successful_posts, a - ok AS failed_posts, ok / a * 100 AS success_rate,
        n AS total_comments_collected, n / ok AS average_comments_per_post,
        (SELECT count(*) FROM events WHERE event_type = 'error') AS error_count
    FROM (SELECT (SELECT count(*) FROM orders) AS a,
        (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS ok,
        (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS n)""")
def comments_summary(spark, sf_dir):
    from creatorlake.sources.responses import failed

    errors = failed(inputs.event_captures(spark, sf_dir))
    return summaries.comments_summary(inputs.posts(spark, sf_dir), inputs.comments(spark, sf_dir), errors)


FAILED_SQL = f"""
    SELECT 'hashtags' AS kind, hashtag AS item_id FROM ({REQUESTED}) WHERE hashtag NOT IN (SELECT event_type FROM events)
    UNION ALL SELECT 'profiles', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'posts', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


def _failed(spark, sf_dir):
    ranked = inputs.table(spark, sf_dir, "events").selectExpr("event_type AS hashtag")
    posts = inputs.posts(spark, sf_dir)
    return summaries.failed_items(
        inputs.requested_hashtags(spark, sf_dir), ranked, inputs.profiles(spark, sf_dir), posts, posts,
        inputs.comments(spark, sf_dir))


@query(FAILED_SQL)
def failed_items(spark, sf_dir):
    return _failed(spark, sf_dir)


RELATIONSHIP_SQL = f"""
    SELECT h AS hashtags_count, u AS profiles_count, p AS posts_count, c AS comments_count,
        (SELECT count(DISTINCT o_custkey) FROM orders) AS profiles_with_posts,
        (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS posts_with_comments,
        (SELECT count(*) FROM ({FAILED_SQL}) WHERE kind = 'hashtags') AS failed_hashtags,
        (SELECT count(*) FROM ({FAILED_SQL}) WHERE kind = 'profiles') AS failed_profiles,
        (SELECT count(*) FROM ({FAILED_SQL}) WHERE kind = 'posts') AS failed_posts,
        (SELECT count(*) FROM events WHERE event_type = 'error') AS total_errors,
        p / u AS avg_posts_per_profile, c / p AS avg_comments_per_post
    FROM (SELECT (SELECT count(*) FROM ({REQUESTED})) AS h, (SELECT count(*) FROM customer) AS u,
        (SELECT count(*) FROM orders) AS p, (SELECT count(*) FROM lineitem) AS c)"""


def _relationship_summary(spark, sf_dir):
    from creatorlake.sources.responses import failed

    posts, comments = inputs.posts(spark, sf_dir), inputs.comments(spark, sf_dir)
    return summaries.relationship_summary(
        inputs.requested_hashtags(spark, sf_dir), inputs.profiles(spark, sf_dir), posts, comments, posts, comments,
        _failed(spark, sf_dir), failed(inputs.event_captures(spark, sf_dir)))


@query(RELATIONSHIP_SQL)
def relationship_summary(spark, sf_dir):
    return _relationship_summary(spark, sf_dir)


@query("""
    SELECT count(*) AS total_requests, count(*) FILTER (event_type <> 'error') AS successful_responses,
        count(*) FILTER (event_type = 'error') AS failed_responses,
        count(*) FILTER (event_type <> 'view' AND CAST(trunc(value * 20000) AS BIGINT) > 1048576) AS large_responses,
        count(*) FILTER (event_type <> 'error') / count(*) * 100 AS success_rate
    FROM events""")
def capture_summary(spark, sf_dir):
    from creatorlake.sources.responses import with_large_flag

    return summaries.capture_summary(with_large_flag(inputs.event_captures(spark, sf_dir)))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS user_id, count(*) AS comment_count FROM lineitem GROUP BY 1")
def comments_per_owner(spark, sf_dir):
    return summaries.comments_per_owner(inputs.comments(spark, sf_dir))


@query("""
    SELECT '2025-01-01 00:00:00' AS export_timestamp, '2025-01-01' AS export_date, '00:00:00' AS export_time,
        '20250101_000000' AS file_version, CAST(5 AS BIGINT) AS total_files_created,
        (SELECT count(*) FROM customer) AS profiles_count, (SELECT count(*) FROM orders) AS posts_count,
        (SELECT count(*) FROM lineitem) AS comments_count,
        (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS relations_count""")
def export_metadata(spark, sf_dir):
    tables = {
        "profiles": inputs.profiles(spark, sf_dir), "posts": inputs.posts(spark, sf_dir),
        "comments": inputs.comments(spark, sf_dir),
        "profile_hashtag_relations": relations.relation_rows(inputs.tag_edges(spark, sf_dir)),
    }
    return summaries.export_metadata(tables, inputs.RUN_TS, 5)


@query(f"""
    WITH s AS ({RELATIONSHIP_SQL})
    SELECT 'general' AS category, 'profiles_count' AS metric, CAST(profiles_count AS VARCHAR) AS value FROM s
    UNION ALL SELECT 'general', 'deep', '[{{"posts":' || posts_count || '}}]' FROM s
    UNION ALL SELECT 'relationships', 'profiles_with_posts', CAST(profiles_with_posts AS VARCHAR) FROM s
    UNION ALL SELECT 'relationships', 'posts_with_comments', CAST(posts_with_comments AS VARCHAR) FROM s
    UNION ALL SELECT 'failed_items', 'total_errors', CAST(total_errors AS VARCHAR) FROM s
    UNION ALL SELECT 'failed_items', 'deep', '{{"posts":' || failed_posts || '}}' FROM s""")
def summary_long(spark, sf_dir):
    nested = _relationship_summary(spark, sf_dir).selectExpr(
        "profiles_count", "array(struct(posts_count AS posts)) AS deep",
        "struct(profiles_with_posts, posts_with_comments) AS relationships",
        "struct(total_errors, struct(failed_posts AS posts) AS deep) AS failed_items")
    return summaries.summary_long(nested)


@query("""
    WITH valid AS (SELECT * FROM customer WHERE c_acctbal >= 0 AND c_nationkey % 5 < 4
            AND (c_mktsegment <> 'BUILDING' OR c_acctbal = floor(c_acctbal))),
        words AS (SELECT source, doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS tag,
            generate_subscripts(regexp_split_to_array(lower(text), '\\s+'), 1) AS pos FROM documents),
        cuts AS (SELECT doc_id, min(pos) AS cut FROM words
            WHERE tag <> '' AND NOT (regexp_full_match(tag, '[a-z0-9_]+') AND length(tag) <= 100) GROUP BY 1),
        kept AS (SELECT source, doc_id, tag FROM words LEFT JOIN cuts USING (doc_id) WHERE tag <> '' AND (cut IS NULL OR pos < cut))
    SELECT 'influencers' AS item, (SELECT count(*) FROM valid) AS row_count
    UNION ALL SELECT 'posts', (SELECT count(*) FROM documents)
    UNION ALL SELECT 'post_hashtags', (SELECT count(*) FROM kept)
    UNION ALL SELECT 'hashtag_influencer_pairs', (SELECT count(*) FROM (SELECT DISTINCT source, tag FROM kept))
        + 2 * (SELECT count(*) FROM valid)""")
def cleaning_summary(spark, sf_dir):
    # Parsed once each, as in the cleaning plan: three counts read the posts.
    profiles, posts = stage(checked_profiles(spark, sf_dir), "profiles"), stage(checked_documents(spark, sf_dir), "posts")
    counts = cleaning.tag_counts(cleaning.profile_tags(profiles), cleaning.post_tags(posts))
    tables = {"influencers": cleaning.influencers(profiles), "posts": cleaning.posts(posts),
              "post_hashtags": cleaning.post_hashtags(posts)}
    return summaries.cleaning_summary(tables, counts)
