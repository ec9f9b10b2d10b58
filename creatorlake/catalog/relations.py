"""Joins, flattening and what is still to do."""

from __future__ import annotations

from creatorlake.catalog import captures, inputs
from creatorlake.catalog.registry import ORACLES, query
from creatorlake.operators import relations
from creatorlake.sinks.bucketed import save_bucketed
from creatorlake.sources import supplied

SEGMENTS = "SELECT DISTINCT '#' || lower(c_mktsegment) AS hashtag FROM customer"
LOADED = "SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n FROM orders GROUP BY 1"
# One owner per comment id: lines repeat their key, the last in arrival order wins.
LAST_LINES = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY seq DESC) AS rn
        FROM ({captures.LINES_SQL})) WHERE rn = 1"""


def _post_owners(spark, sf_dir):
    """Every order as a post; those of status P have no known owner."""
    return inputs.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS post_id", "if(o_orderstatus <> 'P', CAST(o_custkey AS STRING), NULL) AS user_id")


def _users(spark, sf_dir, table, key, known, *columns):
    """Every row of a table as a user; where ``known`` does not hold, one whose id nothing else has."""
    return inputs.table(spark, sf_dir, table).selectExpr(f"concat(if({known}, '', 'unknown-'), {key}) AS user_id", *columns)


def _merged_comments(spark, sf_dir):
    return relations.merge_comments(inputs.comments(spark, sf_dir))


@query("""
    SELECT CAST(user_id AS VARCHAR) AS user_id, string_agg(DISTINCT '#' || event_type, ',' ORDER BY '#' || event_type) AS hashtags
    FROM events GROUP BY 1""")
def profile_hashtags(spark, sf_dir):
    df = relations.hashtags_by_profile(inputs.tag_edges(spark, sf_dir))
    return df.selectExpr("user_id", "array_join(found_under_hashtags, ',') AS hashtags")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, '#' || event_type AS hashtag FROM events")
def relation_rows(spark, sf_dir):
    return relations.relation_rows(inputs.tag_edges(spark, sf_dir))


@query(f"""
    SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS username, lower(c_name) AS display_name,
        'https://img.example.com/' || c_custkey AS avatar_url, c_nationkey % 2 = 0 AS verified,
        CAST(floor(c_acctbal) AS BIGINT) AS follower_count, CAST(c_nationkey AS BIGINT) AS following_count,
        c_custkey * 3 AS heart_count, c_custkey % 10 AS video_count, coalesce(n, 0) AS posts_count,
        '{inputs.RUN_TS}' AS load_timestamp, 'https://www.tiktok.com/@' || c_name AS profile_url,
        coalesce(tags, '[]') AS found_under_hashtags, '{{"id":' || c_custkey || '}}' AS raw_author_data
    FROM customer
    LEFT JOIN ({LOADED}) l ON l.user_id = CAST(c_custkey AS VARCHAR)
    LEFT JOIN (SELECT user_id, '[' || string_agg(DISTINCT '"#' || event_type || '"', ',' ORDER BY '"#' || event_type || '"') || ']' AS tags
        FROM events GROUP BY 1) e ON e.user_id = c_custkey""")
def flat_profiles(spark, sf_dir):
    from creatorlake.sinks.files import csv_ready

    posts = relations.profile_post_edges(inputs.posts(spark, sf_dir))
    df = relations.flat_profiles(inputs.profiles(spark, sf_dir), posts, inputs.tag_edges(spark, sf_dir), inputs.RUN_TS)
    return csv_ready(df)


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS post_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS user_id,
        '{"id":' || o_orderkey || '}' AS raw_post_data FROM orders""")
def flat_posts(spark, sf_dir):
    from creatorlake.sinks.files import csv_ready

    owners = _post_owners(spark, sf_dir)
    return csv_ready(relations.flat_posts(inputs.posts(spark, sf_dir), owners))


@query("""
    SELECT l_orderkey || '-' || l_linenumber AS comment_id, CAST(l_orderkey AS VARCHAR) AS post_id,
        CAST(l_suppkey AS VARCHAR) AS user_id, coalesce(c_name, '') AS profile_username,
        lower(coalesce(c_name, '')) AS profile_display_name, l_quantity AS digg_count,
        CAST(epoch(l_shipdate) AS BIGINT) AS create_time
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'
    LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'""")
def flat_comments(spark, sf_dir):
    owners = _post_owners(spark, sf_dir)
    known = _users(spark, sf_dir, "customer", "c_custkey", "c_mktsegment <> 'BUILDING'", "c_name AS username", "lower(c_name) AS display_name")
    df = relations.flat_comments(inputs.comments(spark, sf_dir), owners, known)
    return df.selectExpr("* EXCEPT (raw_comment_data)",
                         "try_variant_get(raw_comment_data, '$.digg_count', 'double') AS digg_count")


@query(SEGMENTS)
def todo_hashtags(spark, sf_dir):
    done = inputs.tag_edges(spark, sf_dir).select("hashtag")
    return relations.hashtags_to_do(inputs.requested_hashtags(spark, sf_dir), done)


@query(f"""
    SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer
    WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT user_id FROM ({LOADED}))""")
def todo_profiles(spark, sf_dir):
    posts = relations.profile_post_edges(inputs.posts(spark, sf_dir))
    flat = relations.flat_profiles(inputs.profiles(spark, sf_dir), posts, inputs.tag_edges(spark, sf_dir))
    return relations.profiles_to_do(flat).select("user_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS post_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def todo_posts(spark, sf_dir):
    edges = relations.post_comment_edges(inputs.comments(spark, sf_dir))
    return relations.posts_to_do(inputs.posts(spark, sf_dir).select("post_id"), edges)


@query("""
    SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS post_id
    FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def remaining_by_owner(spark, sf_dir):
    known = _users(spark, sf_dir, "customer", "c_custkey", "c_acctbal >= 0")
    return relations.to_do_by_owner(todo_posts(spark, sf_dir), inputs.posts(spark, sf_dir), known)


@query(f"SELECT 'search' AS phase, hashtag AS item_id FROM ({SEGMENTS})")
def resume_search(spark, sf_dir):
    return relations.resume_point(todo_hashtags(spark, sf_dir), todo_profiles(spark, sf_dir), todo_posts(spark, sf_dir))


@query("""
    WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
        c AS (SELECT CAST(o_orderkey AS VARCHAR) AS post_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
    SELECT 'profiles' AS phase, user_id AS item_id FROM p
    UNION ALL SELECT 'comments', post_id FROM c WHERE NOT EXISTS (SELECT 1 FROM p)
    UNION ALL SELECT 'complete', NULL WHERE NOT EXISTS (SELECT 1 FROM p) AND NOT EXISTS (SELECT 1 FROM c)""")
def resume_after_search(spark, sf_dir):
    done = inputs.tag_edges(spark, sf_dir).select("hashtag")
    searched = relations.hashtags_to_do(done, done)
    return relations.resume_point(searched, todo_profiles(spark, sf_dir), todo_posts(spark, sf_dir))


@query(f"""
    SELECT l_orderkey || '-' || l_linenumber AS comment_id, CAST(l_orderkey AS VARCHAR) AS post_id,
        CAST(o_custkey AS VARCHAR) AS user_id
    FROM ({LAST_LINES}) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'""")
def comment_owner(spark, sf_dir):
    owners = _post_owners(spark, sf_dir)
    return relations.comment_owner(_merged_comments(spark, sf_dir), owners)


@query("""
    SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, '#' || event_type AS hashtag
    FROM events JOIN customer ON c_custkey = user_id WHERE c_nationkey < 12""")
def supplied_profiles(spark, sf_dir):
    chosen = _users(spark, sf_dir, "customer", "c_custkey", "c_nationkey < 12")
    return supplied.from_profiles(chosen, inputs.tag_edges(spark, sf_dir))[1]


@query("""
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS post_id, CAST(l_suppkey AS VARCHAR) AS user_id
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0""")
def supplied_posts(spark, sf_dir):
    known = _users(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal > 0")
    mapping = inputs.comments(spark, sf_dir).select("post_id", "user_id")
    return supplied.from_posts(inputs.posts(spark, sf_dir), known, mapping)[1]


def _silver(spark, sf_dir):
    """Posts, comments and owners by post: written once, joined often."""
    frames = {"posts": inputs.posts(spark, sf_dir), "comments": inputs.comments(spark, sf_dir), "owners": _post_owners(spark, sf_dir)}
    return {name: save_bucketed(df, name, "post_id", 8) for name, df in frames.items()}


@query(ORACLES["flat_comments"])
def bucketed_comments(spark, sf_dir):
    silver = _silver(spark, sf_dir)
    known = _users(spark, sf_dir, "customer", "c_custkey", "c_mktsegment <> 'BUILDING'", "c_name AS username", "lower(c_name) AS display_name")
    return relations.flat_comments(silver["comments"], silver["owners"], known).selectExpr(
        "* EXCEPT (raw_comment_data)", "try_variant_get(raw_comment_data, '$.digg_count', 'double') AS digg_count")


@query(ORACLES["todo_posts"])
def bucketed_todo_posts(spark, sf_dir):
    silver = _silver(spark, sf_dir)
    return relations.posts_to_do(silver["posts"].select("post_id"), relations.post_comment_edges(silver["comments"]))


@query(ORACLES["comment_owner"].replace(LAST_LINES, "SELECT * FROM lineitem"))
def bucketed_comment_owners(spark, sf_dir):
    """Every line as a comment, repeated ids too."""
    silver = _silver(spark, sf_dir)
    return relations.comment_owner(silver["comments"], silver["owners"])
