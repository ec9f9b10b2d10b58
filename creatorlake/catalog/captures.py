"""Extraction, deduplication and first-N over captured responses."""

from __future__ import annotations

from creatorlake.catalog import inputs
from creatorlake.catalog.registry import query
from creatorlake.operators import dedup, extract, relations, topn
from creatorlake.sources.responses import decoded

AUTHORS_SQL = """
    SELECT event_id AS response_seq, 0 AS item_pos, '#' || event_type AS hashtag, CAST(user_id AS VARCHAR) AS user_id,
        'user' || user_id AS username, 'User ' || user_id AS display_name,
        'https://img.example.com/' || user_id || '.jpg' AS avatar_url,
        CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS verified,
        CAST(CASE event_type WHEN 'view' THEN trunc(value) ELSE floor(value * 100) END AS BIGINT) AS follower_count,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS following_count, event_id % 1000 AS heart_count,
        CAST(1 AS BIGINT) AS video_count
    FROM events WHERE event_type <> 'purchase'
    UNION ALL
    SELECT event_id, 3, '#' || event_type, CAST(user_id + 1 AS VARCHAR), 'user' || (user_id + 1), '', '', false,
        CAST(json_extract_string(props, '$.k') AS BIGINT), 0, 7, 0
    FROM events WHERE event_type NOT IN ('error', 'signup')"""

POSTS_SQL = """
    SELECT o_orderkey AS response_seq, 0 AS item_pos, CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS post_id,
        o_orderpriority AS description FROM orders
    UNION ALL SELECT o_orderkey, 2, CAST(o_custkey AS VARCHAR), CAST(o_orderkey // 2 AS VARCHAR), 'again' FROM orders"""

LINES_SQL = f"SELECT *, row_number() OVER (ORDER BY {inputs.LINE_ORDER}) AS seq FROM lineitem"

COMMENTS_SQL = f"""
    SELECT seq, 0 AS item_pos, CAST(l_orderkey AS VARCHAR) AS post_id, l_orderkey || '-' || l_linenumber AS comment_id,
        CAST(epoch(l_shipdate) AS BIGINT) AS create_time, CAST(l_suppkey AS VARCHAR) AS user_id FROM ({LINES_SQL})
    UNION ALL SELECT seq, 2, CAST(l_orderkey AS VARCHAR), 'p' || l_partkey, 0, CAST(l_suppkey AS VARCHAR) FROM ({LINES_SQL})"""

AUTHOR_COLUMNS = ("response_seq, item_pos, hashtag, user_id, username, display_name, avatar_url, verified, "
                  "follower_count, following_count, heart_count, video_count")
POST_COLUMNS = "response_seq, item_pos, user_id, post_id, description"
COMMENT_COLUMNS = "post_id, comment_id, create_time, user_id"


def authors(spark, sf_dir):
    return extract.extract_authors(decoded(inputs.search_captures(spark, sf_dir)))


def posts(spark, sf_dir):
    return extract.extract_posts(decoded(inputs.post_captures(spark, sf_dir)))


def comments(spark, sf_dir):
    return extract.extract_comments(decoded(inputs.comment_captures(spark, sf_dir)))


def _authors_out(df):
    return df.selectExpr(*AUTHOR_COLUMNS.split(", "))


def _posts_out(df):
    return df.selectExpr("response_seq", "item_pos", "user_id", "post_id",
                         "try_variant_get(raw_post_data, '$.desc', 'string') AS description")


def _comments_out(df):
    return df.selectExpr(*COMMENT_COLUMNS.split(", "))


def _kept(source: str, columns: str, keys: str, order: str) -> str:
    columns = "* EXCLUDE (rn)" if columns == "*" else columns
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn
        FROM ({source})) WHERE rn = 1"""


FIRST, LAST = "response_seq, item_pos", "response_seq DESC, item_pos DESC"
FIRST_SEQ, LAST_SEQ = "seq, item_pos", "seq DESC, item_pos DESC"
RANKED_SQL = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hashtag
            ORDER BY follower_count + heart_count DESC, response_seq, item_pos) AS rank
        FROM ({_kept(AUTHORS_SQL, "*", "hashtag, user_id", FIRST)})) WHERE rank <= 50"""
FIRST_POSTS_SQL = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {FIRST}) AS rank
        FROM ({_kept(POSTS_SQL, "*", "user_id, post_id", FIRST)})) WHERE rank <= 5"""
FIRST_COMMENTS_SQL = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY {FIRST_SEQ}) AS rank
        FROM ({_kept(COMMENTS_SQL, "*", "post_id, comment_id", FIRST_SEQ)})) WHERE rank <= 3"""


def ranked(spark, sf_dir):
    return topn.top_profiles_per_hashtag(authors(spark, sf_dir))


def trimmed_posts(spark, sf_dir):
    lists = inputs.post_captures(spark, sf_dir)
    return topn.first_posts_per_profile(extract.extract_posts(decoded(lists)), 5, topn.holds_hot_key(lists, "ctx_user_id"))


def trimmed_comments(spark, sf_dir):
    lists = inputs.comment_captures(spark, sf_dir)
    return topn.first_comments_per_post(extract.extract_comments(decoded(lists)), 3, topn.holds_hot_key(lists, "ctx_post_id"))


@query(f"SELECT {AUTHOR_COLUMNS} FROM ({AUTHORS_SQL})")
def extract_authors(spark, sf_dir):
    return _authors_out(authors(spark, sf_dir))


@query(f"SELECT {POST_COLUMNS} FROM ({POSTS_SQL})")
def extract_posts(spark, sf_dir):
    return _posts_out(posts(spark, sf_dir))


@query(f"SELECT {COMMENT_COLUMNS} FROM ({COMMENTS_SQL})")
def extract_comments(spark, sf_dir):
    return _comments_out(comments(spark, sf_dir))


@query(_kept(AUTHORS_SQL, AUTHOR_COLUMNS, "hashtag, user_id", FIRST))
def first_author_per_hashtag(spark, sf_dir):
    return _authors_out(dedup.keep_first(authors(spark, sf_dir), ["hashtag", "user_id"]))


@query(_kept(AUTHORS_SQL, AUTHOR_COLUMNS, "user_id", LAST))
def last_author(spark, sf_dir):
    return _authors_out(dedup.keep_last(authors(spark, sf_dir), ["user_id"]))


@query(_kept(POSTS_SQL, POST_COLUMNS, "user_id, post_id", FIRST))
def first_post_per_profile(spark, sf_dir):
    return _posts_out(dedup.keep_first(posts(spark, sf_dir), ["user_id", "post_id"]))


@query(_kept(COMMENTS_SQL, COMMENT_COLUMNS, "post_id, comment_id", FIRST_SEQ))
def first_comment_per_post(spark, sf_dir):
    return _comments_out(dedup.keep_first(comments(spark, sf_dir), ["post_id", "comment_id"]))


@query(f"""
    SELECT f.response_seq, f.item_pos, l.hashtag, l.user_id, l.username, l.display_name, l.avatar_url, l.verified,
        l.follower_count, l.following_count, l.heart_count, l.video_count
    FROM ({_kept(RANKED_SQL, "*", "user_id", LAST)}) l
    JOIN ({_kept(RANKED_SQL, "user_id, response_seq, item_pos", "user_id", FIRST)}) f USING (user_id)""")
def merged_profiles(spark, sf_dir):
    return _authors_out(relations.merge_profiles(ranked(spark, sf_dir)))


@query(_kept(FIRST_POSTS_SQL, POST_COLUMNS, "post_id", LAST))
def merged_posts(spark, sf_dir):
    return _posts_out(relations.merge_posts(trimmed_posts(spark, sf_dir)))


@query(_kept(FIRST_COMMENTS_SQL, COMMENT_COLUMNS, "comment_id", LAST_SEQ))
def merged_comments(spark, sf_dir):
    return _comments_out(relations.merge_comments(trimmed_comments(spark, sf_dir)))


@query(f"SELECT {AUTHOR_COLUMNS}, rank FROM ({RANKED_SQL})")
def top_profiles_per_hashtag(spark, sf_dir):
    df = ranked(spark, sf_dir)
    return df.selectExpr(*AUTHOR_COLUMNS.split(", "), "CAST(rn AS BIGINT) AS rank")


@query(f"SELECT {POST_COLUMNS}, rank FROM ({FIRST_POSTS_SQL})")
def first_n_posts(spark, sf_dir):
    df = trimmed_posts(spark, sf_dir)
    return df.selectExpr("response_seq", "item_pos", "user_id", "post_id",
                         "try_variant_get(raw_post_data, '$.desc', 'string') AS description", "CAST(rn AS BIGINT) AS rank")


@query(f"SELECT {COMMENT_COLUMNS}, rank FROM ({FIRST_COMMENTS_SQL})")
def first_n_comments(spark, sf_dir):
    return trimmed_comments(spark, sf_dir).selectExpr(*COMMENT_COLUMNS.split(", "), "CAST(rn AS BIGINT) AS rank")


@query("SELECT DISTINCT '#' || event_type AS hashtag, CAST(user_id AS VARCHAR) AS user_id FROM events")
def relation_edges(spark, sf_dir):
    return relations.hashtag_profile_edges(inputs.tag_edges(spark, sf_dir))


RUNS_SQL = "SELECT strftime(ts, '%Y%m%d') AS run_id, * FROM events"


def _runs(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").selectExpr("date_format(ts, 'yyyyMMdd') AS run_id", "*")


@query(f"SELECT * FROM ({RUNS_SQL}) WHERE run_id = (SELECT max(run_id) FROM ({RUNS_SQL}))")
def latest_snapshot(spark, sf_dir):
    from creatorlake.sources.snapshots import latest_run

    return latest_run(_runs(spark, sf_dir))


@query(f"""
    SELECT run_id, CASE WHEN dense_rank() OVER (ORDER BY run_id DESC) <= 3 THEN 'kept' ELSE 'expired' END AS state
    FROM (SELECT DISTINCT run_id FROM ({RUNS_SQL}))""")
def snapshot_states(spark, sf_dir):
    return topn.run_states(_runs(spark, sf_dir))
