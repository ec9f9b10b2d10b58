"""Engagement metrics (definitions of this project)."""

from __future__ import annotations

from creatorlake.catalog import inputs
from creatorlake.catalog.registry import query
from creatorlake.operators import metrics

INFLUENCERS = """
    SELECT CAST(c_custkey AS VARCHAR) AS influencer_tiktok_id, CAST(floor(abs(c_acctbal) * 120) AS BIGINT) AS follower_count,
        c_nationkey AS following_count, c_nationkey % 4 AS bio_kind FROM customer"""
POSTS = """
    SELECT CAST(o_orderkey AS VARCHAR) AS post_id, CAST(o_custkey AS VARCHAR) AS influencer_tiktok_id,
        CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS view_count,
        o_orderkey % 1000 + o_orderkey % 100 + o_orderkey % 10 AS engagement FROM orders"""
CREATORS = f"""
    SELECT influencer_tiktok_id, count(*) AS post_count, sum(view_count) AS views,
        round(CASE WHEN sum(view_count) > 0 THEN sum(engagement) / sum(view_count) END, 6) AS engagement_rate
    FROM ({POSTS}) GROUP BY 1"""
TIER = """CASE WHEN follower_count >= 1000000 THEN 'mega' WHEN follower_count >= 500000 THEN 'macro'
    WHEN follower_count >= 50000 THEN 'mid' WHEN follower_count >= 10000 THEN 'micro' ELSE 'nano' END"""
FREQUENCY = "SELECT CAST(user_id AS VARCHAR) AS influencer_tiktok_id, event_type AS hashtag, count(*) AS frequency FROM events GROUP BY 1, 2"
COMMENTS = """
    SELECT CAST(l_orderkey % 1000 AS VARCHAR) AS influencer_tiktok_id, l_orderkey || '-' || l_linenumber AS comment_id,
        l_returnflag || l_linestatus || l_linenumber AS comment_text FROM lineitem"""


@query(f"""
    SELECT post_id, influencer_tiktok_id, round(CASE WHEN view_count > 0 THEN engagement / view_count END, 6) AS engagement_rate
    FROM ({POSTS})""")
def engagement_rate(spark, sf_dir):
    return metrics.post_engagement(inputs.clean_posts(spark, sf_dir))


@query(f"SELECT influencer_tiktok_id, post_count, engagement_rate FROM ({CREATORS})")
def creator_engagement(spark, sf_dir):
    return metrics.creator_engagement(inputs.clean_posts(spark, sf_dir))


@query(f"""
    SELECT influencer_tiktok_id, round(CASE WHEN following_count > 0 THEN follower_count / following_count END, 6) AS follow_ratio
    FROM ({INFLUENCERS})""")
def follow_ratio(spark, sf_dir):
    return metrics.follow_ratio(inputs.clean_influencers(spark, sf_dir))


@query(f"SELECT influencer_tiktok_id, bio_kind = 0 AS has_email, bio_kind = 1 AS has_link FROM ({INFLUENCERS})")
def contact_info(spark, sf_dir):
    return metrics.contact_info(inputs.clean_influencers(spark, sf_dir))


@query(f"""
    SELECT influencer_tiktok_id, round(max(frequency) / sum(frequency), 6) AS top_tag_share, count(*) AS tag_count
    FROM ({FREQUENCY}) GROUP BY 1""")
def hashtag_consistency(spark, sf_dir):
    return metrics.hashtag_consistency(inputs.tag_frequency(spark, sf_dir))


@query(f"""
    SELECT influencer_tiktok_id, tier, engagement_rate,
        CASE WHEN engagement_rate IS NOT NULL THEN
            round(percent_rank() OVER (PARTITION BY tier, engagement_rate IS NULL ORDER BY engagement_rate), 6) END AS tier_percentile
    FROM (SELECT influencer_tiktok_id, {TIER} AS tier, engagement_rate FROM ({INFLUENCERS}) LEFT JOIN ({CREATORS}) USING (influencer_tiktok_id))""")
def tier_percentile(spark, sf_dir):
    return metrics.tier_percentile(inputs.clean_influencers(spark, sf_dir), inputs.clean_posts(spark, sf_dir))


@query(f"""
    SELECT influencer_tiktok_id, category, hits FROM (
        SELECT *, row_number() OVER (PARTITION BY influencer_tiktok_id ORDER BY hits DESC, category) AS rn FROM (
            SELECT influencer_tiktok_id, CASE WHEN hashtag IN ('click', 'view') THEN 'browsing' ELSE 'buying' END AS category,
                CAST(sum(frequency) AS BIGINT) AS hits FROM ({FREQUENCY}) GROUP BY 1, 2)) WHERE rn = 1""")
def content_category(spark, sf_dir):
    return metrics.content_category(inputs.tag_frequency(spark, sf_dir), inputs.category_dictionary(spark, sf_dir))


@query(f"""
    WITH c AS ({COMMENTS}),
        t AS (SELECT influencer_tiktok_id, count(*) AS comments, count(DISTINCT comment_text) AS texts FROM c GROUP BY 1),
        r AS (SELECT l_orderkey || '-' || l_linenumber AS comment_id, l_returnflag = 'A' AS mine FROM lineitem WHERE l_tax > 0.02),
        a AS (SELECT influencer_tiktok_id, count(*) AS replies, count(*) FILTER (mine) AS own
            FROM (SELECT comment_id, max(influencer_tiktok_id) AS influencer_tiktok_id FROM c GROUP BY 1) JOIN r USING (comment_id) GROUP BY 1)
    SELECT influencer_tiktok_id, round(CASE WHEN views > 0 THEN coalesce(comments, 0) / views END, 6) AS comments_per_view,
        round(texts / comments, 6) AS distinct_text_share, round(own / replies, 6) AS creator_reply_share
    FROM ({CREATORS}) FULL JOIN t USING (influencer_tiktok_id) LEFT JOIN a USING (influencer_tiktok_id)""")
def audience_quality(spark, sf_dir):
    return metrics.audience_quality(
        inputs.clean_posts(spark, sf_dir), inputs.clean_comments(spark, sf_dir), inputs.clean_replies(spark, sf_dir))


WEIGHTS = {"engagement_rate": 0.5, "follow_ratio": 0.3, "top_tag_share": 0.2}
_RANKS = ", ".join(
    f"CASE WHEN {m} IS NULL THEN 0 ELSE percent_rank() OVER (PARTITION BY {m} IS NULL ORDER BY {m}) END AS {m}_rank"
    for m in WEIGHTS)


@query(f"""
    WITH m AS (SELECT i.influencer_tiktok_id, engagement_rate, top_tag_share,
            round(CASE WHEN following_count > 0 THEN follower_count / following_count END, 6) AS follow_ratio
        FROM ({INFLUENCERS}) i LEFT JOIN ({CREATORS}) USING (influencer_tiktok_id)
        LEFT JOIN (SELECT influencer_tiktok_id, round(max(frequency) / sum(frequency), 6) AS top_tag_share
            FROM ({FREQUENCY}) GROUP BY 1) USING (influencer_tiktok_id))
    SELECT influencer_tiktok_id, round(0.5 * engagement_rate_rank + 0.3 * follow_ratio_rank + 0.2 * top_tag_share_rank, 6) AS score
    FROM (SELECT influencer_tiktok_id, {_RANKS} FROM m)""")
def qualification_score(spark, sf_dir):
    key = "influencer_tiktok_id"
    table = (
        metrics.follow_ratio(inputs.clean_influencers(spark, sf_dir))
        .join(metrics.creator_engagement(inputs.clean_posts(spark, sf_dir)), key, "left")
        .join(metrics.hashtag_consistency(inputs.tag_frequency(spark, sf_dir)), key, "left")
    )
    return metrics.qualification_score(table, WEIGHTS)
