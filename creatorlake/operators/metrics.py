"""Engagement metrics on the clean tables.

The definitions are this project's own: only the names of the metrics are given elsewhere.
Every creator metric is reduced to one row per creator before any join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creatorlake.functions.sql import matches
from creatorlake.operators.ranking import percent_rank_in_groups
from creatorlake.session import stage

# Lower bounds of the follower tiers.
TIERS = [("nano", 0), ("micro", 10_000), ("mid", 50_000), ("macro", 500_000), ("mega", 1_000_000)]

# Shapes of contact details in a bio.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
LINK_PATTERN = r"(?i)(https?://|www\.)[^ ]+"

ENGAGEMENT = "like_count + comment_count + share_count"


def post_engagement(posts: DataFrame) -> DataFrame:
    """Likes, comments and shares per view; NULL without views."""
    return posts.selectExpr(
        "post_id", "influencer_tiktok_id", f"round(try_divide({ENGAGEMENT}, view_count), 6) AS engagement_rate"
    )


def creator_engagement(posts: DataFrame) -> DataFrame:
    """Ratio of sums per creator."""
    sums = posts.groupBy("influencer_tiktok_id").agg(
        F.count(F.lit(1)).alias("post_count"),
        F.expr(f"sum({ENGAGEMENT})").alias("engagements"),
        F.sum("view_count").alias("views"),
    )
    return sums.selectExpr(
        "influencer_tiktok_id", "post_count", "round(try_divide(engagements, views), 6) AS engagement_rate"
    )


def follow_ratio(influencers: DataFrame) -> DataFrame:
    """Followers per followed account; NULL if none is followed."""
    return influencers.selectExpr(
        "tiktok_id AS influencer_tiktok_id", "round(try_divide(follower_count, following_count), 6) AS follow_ratio"
    )


def contact_info(influencers: DataFrame) -> DataFrame:
    bio = "coalesce(bio_text, '')"
    return influencers.selectExpr(
        "tiktok_id AS influencer_tiktok_id",
        f"{matches(bio, EMAIL_PATTERN)} AS has_email", f"{matches(bio, LINK_PATTERN)} AS has_link",
    )


def hashtag_consistency(frequency: DataFrame) -> DataFrame:
    """Share of the most used tag."""
    return frequency.groupBy("influencer_tiktok_id").agg(
        F.expr("round(max(frequency) / sum(frequency), 6)").alias("top_tag_share"),
        F.count(F.lit(1)).alias("tag_count"),
    )


def follower_tier(column: str = "follower_count", tiers=TIERS) -> str:
    cases = " ".join(f"WHEN {column} >= {low} THEN '{name}'" for name, low in reversed(tiers))
    return f"CASE {cases} END"


def tier_percentile(influencers: DataFrame, posts: DataFrame, tiers=TIERS) -> DataFrame:
    """Engagement compared with creators of similar size; NULL for creators without posts or views."""
    rated = influencers.selectExpr("tiktok_id AS influencer_tiktok_id", f"{follower_tier(tiers=tiers)} AS tier").join(
        creator_engagement(posts), "influencer_tiktok_id", "left"
    )
    ranked = percent_rank_in_groups(rated, "tier", "engagement_rate", 6, "tier_percentile")
    return ranked.selectExpr(
        "influencer_tiktok_id", "tier", "engagement_rate", "round(tier_percentile, 6) AS tier_percentile"
    )


def content_category(frequency: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Category (from a hashtag, category dictionary) with the most tag uses; ties by name.

    No broadcast hint: Spark broadcasts the dictionary if its measured size allows."""
    hits = (
        frequency.join(dictionary.select("hashtag", "category").distinct(), "hashtag")
        .groupBy("influencer_tiktok_id", "category").agg(F.sum("frequency").alias("hits"))
    )
    best = F.min(F.struct((-F.col("hits")).alias("minus_hits"), F.col("category")))
    return hits.groupBy("influencer_tiktok_id").agg(best.alias("best")).selectExpr(
        "influencer_tiktok_id", "best.category AS category", "-best.minus_hits AS hits"
    )


def audience_quality(posts: DataFrame, comments: DataFrame, replies: DataFrame) -> DataFrame:
    """Comments per view, share of distinct comment texts, share of replies labelled as the creator's.

    One row per creator with posts or comments, measures without a base NULL. Equal texts of a
    creator merge map-side before the shuffle. A comment captured twice belongs to its last owner by name."""
    views = posts.groupBy("influencer_tiktok_id").agg(F.sum("view_count").alias("views"))
    per_text = comments.groupBy("influencer_tiktok_id", "comment_text").agg(F.count(F.lit(1)).alias("n"))
    texts = per_text.groupBy("influencer_tiktok_id").agg(
        F.sum("n").alias("comments"), F.count("comment_text").alias("distinct_texts")
    )
    per_comment = replies.groupBy(F.col("main_comment_id").alias("comment_id")).agg(
        F.count(F.lit(1)).alias("replies"), F.count_if(F.lower("label_text") == "creator").alias("creator_replies")
    )
    owners = comments.groupBy("comment_id").agg(F.max("influencer_tiktok_id").alias("influencer_tiktok_id"))
    answered = owners.join(per_comment, "comment_id").groupBy("influencer_tiktok_id").agg(
        F.sum("replies").alias("replies"), F.sum("creator_replies").alias("creator_replies")
    )
    return (
        views.join(texts, "influencer_tiktok_id", "full").join(answered, "influencer_tiktok_id", "left")
        .selectExpr(
            "influencer_tiktok_id",
            "round(try_divide(coalesce(comments, 0), views), 6) AS comments_per_view",
            "round(try_divide(distinct_texts, comments), 6) AS distinct_text_share",
            "round(try_divide(creator_replies, replies), 6) AS creator_reply_share",
        )
    )


def qualification_score(metrics: DataFrame, weights: dict[str, float], key: str = "influencer_tiktok_id") -> DataFrame:
    """Weighted sum of the percent ranks of metric columns; a missing metric counts as rank 0.

    Metrics become rows and are ranked once, the metric being the group: the plan is the same for any
    number of weights. The rows are staged first, since ranking reads them more than once."""
    cells = ", ".join(f"'{name}', CAST({name} AS DOUBLE)" for name in weights)
    values = stage(metrics.selectExpr(key, f"stack({len(weights)}, {cells}) AS (metric, value)"), "metrics")
    ranked = percent_rank_in_groups(values, "metric", "value", 6, "metric_rank")
    # Added in the order of the weights, so that rounding does not depend on the order of rows.
    terms = [f"{float(w)}D * coalesce(max(metric_rank) FILTER (WHERE metric = '{name}'), 0D)" for name, w in weights.items()]
    return ranked.groupBy(key).agg(F.expr(f"round({' + '.join(terms)}, 6)").alias("score"))
