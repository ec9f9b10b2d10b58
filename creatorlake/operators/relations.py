"""Relating entities. Relations are edge tables; the reverse direction is the same table.

No join carries a broadcast hint: Spark broadcasts a side only when its measured size is small,
and AQE splits skewed partitions of the others. One side of every join here has unique keys, so a
hot key can be split without multiplying rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creatorlake.constants import FLAT_COMMENT_COLUMNS, FLAT_POST_COLUMNS, FLAT_PROFILE_COLUMNS, RELATION_COLUMNS
from creatorlake.functions.tags import with_hash
from creatorlake.functions.urls import plain_profile_url
from creatorlake.operators.dedup import POSITION, distinct_edges, keep_last, keep_last_at_first_position
from creatorlake.session import stage

# --- edges --------------------------------------------------------------------------------------


def hashtag_profile_edges(ranked: DataFrame) -> DataFrame:
    return distinct_edges(ranked, "hashtag", "user_id")


def profile_post_edges(posts: DataFrame) -> DataFrame:
    return distinct_edges(posts, "user_id", "post_id")


def post_comment_edges(comments: DataFrame) -> DataFrame:
    """A comment captured under two posts keeps both edges."""
    return distinct_edges(comments, "post_id", "comment_id")


def merge_profiles(ranked: DataFrame) -> DataFrame:
    """Profiles across hashtags: the last capture wins and keeps the place of the first."""
    return keep_last_at_first_position(ranked.drop("rn", "score"), ["user_id"])


def merge_posts(posts: DataFrame) -> DataFrame:
    """Posts across profiles with their owner; the last capture wins both."""
    return keep_last(posts.drop("rn"), ["post_id"])


def merge_comments(comments: DataFrame) -> DataFrame:
    """Comments across posts; the last capture wins the comment and its post."""
    return keep_last(comments.drop("rn"), ["comment_id"])


def hashtags_by_profile(edges: DataFrame) -> DataFrame:
    """Sorted tags per profile. Edges are made unique first, so a list never outgrows the number of
    searched hashtags, however often a profile was found."""
    return (
        distinct_edges(edges, "user_id", "hashtag")
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list("hashtag")).alias("found_under_hashtags"))
    )


def comment_owner(comment_post: DataFrame, post_owner: DataFrame) -> DataFrame:
    """Comments with the owner of their post; comments of unowned posts drop out."""
    return comment_post.select("comment_id", "post_id").join(
        post_owner.where("user_id IS NOT NULL").select("post_id", "user_id"), "post_id"
    ).select("comment_id", "post_id", "user_id")


# --- starting from supplied tables -----------------------------------------------------------------


def supplied_profile_edges(profiles: DataFrame, mapping: DataFrame) -> DataFrame:
    """(user_id, hashtag) pairs of a mapping whose profile is among the supplied ones."""
    return distinct_edges(mapping, "user_id", "hashtag").join(profiles.select("user_id").distinct(), "user_id", "left_semi")


def supplied_post_owners(posts: DataFrame, profiles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Posts with their owner from a (post_id, user_id) mapping, owners limited to known profiles."""
    pairs = distinct_edges(mapping, "post_id", "user_id")
    known = pairs.join(profiles.select("user_id").distinct(), "user_id", "left_semi")
    return posts.select("post_id").distinct().join(known, "post_id").select("post_id", "user_id")


# --- flattening -----------------------------------------------------------------------------------


def flat_profiles(profiles: DataFrame, profile_posts: DataFrame, edges: DataFrame, search_ts: str | None = None) -> DataFrame:
    """Profiles for storage. Posts are counted before the join, one row per profile on both sides."""
    counts = profile_posts.groupBy("user_id").agg(F.count("post_id").alias("posts_count"))
    df = profiles.join(counts, "user_id", "left").join(hashtags_by_profile(edges), "user_id", "left")
    have = set(df.columns)
    defaults = {
        "load_timestamp": "search_timestamp" if "search_timestamp" in have else f"CAST({'NULL' if search_ts is None else repr(search_ts)} AS STRING)",
        "profile_url": plain_profile_url("username"),
    }
    filled = {
        "posts_count": "coalesce(posts_count, 0L) AS posts_count",
        "found_under_hashtags": "coalesce(found_under_hashtags, CAST(array() AS ARRAY<STRING>)) AS found_under_hashtags",
        **{
            name: f"coalesce({name}, {value}) AS {name}" if name in have else f"{value} AS {name}"
            for name, value in defaults.items()
        },
    }
    return df.selectExpr(*[filled.get(c, c) for c in FLAT_PROFILE_COLUMNS])


def flat_posts(posts: DataFrame, post_owner: DataFrame) -> DataFrame:
    owners = post_owner.select("post_id", "user_id")
    return posts.drop("user_id").join(owners, "post_id", "left").select(*FLAT_POST_COLUMNS)


def flat_comments(comments: DataFrame, post_owner: DataFrame, profiles: DataFrame) -> DataFrame:
    """Comments with the name of the post's owner, empty if unknown. Owner names are joined to the
    posts first: the comment table, the largest one, is joined once."""
    owners = post_owner.select("post_id", F.col("user_id").alias("owner_id"))
    names = profiles.select(
        F.col("user_id").alias("owner_id"),
        F.col("username").alias("profile_username"),
        F.col("display_name").alias("profile_display_name"),
    )
    post_names = owners.join(names, "owner_id", "left").drop("owner_id")
    filled = {c: f"coalesce({c}, '') AS {c}" for c in ["profile_username", "profile_display_name"]}
    return comments.join(post_names, "post_id", "left").selectExpr(*[filled.get(c, c) for c in FLAT_COMMENT_COLUMNS])


def relation_rows(edges: DataFrame) -> DataFrame:
    return distinct_edges(edges, "user_id", "hashtag").select(*RELATION_COLUMNS)


# --- what is still to do --------------------------------------------------------------------------


def hashtags_to_do(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Requested tags without a search; both sides in ``#tag`` form."""
    left = requested.selectExpr(f"{with_hash('hashtag')} AS hashtag").distinct()
    return left.join(done.selectExpr(f"{with_hash('hashtag')} AS hashtag").distinct(), "hashtag", "left_anti")


def profiles_to_do(profiles: DataFrame) -> DataFrame:
    """Profiles whose ``posts_count`` is missing or zero."""
    return profiles.where("coalesce(posts_count, 0) = 0")


def posts_to_do(posts: DataFrame, post_comments: DataFrame) -> DataFrame:
    return posts.join(post_comments.select("post_id").distinct(), "post_id", "left_anti")


def to_do_by_owner(posts: DataFrame, post_owner: DataFrame, profiles: DataFrame) -> DataFrame:
    """Open posts keyed by owner; posts without a known owner are left out. Stays a table of pairs:
    no list per owner is ever built."""
    owned = posts.select("post_id").join(post_owner.select("post_id", "user_id"), "post_id")
    return owned.join(profiles.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "post_id")


def resume_point(hashtags: DataFrame, profiles: DataFrame, posts: DataFrame) -> DataFrame:
    """The open items of the first phase that has any; one ``complete`` row if none has.

    The open lists are staged: they are read for the first phase and again for its items."""
    spark = hashtags.sparkSession
    stages = [
        (1, "search", hashtags.select(F.col("hashtag").alias("item_id"))),
        (2, "profiles", profiles.select(F.col("user_id").alias("item_id"))),
        (3, "comments", posts.select(F.col("post_id").alias("item_id"))),
    ]
    work = spark.sql("SELECT 4 AS phase_order, 'complete' AS phase, CAST(NULL AS STRING) AS item_id")
    for order, phase, df in stages:
        work = work.unionByName(df.select(F.lit(order).alias("phase_order"), F.lit(phase).alias("phase"), "item_id"))
    work = stage(work, "open")
    first = work.agg(F.min("phase_order").alias("phase_order"))
    return work.join(F.broadcast(first), "phase_order").select("phase", "item_id")  # one row, always
