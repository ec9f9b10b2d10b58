"""Starting a run from supplied profiles or posts instead of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creatorlake.operators import relations


def from_profiles(profiles: DataFrame, mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles still to load and their (user_id, hashtag) edges."""
    unique = profiles.dropDuplicates(["user_id"])
    if mapping is None:
        edges = unique.select("user_id", F.lit(None).cast("string").alias("hashtag")).where("false")
    else:
        edges = relations.supplied_profile_edges(unique, mapping)
    return unique, edges


def from_posts(posts: DataFrame, profiles: DataFrame | None = None, mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts still to load comments for and their (post_id, user_id) owners."""
    unique = posts.dropDuplicates(["post_id"])
    if profiles is None or mapping is None:
        owners = unique.select("post_id", F.lit(None).cast("string").alias("user_id")).where("false")
    else:
        owners = relations.supplied_post_owners(unique, profiles, mapping)
    return unique, owners
