"""Captured responses to related entities, flat tables and summaries.

One lazy plan, but for a count of responses per post and profile. ``staged=True`` writes the decoded, deduplicated and trimmed entities once to the
staging folder, since several outputs read each of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from creatorlake import constants as k
from creatorlake.operators import extract, relations, summaries, topn
from creatorlake.session import stage
from creatorlake.sources import bronze
from creatorlake.sources.responses import decoded, routed


@dataclass(frozen=True)
class Collected:
    authors: DataFrame
    ranked: DataFrame
    profiles: DataFrame
    posts: DataFrame
    comments: DataFrame
    hashtag_profile: DataFrame
    profile_post: DataFrame
    post_owner: DataFrame
    post_comment: DataFrame
    comment_owner: DataFrame

    def flat(self, search_ts: str | None = None) -> dict[str, DataFrame]:
        """The tables of the interchange document."""
        return {
            "profiles": relations.flat_profiles(self.profiles, self.profile_post, self.hashtag_profile, search_ts),
            "posts": relations.flat_posts(self.posts, self.post_owner),
            "comments": relations.flat_comments(self.comments, self.post_owner, self.profiles),
            "profile_hashtag_relations": relations.relation_rows(self.hashtag_profile),
        }

    def complete(self, requested: DataFrame, errors: DataFrame | None = None) -> dict[str, DataFrame]:
        """Entities, relations, failures and, if given, the error log as one set of tables."""
        return ({} if errors is None else {"errors": errors}) | {
            "profiles": self.profiles, "posts": self.posts, "comments": self.comments,
            "hashtag_profile": self.hashtag_profile, "profile_post": self.profile_post,
            "post_owner": self.post_owner, "post_comment": self.post_comment,
            "comment_owner": self.comment_owner, "failed_items": self.failed(requested),
        }

    def failed(self, requested: DataFrame) -> DataFrame:
        return summaries.failed_items(
            requested, self.ranked, self.profiles, self.profile_post, self.posts, self.post_comment
        )

    def summary(self, requested: DataFrame, errors: DataFrame | None = None) -> DataFrame:
        return summaries.relationship_summary(
            requested, self.profiles, self.posts, self.comments, self.profile_post, self.post_comment,
            self.failed(requested), errors,
        )


def relate(ranked: DataFrame, posts: DataFrame, comments: DataFrame, authors: DataFrame | None = None) -> Collected:
    """Relate ranked profiles, trimmed posts and trimmed comments (any of them may be supplied)."""
    merged_posts = relations.merge_posts(posts)
    merged_comments = relations.merge_comments(comments)
    post_owner = merged_posts.select("post_id", "user_id")
    return Collected(
        authors=ranked if authors is None else authors,
        ranked=ranked,
        profiles=relations.merge_profiles(ranked),
        posts=merged_posts,
        comments=merged_comments,
        hashtag_profile=relations.hashtag_profile_edges(ranked),
        profile_post=relations.profile_post_edges(posts),
        post_owner=post_owner,
        post_comment=relations.post_comment_edges(comments),
        comment_owner=relations.comment_owner(merged_comments, post_owner),
    )


def _stages(search: DataFrame, post_lists: DataFrame, comment_lists: DataFrame, profiles_per_hashtag: int,
            posts_per_profile: int, comments_per_post: int, staged: bool) -> Collected:
    """Decoded responses of the three endpoints to related entities, cut to their limits."""
    authors = extract.extract_authors(search)
    if staged:
        authors = stage(authors, "authors")
    ranked = topn.top_profiles_per_hashtag(authors, profiles_per_hashtag)
    # Counted by responses, which needs one column of them and no body.
    hot_profile, hot_post = topn.holds_hot_key(post_lists, "ctx_user_id"), topn.holds_hot_key(comment_lists, "ctx_post_id")
    posts = topn.first_posts_per_profile(extract.extract_posts(post_lists), posts_per_profile, hot_profile)
    comments = topn.first_comments_per_post(extract.extract_comments(comment_lists), comments_per_post, hot_post)
    if staged:
        ranked, posts, comments = stage(ranked, "ranked"), stage(posts, "posts"), stage(comments, "comments")
    return relate(ranked, posts, comments, authors)


def collect(
    responses: DataFrame,
    profiles_per_hashtag: int = k.PROFILES_PER_HASHTAG,
    posts_per_profile: int = k.POSTS_PER_PROFILE,
    comments_per_post: int = k.COMMENTS_PER_POST,
    staged: bool = True,
) -> Collected:
    """Full collection plan over one table of undecoded responses of all endpoints."""
    parts = [decoded(routed(responses, e)) for e in (k.SEARCH_ENDPOINT, k.POST_LIST_ENDPOINT, k.COMMENT_LIST_ENDPOINT)]
    return _stages(*parts, profiles_per_hashtag, posts_per_profile, comments_per_post, staged)


def collect_bronze(
    spark: SparkSession,
    root: str,
    run_id: str,
    profiles_per_hashtag: int = k.PROFILES_PER_HASHTAG,
    posts_per_profile: int = k.POSTS_PER_PROFILE,
    comments_per_post: int = k.COMMENTS_PER_POST,
    staged: bool = True,
) -> Collected:
    """The same over one run of a bronze table: each stage reads the partition of its endpoint, decoded when it landed."""
    parts = [bronze.read(spark, root, endpoint, [run_id]) for endpoint in ("search", "posts", "comments")]
    return _stages(*parts, profiles_per_hashtag, posts_per_profile, comments_per_post, staged)
