"""Interchange records to the six clean tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from creatorlake.operators import cleaning as c
from creatorlake.operators.quality import quarantine
from creatorlake.operators.standard import standard_records, without_repeats
from creatorlake.operators.summaries import cleaning_summary
from creatorlake.session import stage


@dataclass(frozen=True)
class CleanTables:
    """The clean tables and the quarantine of one run. An entity is parsed and checked when first asked for; with
    ``staged`` it is then written to the staging folder, and every output reads from there. With ``standard`` texts are
    put in standard encoding ahead of the checks, and of valid profiles with one id the last one stays."""

    profiles: DataFrame
    post_records: DataFrame
    comment_records: DataFrame
    run_ts: str
    on_bad_hashtag: str = "cut"
    staged: bool = True
    standard: bool = False

    def _once(self, checked: DataFrame, name: str) -> DataFrame:
        return stage(checked, name) if self.staged else checked

    def _records(self, records: DataFrame) -> DataFrame:
        return standard_records(records) if self.standard else records

    @cached_property
    def checked_profiles(self) -> DataFrame:
        checked = self._once(c.check_profiles(self._records(self.profiles), self.run_ts), "profiles")
        return self._once(without_repeats(checked, "tiktok_id"), "unique-profiles") if self.standard else checked

    @cached_property
    def checked_posts(self) -> DataFrame:
        return self._once(c.check_posts(self._records(self.post_records), self.run_ts, self.on_bad_hashtag), "posts")

    @cached_property
    def checked_comments(self) -> DataFrame:
        return self._once(c.check_comments(self._records(self.comment_records), self.run_ts), "comments")

    @cached_property
    def checked_replies(self) -> DataFrame:
        return c.check_replies(self.checked_comments)

    @property
    def influencers(self) -> DataFrame:
        return c.influencers(self.checked_profiles)

    @property
    def posts(self) -> DataFrame:
        return c.posts(self.checked_posts)

    @property
    def comments(self) -> DataFrame:
        return c.comments(self.checked_comments)

    @property
    def reply_comments(self) -> DataFrame:
        return c.reply_comments(self.checked_replies)

    @property
    def post_hashtags(self) -> DataFrame:
        return c.post_hashtags(self.checked_posts)

    @cached_property
    def tag_counts(self) -> DataFrame:
        return c.tag_counts(c.profile_tags(self.checked_profiles), c.post_tags(self.checked_posts))

    @property
    def hashtag_frequency(self) -> DataFrame:
        return c.hashtag_frequency(self.tag_counts)

    @property
    def quarantine(self) -> DataFrame:
        parts = []
        for df, entity, record_id in [
            (self.checked_profiles, "profile", "tiktok_id"),
            (self.checked_posts, "post", "post_id"),
            (self.checked_comments, "comment", "comment_id"),
            (self.checked_replies, "reply", "reply_comment_id"),
        ]:
            # Positions differ in type: a number, or a struct of several.
            nested = dict(df.dtypes)["record_pos"].startswith("struct")
            pos = F.to_json("record_pos") if nested else F.col("record_pos").cast("string")
            parts.append(quarantine(df, entity, record_id).withColumn("record_pos", pos))
        return reduce(DataFrame.unionByName, parts)

    def outputs(self) -> dict[str, DataFrame]:
        names = ["influencers", "posts", "comments", "reply_comments", "post_hashtags", "hashtag_frequency"]
        return {name: getattr(self, name) for name in names}

    def summary(self) -> DataFrame:
        """Rows of all six tables, and (influencer, tag) pairs before odd tags are dropped. The pairs are counted once
        and written: both the pairs and the table of frequencies read them."""
        counts = stage(self.tag_counts, "tag-counts") if self.staged else self.tag_counts
        return cleaning_summary({**self.outputs(), "hashtag_frequency": c.hashtag_frequency(counts)}, counts)


def clean(
    profiles: DataFrame,
    posts: DataFrame,
    comments: DataFrame,
    run_ts,
    on_bad_hashtag: str = "cut",
    staged: bool = True,
    standard: bool = False,
) -> CleanTables:
    return CleanTables(profiles, posts, comments, run_ts, on_bad_hashtag, staged, standard)
