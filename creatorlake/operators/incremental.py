"""Hashtag use across runs: signed changes per run, summed when read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from creatorlake.operators import cleaning
from creatorlake.session import stage
from creatorlake.sinks.entities import EntityTable
from creatorlake.sinks.files import exists

CHANGE = "influencer_tiktok_id STRING, hashtag STRING, change BIGINT, part INT, run_id STRING"


def signed_changes(before: DataFrame, after: DataFrame, uses: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What to add to the count of each (influencer, tag) when the entities ``before`` become those ``after``."""
    rows = uses(before).withColumn("change", F.lit(-1)).unionByName(uses(after).withColumn("change", F.lit(1)))
    summed = rows.groupBy("influencer_tiktok_id", "hashtag").agg(F.sum("change").alias("change"))
    return summed.where("change <> 0")


@dataclass(frozen=True)
class TagCounts:
    """``root/changes/run_id=...`` beside the saved posts and profiles whose tags are counted.

    An entity captured again takes back the tags of its earlier capture, and one whose last capture breaks a rule has
    none. ``update`` plans the merge of a run, writes and commits the changes that follow from it, and only then merges: a
    run cut short anywhere is repeated, and finds its changes either committed or its entities still as before."""

    root: str
    posts: EntityTable
    profiles: EntityTable

    def update(self, posts: DataFrame, profiles: DataFrame, run_id: str) -> None:
        """Take in the checked posts and profiles of one run."""
        parts = [(self.posts, posts, cleaning.post_tags), (self.profiles, profiles, cleaning.profile_tags)]
        for k, (table, rows, uses) in enumerate(parts):
            if table.committed(run_id):
                continue
            # Counting needs no more of an entity than this.
            needed = dict.fromkeys([*table.keys, *table.position, "influencer_tiktok_id", "hashtags", "violations"])
            rows = stage(rows.select(*[c for c in needed if c in rows.columns]), "captured")
            done = None
            if not table.committed(f"{run_id}: changes"):
                done = table.planned(rows, run_id)
                path = f"{self.root}/changes/part={k}/run_id={run_id}"
                signed_changes(done.before, done.after, uses).write.mode("overwrite").parquet(path)
                table.commit(f"{run_id}: changes")
            table.apply(done or table.planned(rows, run_id))
            table.commit(run_id)

    def changes(self) -> DataFrame:
        spark, path = self.posts.spark, f"{self.root}/changes"
        return spark.read.schema(CHANGE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CHANGE)

    def counts(self) -> DataFrame:
        """Uses of each tag per influencer after all runs, before odd tags are dropped."""
        summed = self.changes().groupBy("influencer_tiktok_id", "hashtag").agg(F.sum("change").alias("frequency"))
        return summed.where("frequency > 0")

    def frequency(self) -> DataFrame:
        return cleaning.hashtag_frequency(self.counts())
