"""First and best N rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from creatorlake.constants import (
    COMMENTS_PER_POST, POSTS_PER_PROFILE, PROFILES_PER_HASHTAG, SNAPSHOTS_KEPT,
)
from creatorlake.operators.dedup import POSITION, keep_first

# Spark trims groups before the shuffle only up to the N of this setting.
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 64
#: Rows of one key that a single task may hold and sort. Keys are counted in so many hashed groups first.
HOT_ROWS, HOT_GROUPS = 100_000, 65_536


def _limit(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= n)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows with rank ``rn`` up to ``n`` per key. ``order`` must be a total order.

    For large N, where Spark no longer trims before the shuffle, groups are first cut in salted
    parts: the top N of all parts together hold the top N of the group."""
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING)):
        spread = [c for c in df.columns if c not in keys and dict(df.dtypes)[c] != "variant"]
        salted = df.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
        df = _limit(salted, [*keys, "salt"], order, n).drop("rn", "salt")
    return _limit(df, keys, order, n)


def top_profiles_per_hashtag(authors: DataFrame, n: int = PROFILES_PER_HASHTAG) -> DataFrame:
    """First capture per user and tag, then the N with most followers plus hearts; ties by arrival."""
    unique = keep_first(authors, ["hashtag", "user_id"]).withColumn(
        "score", F.col("follower_count") + F.col("heart_count")
    )
    return top_n(unique, ["hashtag"], [F.desc("score"), *[F.asc(c) for c in POSITION]], n)


def holds_hot_key(rows: DataFrame, key: str) -> bool:
    """Whether some key (null is one) has more rows than a task should hold. No key has more rows than its hashed group, and
    groups merge map-side, so keys themselves are only counted where some group is large."""

    def most(group) -> int:
        return rows.groupBy(group.alias("group")).count().agg(F.max("count")).first()[0] or 0

    return most(F.pmod(F.xxhash64(key), F.lit(HOT_GROUPS))) > HOT_ROWS and most(F.col(key)) > HOT_ROWS


def _first_of(df: DataFrame, key: str, item: str, n: int, hot: bool) -> DataFrame:
    """The first N items per key, each by its first capture. Where a key may be hot, captures are made unique by key and item
    before any key comes together, which takes two shuffles; otherwise one by the key serves both steps."""
    unique = keep_first(df if hot else df.repartition(key), [key, item])
    return top_n(unique, [key], [F.asc(c) for c in POSITION], n)


def first_posts_per_profile(posts: DataFrame, n: int = POSTS_PER_PROFILE, hot: bool = True) -> DataFrame:
    return _first_of(posts, "user_id", "post_id", n, hot)


def first_comments_per_post(comments: DataFrame, n: int = COMMENTS_PER_POST, hot: bool = True) -> DataFrame:
    return _first_of(comments, "post_id", "comment_id", n, hot)


def newest_runs(runs: DataFrame, n: int = SNAPSHOTS_KEPT) -> DataFrame:
    """The N newest run ids: a distributed top-N, no global sort."""
    return runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(n)


def run_states(runs: DataFrame, n: int = SNAPSHOTS_KEPT) -> DataFrame:
    """Every run with ``kept`` or ``expired``."""
    newest = newest_runs(runs, n).withColumn("state", F.lit("kept"))
    return (
        runs.select("run_id").distinct().join(newest, "run_id", "left")
        .select("run_id", F.coalesce("state", F.lit("expired")).alias("state"))
    )
