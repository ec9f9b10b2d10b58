"""Summaries. Each is a DataFrame; percentages and averages are 0 where nothing was attempted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from creatorlake.functions.tags import with_hash
from creatorlake.functions.times import timestamp_literal


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row aggregates next to each other: a product of single rows."""
    return reduce(lambda a, b: a.crossJoin(b), rows)


def search_summary(unique_authors: DataFrame, responses: DataFrame) -> DataFrame:
    """Averages and maxima are NULL when no author was found."""
    return _side_by_side(
        unique_authors.agg(
            F.count(F.lit(1)).alias("total_unique_profiles"),
            F.avg("follower_count").alias("avg_followers"),
            F.max("follower_count").alias("max_followers"),
            F.avg("heart_count").alias("avg_hearts"),
            F.max("heart_count").alias("max_hearts"),
        ),
        responses.agg(F.count(F.lit(1)).alias("total_api_responses")),
    )


def profiles_per_hashtag(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("hashtag").agg(F.count(F.lit(1)).alias("profile_count"))


def hashtag_distribution(edges: DataFrame) -> DataFrame:
    """Profiles per tag, each pair counted once."""
    return edges.dropDuplicates(["hashtag", "user_id"]).groupBy("hashtag").agg(F.count(F.lit(1)).alias("profile_count"))


def _tagged(df: DataFrame) -> DataFrame:
    return df.selectExpr(f"{with_hash('hashtag')} AS tag", "hashtag")


def _typed_tags(requested: DataFrame) -> DataFrame:
    """One row per tag in ``#tag`` form with the way it was typed: with or without ``#``, both are one tag."""
    return _tagged(requested).groupBy("tag").agg(F.min("hashtag").alias("hashtag"))


def hashtag_metadata(requested: DataFrame, ranked: DataFrame, search_ts) -> DataFrame:
    """Search time and number of profiles of every requested tag, zero included."""
    found = _tagged(ranked).groupBy("tag").agg(F.count(F.lit(1)).alias("profile_count"))
    return _typed_tags(requested).join(found, "tag", "left").selectExpr(
        "hashtag", f"{timestamp_literal(search_ts)} AS search_timestamp", "coalesce(profile_count, 0L) AS profiles_found"
    )


def _attempts(attempted: DataFrame, key: str, results: DataFrame, result_count: str) -> DataFrame:
    """Counts per attempted key: results are reduced to one row per key before the join."""
    per_key = results.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = attempted.select(key).distinct().join(per_key, key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count("n").alias("ok"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias(result_count),
    ).withColumn("failed", F.col("attempted") - F.col("ok"))


RATE = "coalesce(try_divide(ok, attempted) * 100, 0D)"


def load_summary(profiles: DataFrame, posts: DataFrame) -> DataFrame:
    return _attempts(profiles, "user_id", posts, "posts").selectExpr(
        "attempted AS total_profiles_attempted", "ok AS successful_loads", "failed AS failed_loads",
        f"{RATE} AS success_rate", "posts AS total_posts_collected",
        "coalesce(try_divide(posts, ok), 0D) AS average_posts_per_profile",
    )


def comments_summary(posts: DataFrame, comments: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    summary = _attempts(posts, "post_id", comments, "comments").selectExpr(
        "attempted AS total_posts_attempted", "ok AS successful_posts", "failed AS failed_posts",
        f"{RATE} AS success_rate", "comments AS total_comments_collected",
        "coalesce(try_divide(comments, ok), 0D) AS average_comments_per_post",
    )
    if errors is None:
        return summary.withColumn("error_count", F.lit(0).cast("bigint"))
    return _side_by_side(summary, errors.agg(F.count(F.lit(1)).alias("error_count")))


def comments_per_owner(comments: DataFrame) -> DataFrame:
    return comments.groupBy("user_id").agg(F.count(F.lit(1)).alias("comment_count"))


def relationship_summary(
    hashtags: DataFrame, profiles: DataFrame, posts: DataFrame, comments: DataFrame,
    profile_posts: DataFrame, post_comments: DataFrame, failed: DataFrame, errors: DataFrame | None = None,
) -> DataFrame:
    """Entity counts, coverage and failures in one row. ``failed`` is the table of ``failed_items``."""

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    def failures(kind: str):
        return F.count(F.when(F.col("kind") == kind, 1)).alias(f"failed_{kind}")

    parts = [
        rows(hashtags, "hashtags_count"), rows(profiles, "profiles_count"),
        rows(posts, "posts_count"), rows(comments, "comments_count"),
        profile_posts.agg(F.countDistinct("user_id").alias("profiles_with_posts")),
        post_comments.agg(F.countDistinct("post_id").alias("posts_with_comments")),
        failed.agg(*[failures(k) for k in ["hashtags", "profiles", "posts"]]),
    ]
    if errors is not None:
        parts.append(rows(errors, "total_errors"))
    df = _side_by_side(*parts).selectExpr(
        "*",
        "coalesce(try_divide(posts_count, profiles_count), 0D) AS avg_posts_per_profile",
        "coalesce(try_divide(comments_count, posts_count), 0D) AS avg_comments_per_post",
    )
    return df if errors is not None else df.withColumn("total_errors", F.lit(0).cast("bigint"))


def capture_summary(responses: DataFrame) -> DataFrame:
    return responses.selectExpr(
        "body IS NOT NULL AND NOT is_variant_null(body) AS captured", "coalesce(is_large_response, false) AS large"
    ).selectExpr(
        "count(1) AS total_requests", "count_if(captured) AS successful_responses",
        "count_if(NOT captured) AS failed_responses", "count_if(large) AS large_responses",
        "coalesce(try_divide(count_if(captured), count(1)) * 100, 0D) AS success_rate",
    )


def cleaning_summary(tables: dict[str, DataFrame], tag_counts: DataFrame) -> DataFrame:
    """Rows per clean table, and (influencer, tag) pairs before odd tags are dropped."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("item"), "row_count")
             for name, df in [*tables.items(), ("hashtag_influencer_pairs", tag_counts)]]
    return reduce(DataFrame.unionByName, parts)


def failed_items(hashtags: DataFrame, ranked: DataFrame, profiles: DataFrame, profile_posts: DataFrame,
                 posts: DataFrame, post_comments: DataFrame) -> DataFrame:
    """Hashtags without profiles, profiles without posts, posts without comments. Hashtags are compared in ``#tag`` form."""

    def missing(items: DataFrame, key: str, found: DataFrame, kind: str) -> DataFrame:
        return items.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").select(
            F.lit(kind).alias("kind"), F.col(key).alias("item_id"))

    unfound = _typed_tags(hashtags).join(_tagged(ranked).select("tag").distinct(), "tag", "left_anti")
    return (
        unfound.select(F.lit("hashtags").alias("kind"), F.col("hashtag").alias("item_id"))
        .unionByName(missing(profiles, "user_id", profile_posts, "profiles"))
        .unionByName(missing(posts, "post_id", post_comments, "posts"))
    )


EXPORTED = {"profiles": "profiles_count", "posts": "posts_count", "comments": "comments_count",
            "profile_hashtag_relations": "relations_count"}


def _described(counts: DataFrame, run_ts, files_created: int) -> DataFrame:
    ts = timestamp_literal(run_ts)
    return counts.selectExpr(
        f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss') AS export_timestamp",
        f"date_format({ts}, 'yyyy-MM-dd') AS export_date", f"date_format({ts}, 'HH:mm:ss') AS export_time",
        f"date_format({ts}, 'yyyyMMdd_HHmmss') AS file_version",
        f"CAST({files_created} AS BIGINT) AS total_files_created", *EXPORTED.values(),
    )


def export_metadata(tables: dict[str, DataFrame], run_ts, files_created: int) -> DataFrame:
    """One row; ``files_created`` does not count the metadata itself."""
    counts = [tables[k].agg(F.count(F.lit(1)).alias(c)) for k, c in EXPORTED.items()]
    return _described(_side_by_side(*counts), run_ts, files_created)


def metadata_row(spark: SparkSession, counts: dict[str, int], run_ts, files_created: int) -> DataFrame:
    """The same row from counts already known, such as those of a finished write."""
    row = spark.range(1).select(*[F.lit(counts.get(k, 0)).cast("bigint").alias(c) for k, c in EXPORTED.items()])
    return _described(row, run_ts, files_created)


def summary_long(summary: DataFrame) -> DataFrame:
    """One-row summary to (category, metric, value): struct columns open one level under their own
    name, scalars go to ``general``, anything deeper stays as JSON text."""

    def as_text(path: str, dtype: T.DataType) -> str:
        if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            return f"to_json({path})"
        return f"CAST({path} AS STRING)"

    cells = []
    for f in summary.schema:
        if isinstance(f.dataType, T.StructType):
            cells += [(f.name, g.name, as_text(f"{f.name}.{g.name}", g.dataType)) for g in f.dataType]
        else:
            cells.append(("general", f.name, as_text(f.name, f.dataType)))
    items = ", ".join(f"'{c}', '{m}', {v}" for c, m, v in cells)
    return summary.selectExpr(f"stack({len(cells)}, {items}) AS (category, metric, value)")
