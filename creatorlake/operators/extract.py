"""Decoded responses to authors, posts and comments. Narrow: one explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creatorlake.functions.bodies import reparse_text
from creatorlake.functions.coerce import lax_bool, truncating_int
from creatorlake.functions.sql import named
from creatorlake.functions.tags import before_first_false, with_hash
from creatorlake.functions.variants import default, fields, is_empty, is_object, kind, list_at, plain, scalar
from creatorlake.operators.quality import where_computed


def _items(responses: DataFrame, items: str, *keep: str) -> DataFrame:
    return responses.select("response_seq", *keep, F.posexplode(F.expr(items)).alias("item_pos", "result"))


def extract_authors(responses: DataFrame) -> DataFrame:
    """Authors of search responses with their hashtag and position.

    A result that is no object ends its response; an author without an id or with an unusable
    number is left out alone."""
    # Inside the generator, not as a column: Spark would test a column's size at the scan and parse each body for it.
    # An element that is no object, or an item that is none, is null.
    listed = "try_variant_get(body, '$.data', 'array<struct<item: struct<author: variant, authorStats: variant>>>')"
    results = before_first_false(listed, "transform(held, r -> r IS NOT NULL)")
    counts = {
        "follower_count": "followerCount",
        "following_count": "followingCount",
        "heart_count": "heartCount",
        "video_count": "videoCount",
    }
    df = (
        _items(responses, results, "ctx_hashtag")
        .selectExpr("* EXCEPT (result)", "result.item AS item")
        .selectExpr(
            "*",
            f"{fields('item.author', ['id', 'uniqueId', 'nickname', 'avatarMedium', 'verified'])} AS a",
            f"{fields(default('item.authorStats', '{}'), list(counts.values()))} AS s",
        )
        .selectExpr("*", *[f"{default(f's.{key}', '0')} AS {name}_raw" for name, key in counts.items()],
                    f"{default('a.verified', 'false')} AS verified_raw")
        # Kinds are columns: written out at each use, they made the projection too large to be compiled.
        .selectExpr("*", f"{kind('a.id')} AS id_kind", f"{kind('verified_raw')} AS verified_kind",
                    *[f"{kind(f'{name}_raw')} AS {name}_kind" for name in counts])
    )
    typed = {
        "hashtag": with_hash("ctx_hashtag"),
        "user_id": f"if({is_empty('a.id', 'id_kind')}, NULL, {scalar('a.id', 'string')})",
        "username": scalar(default("a.uniqueId", '""'), "string"),
        "display_name": scalar(default("a.nickname", '""'), "string"),
        "avatar_url": scalar(default("a.avatarMedium", '""'), "string"),
        "verified": lax_bool("verified_raw", "verified_kind"),
        **{name: f"if(s IS NULL, NULL, {truncating_int(f'{name}_raw', f'{name}_kind')})" for name in counts},
        "raw_author_data": "item.author",
    }
    df = df.selectExpr("response_seq", "item_pos", *named(typed))
    return where_computed(df, " AND ".join(f"{name} IS NOT NULL" for name in ["user_id", *counts]))


def extract_posts(responses: DataFrame) -> DataFrame:
    """Posts of post-list responses; the owner comes from the capture context."""
    return (
        _items(responses, list_at("body", "itemList"), "ctx_user_id")
        .where(is_object("result"))
        .selectExpr(
            "response_seq", "item_pos", "ctx_user_id AS user_id", f"{plain('result', 'id', 'string', "''")} AS post_id",
            "result AS raw_post_data",
        )
    )


def extract_comments(responses: DataFrame) -> DataFrame:
    """Comments of comment-list responses; post and post owner come from the capture context."""
    # Inside the generator too: as a column over a scan, each object would be read as text for the few bodies that are text.
    return (
        _items(responses, list_at(reparse_text("body"), "comments"), "ctx_post_id", "ctx_user_id")
        .where(is_object("result"))
        .selectExpr(
            "response_seq", "item_pos", f"{plain('result', 'cid', 'string', "''")} AS comment_id",
            f"{plain('result', 'create_time', 'bigint', '0L')} AS create_time",
            "ctx_post_id AS post_id", "ctx_user_id AS user_id", "result AS raw_comment_data",
        )
    )
