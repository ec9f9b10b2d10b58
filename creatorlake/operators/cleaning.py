"""Flattening and validating interchange records.

Input is ``(record_pos, record VARIANT)``. Each ``check_*`` function is one narrow projection: the
payload is parsed once, all typed columns and the broken rules come out, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creatorlake.constants import (
    COMMENT_COLUMNS, DEFAULT_DURATION, HASHTAG_FREQUENCY_COLUMNS, INFLUENCER_COLUMNS, POST_COLUMNS,
    POST_HASHTAG_COLUMNS, REPLY_COLUMNS,
)
from creatorlake.functions.coerce import counter, lax_bool, lax_int
from creatorlake.functions.sql import named
from creatorlake.functions.tags import before_first_false, is_valid_tag, without_hash
from creatorlake.functions.times import epoch_to_timestamp, timestamp_literal
from creatorlake.functions.urls import normalize_url
from creatorlake.functions.variants import (
    as_array, default, fields, get_or_default, is_empty, is_nothing, is_object, kind, safe_get, scalar, text,
    unless_nothing,
)
from creatorlake.operators.quality import at_least, length_between, present, valid, with_violations

EMPTY_TEXT = '""'


def _text(v: str) -> str:
    """Text that is empty when missing."""
    return text(default(v, EMPTY_TEXT))


def _with_payload(df: DataFrame, keys: list[str], payload: str, payload_keys: list[str]) -> DataFrame:
    """``r`` holds the fields of the record, ``p`` those of its payload; NULL if not an object."""
    return df.selectExpr("record_pos", "record", f"{fields('record', [*keys, payload])} AS r").selectExpr(
        "record_pos", "record", "r", f"{fields(default(f'r.{payload}', '{}'), payload_keys)} AS p"
    )


PAYLOAD_OK = "r IS NOT NULL AND p IS NOT NULL"


# --- profiles ---------------------------------------------------------------------------------

# Setting columns and the payload keys they come from.
SETTINGS = {
    "comment_setting": "commentSetting",
    "duet_setting": "duetSetting",
    "stitch_setting": "stitchSetting",
    "download_setting": "downloadSetting",
}


def check_profiles(records: DataFrame, run_ts) -> DataFrame:
    """Influencer rows with their found-under ``hashtags`` and ``violations``."""
    raw = {
        "bio_raw": default("p.signature", EMPTY_TEXT),
        "hashtags_raw": default("r.found_under_hashtags", "[]"),
        "follower_raw": default("r.follower_count", "0"),
        "following_raw": default("r.following_count", "0"),
        "heart_raw": default("r.heart_count", "0"),
        "video_raw": default("r.video_count", "0"),
        **{f"{name}_raw": f"p.{key}" for name, key in SETTINGS.items()},
    }
    typed = {
        "payload_ok": PAYLOAD_OK,
        "tiktok_id": _text("r.user_id"),
        "username": _text("r.username"),
        "sec_uid": _text("p.secUid"),
        "display_name": _text("r.display_name"),
        "bio_text": text("bio_raw"),
        "is_verified": lax_bool(default("p.verified", "false")),
        "is_private": lax_bool(default("p.privateAccount", "false")),
        "profile_url": normalize_url("profile_address"),
        "avatar_thumb": normalize_url("thumb_address"),
        "avatar_medium": normalize_url("medium_address"),
        "avatar_large": normalize_url("large_address"),
        "follower_count": lax_int("follower_raw"),
        "following_count": lax_int("following_raw"),
        "total_likes": lax_int("heart_raw"),
        "video_count": lax_int("video_raw"),
        **{name: f"CAST({lax_int(f'{name}_raw')} AS INT)" for name in SETTINGS},
        "created_at": timestamp_literal(run_ts),
        "updated_at": timestamp_literal(run_ts),
        "hashtags": f"transform({as_array('hashtags_raw')}, t -> {text('t')})",
    }
    addresses = {
        "profile_address": text("r.profile_url"),
        "thumb_address": text("p.avatarThumb"),
        "medium_address": text("p.avatarMedium"),
        "large_address": text("p.avatarLarger"),
    }
    df = (
        _with_payload(
            records, ["user_id", "username", "display_name", "profile_url", "follower_count", "following_count",
                      "heart_count", "video_count", "found_under_hashtags"],
            "raw_author_data", ["secUid", "signature", "verified", "privateAccount", "avatarThumb", "avatarMedium",
                                "avatarLarger", *SETTINGS.values()])
        .selectExpr("*", *named(raw), *named(addresses))
        .selectExpr("*", *named(typed))
    )
    rules = {
        "raw_author_data: object": "payload_ok",
        "tiktok_id: text, 1 or longer": length_between("tiktok_id", 1),
        "username: text, 1 to 50": length_between("username", 1, 50),
        "sec_uid: text": present("sec_uid"),
        "display_name: text, 1 to 100": length_between("display_name", 1, 100),
        "bio_text: text or null": f"{is_nothing('bio_raw')} OR bio_text IS NOT NULL",
        "is_verified: boolean": present("is_verified"),
        "is_private: boolean": present("is_private"),
        "follower_count: integer, 0 or more": at_least("follower_count", 0),
        "following_count: integer, 0 or more": at_least("following_count", 0),
        "video_count: integer, 0 or more": at_least("video_count", 0),
        "total_likes: integer, 0 or more": at_least("total_likes", 0),
        **{
            f"{name}: null or 0 to 3": f"{is_nothing(f'{name}_raw')} OR {name} BETWEEN 0 AND 3"
            for name in SETTINGS
        },
        "hashtags: null or list of text": "is_variant_null(hashtags_raw)"
        " OR (hashtags IS NOT NULL AND NOT exists(hashtags, t -> t IS NULL))",
    }
    return with_violations(df, rules, "hashtags").select("record_pos", "record", *INFLUENCER_COLUMNS, "hashtags", "violations")


def influencers(checked: DataFrame) -> DataFrame:
    return valid(checked).select(*INFLUENCER_COLUMNS)


def profile_tags(checked: DataFrame) -> DataFrame:
    """One row per found-under tag of a valid profile, repeats and odd tags included."""
    tags = valid(checked).select(F.col("tiktok_id").alias("influencer_tiktok_id"), F.explode("hashtags").alias("tag"))
    return tags.selectExpr("influencer_tiktok_id", f"{without_hash('tag')} AS hashtag")


# --- posts ------------------------------------------------------------------------------------


# Stands for an unusable list entry; no valid tag holds this character.
UNUSABLE = "#"


def tag_entries(v: str) -> str:
    """A ``textExtra`` value (VARIANT) as text entries: the lower-case tag, NULL for an entry to pass over
    (no hashtag, or no name), ``UNUSABLE`` for one that breaks the rules. NULL if it is no list."""
    # One native read of all entries; an entry that is no object reads as NULL.
    items = scalar(v, "array<struct<type: variant, hashtagName: variant>>")
    # 1, 1.0 and true all equal 1; the text "1" does not. A name that is null or no text is unusable.
    named_entries = f"""transform({items}, x -> CASE
        WHEN x IS NULL THEN '{UNUSABLE}'
        WHEN {kind('x.type')} <> 'STRING' AND {scalar('x.type', 'double')} = 1
            THEN CASE WHEN x.hashtagName IS NULL THEN NULL
                WHEN {kind('x.hashtagName')} = 'STRING' THEN lower({scalar('x.hashtagName', 'string')})
                ELSE '{UNUSABLE}' END END)"""
    return f"""transform({named_entries}, t -> CASE WHEN t = '' THEN NULL
        WHEN t IS NULL OR {is_valid_tag('t')} THEN t ELSE '{UNUSABLE}' END)"""


def tag_list(entries: str, on_bad_hashtag: str = "cut") -> str:
    """Surviving tags. ``cut``: the first unusable entry ends the list. ``skip``: only it is left out."""
    if on_bad_hashtag == "cut":
        cut = f"CAST(array_position({entries}, '{UNUSABLE}') AS INT)"
        kept = f"array_compact(if({cut} > 0, slice({entries}, 1, {cut} - 1), {entries}))"
    else:
        kept = f"filter({entries}, t -> t <> '{UNUSABLE}')"
    return f"coalesce({kept}, CAST(array() AS ARRAY<STRING>))"


def check_posts(records: DataFrame, run_ts, on_bad_hashtag: str = "cut", with_hashtags: bool = True) -> DataFrame:
    """Post rows with ``violations`` and, unless only the posts are wanted, their surviving ``hashtags``."""
    counts = {
        "view_count": "playCount",
        "like_count": "diggCount",
        "comment_count": "commentCount",
        "share_count": "shareCount",
        "collect_count": "collectCount",
    }
    typed = {
        "payload_ok": PAYLOAD_OK,
        "post_id": _text("r.post_id"),
        "influencer_tiktok_id": _text("r.user_id"),
        "description": _text("p.desc"),
        "duration": lax_int("duration_raw"),
        **{name: counter(f"{name}_raw") for name in counts},
        "is_ad": lax_bool(default("p.isAd", "false")),
        "is_pinned": lax_bool(default("p.isPinnedItem", "false")),
        "posted_at": epoch_to_timestamp("posted_raw", run_ts),
        "created_at": timestamp_literal(run_ts),
        **({"hashtags": tag_list("entries", on_bad_hashtag)} if with_hashtags else {}),
    }
    df = (
        _with_payload(records, ["post_id", "user_id"], "raw_post_data", [
            "desc", "stats", "statsV2", "video", "isAd", "isPinnedItem", "createTime", "textExtra"])
        # The whole object falls back, never single fields.
        .selectExpr("*", f"{fields(f"if({is_empty('p.stats')}, p.statsV2, p.stats)", list(counts.values()))} AS s")
        .selectExpr(
            "*",
            f"{safe_get('p.video', 'duration', str(DEFAULT_DURATION))} AS duration_raw",
            f"{default('p.createTime', '0')} AS posted_raw",
            *([f"{tag_entries('p.textExtra')} AS entries"] if with_hashtags else []),
            *[f"{unless_nothing(f's.{key}', '0')} AS {name}_raw" for name, key in counts.items()],
        )
        .selectExpr("*", *named(typed))
    )
    rules = {
        "raw_post_data: object": "payload_ok",
        "post_id: text, 1 or longer": length_between("post_id", 1),
        "influencer_tiktok_id: text, 1 or longer": length_between("influencer_tiktok_id", 1),
        "description: text, up to 2000": length_between("description", 0, 2000),
        "duration: integer, 1 to 600": "duration BETWEEN 1 AND 600",
        **{f"{name}: integer, 0 or more": at_least(name, 0) for name in counts},
        "is_ad: boolean": present("is_ad"),
        "is_pinned: boolean": present("is_pinned"),
        "posted_at: time": present("posted_at"),
    }
    lists = ["hashtags"] if with_hashtags else []
    return with_violations(df, rules, *lists).select("record_pos", "record", *POST_COLUMNS, *lists, "violations")


def posts(checked: DataFrame) -> DataFrame:
    return valid(checked).select(*POST_COLUMNS)


def post_hashtags(checked: DataFrame) -> DataFrame:
    return valid(checked).select("post_id", F.explode("hashtags").alias("hashtag")).select(*POST_HASHTAG_COLUMNS)


def post_tags(checked: DataFrame) -> DataFrame:
    return valid(checked).select("influencer_tiktok_id", F.explode("hashtags").alias("hashtag"))


# --- comments and replies ---------------------------------------------------------------------


def check_comments(records: DataFrame, run_ts) -> DataFrame:
    """Comment rows with their ``reply_items`` and ``violations``."""
    typed = {
        "payload_ok": PAYLOAD_OK,
        "share_ok": "share IS NOT NULL",
        "comment_id": _text("r.comment_id"),
        "post_id": _text("r.post_id"),
        "influencer_tiktok_id": _text("r.user_id"),
        "create_time": epoch_to_timestamp("created_raw", run_ts),
        "comment_text": _text("p.text"),
        "digg_count": lax_int("digg_raw"),
        "reply_comment_total": lax_int("reply_total_raw"),
        "share_title": _text("share.title"),
        "share_desc": _text("share.desc"),
        # One object stands for a list of one.
        "reply_items": f"if({is_object('p.reply_comment')}, array(p.reply_comment), {as_array('p.reply_comment')})",
    }
    df = (
        _with_payload(records, ["comment_id", "post_id", "user_id"], "raw_comment_data", [
            "create_time", "text", "digg_count", "reply_comment_total", "share_info", "reply_comment"])
        .selectExpr(
            "*",
            f"{fields(default('p.share_info', '{}'), ['title', 'desc'])} AS share",
            f"{default('p.create_time', '0')} AS created_raw",
            f"{default('p.digg_count', '0')} AS digg_raw",
            f"{default('p.reply_comment_total', '0')} AS reply_total_raw",
        )
        .selectExpr("*", *named(typed))
    )
    texts = ["comment_id", "post_id", "influencer_tiktok_id", "comment_text", "share_title", "share_desc"]
    rules = {
        "raw_comment_data: object": "payload_ok",
        "share_info: object": "share_ok",
        **{f"{name}: text": present(name) for name in texts},
        "create_time: time": present("create_time"),
        "digg_count: integer, 0 or more": at_least("digg_count", 0),
        "reply_comment_total: integer": present("reply_comment_total"),
    }
    return with_violations(df, rules, "reply_items").select("record_pos", "record", *COMMENT_COLUMNS, "reply_items", "violations")


def comments(checked: DataFrame) -> DataFrame:
    return valid(checked).select(*COMMENT_COLUMNS)


def check_replies(checked_comments: DataFrame) -> DataFrame:
    """Reply rows of valid comments with ``violations``. A reply that is no object, or whose user is
    none, ends the list; a reply that only breaks a rule is rejected alone."""
    readable = f"transform(held, r -> {is_object('r')} AND {is_object(get_or_default('r', 'user', '{}'))})"
    typed = {
        "reply_comment_id": _text("r.cid"),
        "replier_id": text(get_or_default(default("r.user", "{}"), "uid", EMPTY_TEXT)),
        "reply_text": _text("r.text"),
        "digg_count": lax_int("digg_raw"),
        "label_text": text("label_raw"),
    }
    df = (
        valid(checked_comments)
        .select(
            F.col("comment_id").alias("main_comment_id"),
            F.col("record_pos").alias("comment_pos"),
            F.posexplode(F.expr(before_first_false("reply_items", readable))).alias("reply_pos", "record"),
        )
        .selectExpr(
            "main_comment_id",
            "struct(comment_pos, reply_pos) AS record_pos",
            "record",
            f"{fields('record', ['cid', 'user', 'text', 'digg_count', 'label_text'])} AS r",
        )
        .selectExpr("*", f"{default('r.digg_count', '0')} AS digg_raw", "r.label_text AS label_raw")
        .selectExpr("*", *named(typed))
    )
    rules = {
        "reply_comment_id: text": present("reply_comment_id"),
        "replier_id: text": present("replier_id"),
        "reply_text: text": present("reply_text"),
        "digg_count: integer, 0 or more": at_least("digg_count", 0),
        "label_text: text or null": f"{is_nothing('label_raw')} OR label_text IS NOT NULL",
    }
    return with_violations(df, rules).select("record_pos", "record", *REPLY_COLUMNS, "violations")


def reply_comments(checked: DataFrame) -> DataFrame:
    return valid(checked).select(*REPLY_COLUMNS)


# --- hashtag frequency ------------------------------------------------------------------------


def tag_counts(profile_side: DataFrame, post_side: DataFrame) -> DataFrame:
    """Uses of each tag per influencer, before odd tags are dropped. Counted map-side first, so a
    tag or influencer holding much of the data costs no more than any other."""
    return (
        profile_side.unionByName(post_side)
        .groupBy("influencer_tiktok_id", "hashtag")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def hashtag_frequency(counts: DataFrame) -> DataFrame:
    # Valid profiles and posts have an id: testing a grouping key again would reach the scans and parse every record there.
    return counts.where(f"{is_valid_tag('hashtag')} AND frequency >= 1").select(*HASHTAG_FREQUENCY_COLUMNS)
