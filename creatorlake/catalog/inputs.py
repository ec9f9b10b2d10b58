"""The supplied tables in the shapes the operators read. Whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creatorlake.constants import COMMENT_LIST_ENDPOINT, POST_LIST_ENDPOINT, SEARCH_ENDPOINT
from creatorlake.session import dealt

RUN_TS = "2025-01-01 00:00:00"


def _address(endpoint: str) -> str:
    """A plain address that the pattern matches."""
    return endpoint.replace("\\", "").removesuffix("[^ ]+") + "id="


SEARCH, POST_LIST, COMMENT_LIST = map(_address, (SEARCH_ENDPOINT, POST_LIST_ENDPOINT, COMMENT_LIST_ENDPOINT))
# Rows of lineitem have no key: their arrival order is the order of all their columns.
LINE_ORDER = (
    "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, "
    "l_orderkey, l_linenumber"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payloads(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(table(spark, sf_dir, name))


# --- captured responses ---------------------------------------------------------------------------


def _landed(df: DataFrame, seq: str, url: str, body: str, context: dict[str, str], is_base64: str = "false") -> DataFrame:
    ctx = [f"{context.get(c, 'CAST(NULL AS STRING)')} AS {c}" for c in ["ctx_hashtag", "ctx_user_id", "ctx_post_id"]]
    return df.selectExpr(
        f"{seq} AS response_seq", f"{url} AS url", f"CAST({body} AS VARIANT) AS body", f"{is_base64} AS is_base64", *ctx
    )


def search_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a search response: an author, an empty item, then (for errors a non-object and)
    a second author whose id and numbers come in odd forms. Some bodies are base64, some are lists."""
    df = payloads(spark, sf_dir, "events").selectExpr("*", "get_json_object(props, '$.k') AS k")
    first = """concat('{"item":{"author":{"id":"', user_id, '","uniqueId":"user', user_id, '","nickname":"User ', user_id,
        '","avatarMedium":"https://img.example.com/', user_id, '.jpg","verified":', k > 50,
        '},"authorStats":{"followerCount":',
        CASE event_type WHEN 'purchase' THEN '"1,234"' WHEN 'view' THEN CAST(value AS STRING)
            ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) END,
        ',"followingCount":', k, ',"heartCount":', event_id % 1000, ',"videoCount":true}}}')"""
    second = """concat('{"item":{"author":{"id":', user_id + 1, ',"uniqueId":"user', user_id + 1,
        '"},"authorStats":', CASE event_type WHEN 'signup' THEN 'null'
            ELSE concat('{"followerCount":" ', k, ' ","heartCount":7}') END, '}}')"""
    body = f"""concat('{{"data":[', {first}, ',{{"item":{{}}}},',
        CASE event_type WHEN 'error' THEN '5' ELSE '{{}}' END, ',', {second}, ']}}')"""
    df = df.selectExpr("*", f"if(event_id % 5 = 0, concat('[', {body}, ']'), {body}) AS body_text")
    return _landed(
        df, "event_id", f"concat('{SEARCH}', event_id)",
        "if(event_id % 3 = 0, base64(encode(body_text, 'UTF-8')), body_text)",
        {"ctx_hashtag": "if(event_id % 2 = 0, event_type, concat(' #', event_type))"}, "event_id % 3 = 0",
    )


def post_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a post-list response of its customer: a post, a non-object, and a post that other
    customers list too."""
    body = """concat('{"itemList":[{"id":"', o_orderkey, '","desc":"', o_orderpriority, '"},5,{"id":',
        o_orderkey div 2, ',"desc":"again"}]}')"""
    return _landed(payloads(spark, sf_dir, "orders"), "o_orderkey", f"concat('{POST_LIST}', o_orderkey)", body,
                   {"ctx_user_id": "CAST(o_custkey AS STRING)"})


def comment_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a comment-list response of its order: a comment of its own and one that other posts
    show too. First lines hold their JSON inside a JSON string."""
    body = """concat('{"comments":[{"cid":"', l_orderkey, '-', l_linenumber, '","create_time":',
        unix_seconds(CAST(l_shipdate AS TIMESTAMP)), ',"digg_count":', l_quantity, '},"x",{"cid":"p', l_partkey, '"}]}')"""
    df = payloads(spark, sf_dir, "lineitem").selectExpr("*", f"{body} AS body_text")
    text = "if(l_linenumber = 1, to_json(CAST(body_text AS VARIANT)), body_text)"
    return _landed(df, f"struct({LINE_ORDER})", f"concat('{COMMENT_LIST}', l_orderkey)", text,
                   {"ctx_post_id": "CAST(l_orderkey AS STRING)", "ctx_user_id": "CAST(l_suppkey AS STRING)"})


def event_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as some response; errors are failed captures without a body."""
    return payloads(spark, sf_dir, "events").selectExpr(
        "event_id AS response_seq",
        f"""concat(CASE event_type WHEN 'click' THEN '{SEARCH}' WHEN 'view' THEN upper('{SEARCH}')
            WHEN 'signup' THEN '{POST_LIST}' WHEN 'purchase' THEN '{COMMENT_LIST}'
            ELSE 'https://example.com/?id=' END, event_id) AS url""",
        "if(event_type = 'error', CAST(NULL AS VARIANT), parse_json(props)) AS body",
        """map('content-length', if(event_type = 'view', 'unknown',
            CAST(CAST(value * 20000 AS BIGINT) AS STRING))) AS headers""",
    )


def mixed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, post-list and comment-list responses in one table, with the post lists that failed (errors) and their
    ``arrival``: searches first, then posts, then comments."""
    line = table(spark, sf_dir, "lineitem").selectExpr(f"struct({LINE_ORDER}) AS line").schema["line"].dataType.simpleString()
    arrival = "named_struct('phase', {phase}, 'number', {number}, 'line', {line}) AS arrival"
    none = arrival.replace("{line}", f"CAST(NULL AS {line})")
    parts = [
        search_captures(spark, sf_dir).selectExpr("* EXCEPT (response_seq)", none.format(phase=0, number="response_seq")),
        post_captures(spark, sf_dir).selectExpr("* EXCEPT (response_seq)", none.format(phase=1, number="response_seq")),
        table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(
            f"concat('{POST_LIST}', event_id) AS url", "CAST(NULL AS VARIANT) AS body", "false AS is_base64", "CAST(NULL AS STRING) AS ctx_hashtag",
            "CAST(user_id AS STRING) AS ctx_user_id", "CAST(NULL AS STRING) AS ctx_post_id", none.format(phase=2, number="event_id")),
        comment_captures(spark, sf_dir).selectExpr(
            "* EXCEPT (response_seq)", arrival.format(phase=3, number="0L", line=f"CAST(response_seq AS {line})")),
    ]
    mixed = parts[0]
    for part in parts[1:]:
        mixed = mixed.unionByName(part)
    return mixed


# --- interchange records ----------------------------------------------------------------------------


def _records(df: DataFrame, pos: str, json_text: str) -> DataFrame:
    # Null struct fields vanish in to_json, which gives records with missing keys.
    return df.selectExpr(f"{pos} AS record_pos", f"parse_json({json_text}) AS record")


def profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles: negative balances, fractional hearts and settings above 3 break rules."""
    return _records(payloads(spark, sf_dir, "customer"), "c_custkey", """to_json(named_struct(
        'user_id', CAST(c_custkey AS STRING), 'username', c_name, 'display_name', lower(c_name),
        'profile_url', concat('HTTPS://WWW.Example.com/@', c_name),
        'follower_count', CAST(floor(c_acctbal) AS BIGINT),
        'following_count', concat(' +', c_nationkey, '.0 '),
        'heart_count', if(c_mktsegment = 'BUILDING', c_acctbal, CAST(c_custkey AS DOUBLE)),
        'found_under_hashtags', array(concat('#', c_mktsegment), lower(c_mktsegment), '#été'),
        'raw_author_data', named_struct('secUid', concat('sec', c_custkey), 'signature', c_mktsegment,
            'verified', if(c_nationkey % 2 = 0, 'yes', 'OFF'), 'avatarThumb', 'http://cdn.example.com:80/a b.png',
            'avatarMedium', 'ftp://x', 'commentSetting', c_nationkey % 5,
            'duetSetting', if(c_nationkey = 7, CAST(NULL AS INT), 3))))""")


_POST = """to_json(named_struct('post_id', CAST(doc_id AS STRING), 'user_id', source,
    'raw_post_data', named_struct('desc', {desc}, {stats} 'isAd', doc_id % 2, 'createTime', {created},
        'textExtra', transform(split(lower(text), r'\\s+'),
            t -> named_struct('type', 1, 'hashtagName', t)){extra})))"""


def post_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts, the text being the caption: long texts and odd lengths break rules."""
    stats = """'stats', if(lang = 'en', named_struct('playCount', format_number(n_chars, 0), 'diggCount', CAST(n_chars AS STRING),
            'commentCount', CAST(concat(doc_id % 97, '.5') AS STRING), 'shareCount', '7'), NULL),
        'statsV2', named_struct('playCount', concat(n_chars, 'K'), 'collectCount', '12'),"""
    created = "if(lang = 'de', n_chars * 1000000000, doc_id * 86400)"
    extra = ", 'video', named_struct('duration', n_chars % 700)"
    return _records(payloads(spark, sf_dir, "documents"), "doc_id",
                    _POST.format(desc="text", stats=stats, created=created, extra=extra))


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts with a short caption, so that every text's words are read as hashtags."""
    return documents_as_posts(payloads(spark, sf_dir, "documents"))


def documents_as_posts(documents: DataFrame) -> DataFrame:
    return _records(documents, "doc_id", _POST.format(desc="lang", stats="", created="doc_id", extra=""))


def comment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as comments: negative likes (no discount) and text reply totals break rules."""
    return _records(payloads(spark, sf_dir, "lineitem"), f"struct({LINE_ORDER})", """to_json(named_struct(
        'comment_id', concat(l_orderkey, '-', l_linenumber), 'post_id', CAST(l_orderkey AS STRING),
        'user_id', CAST(l_suppkey AS STRING),
        'raw_comment_data', named_struct('create_time', unix_seconds(CAST(l_shipdate AS TIMESTAMP)),
            'text', if(l_returnflag = 'R', NULL, concat(l_returnflag, l_linestatus)),
            'digg_count', if(l_discount = 0, -1D, l_quantity),
            'reply_comment_total', if(l_tax = 0, 'many', CAST(l_linenumber AS STRING)),
            'share_info', if(l_linestatus = 'O', named_struct('title', l_returnflag), NULL))))""")


def reply_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as comments: users answer with one object, assistants with a list holding one rejected
    reply, systems with a list cut off by a reply without a user."""
    reply = """named_struct('cid', concat(conv_id, '-', turn, '{n}'), 'user', named_struct('uid', CAST(conv_id AS STRING)),
        'text', text, 'digg_count', {digg}, 'label_text', {label})"""
    a = reply.format(n="a", digg="turn", label="role")
    b = reply.format(n="b", digg="-1L", label="role")
    c = reply.format(n="c", digg="0L", label="CAST(NULL AS STRING)")
    return _records(payloads(spark, sf_dir, "conversations"), "struct(conv_id, turn)", f"""concat(
        '{{"comment_id":"', conv_id, '-', turn, '","post_id":"', conv_id, '","user_id":"u","raw_comment_data":{{"reply_comment":',
        CASE role WHEN 'user' THEN to_json({a})
            WHEN 'assistant' THEN concat('[', to_json({a}), ',', to_json({b}), ',', to_json({c}), ']')
            ELSE concat('[', to_json({a}), ',{{"user":null}},', to_json({c}), ']') END, '}}}}')""")


# --- typed entities ---------------------------------------------------------------------------------


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS user_id", "c_name AS username", "lower(c_name) AS display_name",
        "concat('https://img.example.com/', c_custkey) AS avatar_url", "c_nationkey % 2 = 0 AS verified",
        "CAST(floor(c_acctbal) AS BIGINT) AS follower_count", "CAST(c_nationkey AS BIGINT) AS following_count",
        "c_custkey * 3 AS heart_count", "c_custkey % 10 AS video_count",
        "parse_json(concat('{\"id\":', c_custkey, '}')) AS raw_author_data",
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS post_id", "CAST(o_custkey AS STRING) AS user_id",
        "o_orderkey AS response_seq", "0 AS item_pos",
        "parse_json(concat('{\"id\":', o_orderkey, '}')) AS raw_post_data",
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS comment_id", "CAST(l_orderkey AS STRING) AS post_id",
        "CAST(l_suppkey AS STRING) AS user_id", "unix_seconds(CAST(l_shipdate AS TIMESTAMP)) AS create_time",
        f"struct({LINE_ORDER}) AS response_seq", "0 AS item_pos",
        "parse_json(concat('{\"digg_count\":', l_quantity, '}')) AS raw_comment_data",
    )


def tag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('#', event_type) AS hashtag", "CAST(user_id AS STRING) AS user_id", "event_id AS response_seq", "0 AS item_pos"
    )


def requested_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags to search: the event types, and the market segments, which no event has."""
    return table(spark, sf_dir, "events").selectExpr("event_type AS hashtag").distinct().unionByName(
        table(spark, sf_dir, "customer").selectExpr("concat(' #', lower(c_mktsegment)) AS hashtag").distinct()
    )


# --- clean tables for metrics -------------------------------------------------------------------------


def clean_influencers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS tiktok_id", "CAST(floor(abs(c_acctbal) * 120) AS BIGINT) AS follower_count",
        "CAST(c_nationkey AS BIGINT) AS following_count",
        """CASE c_nationkey % 4 WHEN 0 THEN concat('mail me: ', lower(c_mktsegment), '@example.com')
            WHEN 1 THEN 'see www.example.com now' WHEN 2 THEN c_mktsegment END AS bio_text""",
    )


def clean_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS post_id", "CAST(o_custkey AS STRING) AS influencer_tiktok_id",
        "if(o_orderstatus = 'P', 0L, CAST(floor(o_totalprice) AS BIGINT)) AS view_count",
        "o_orderkey % 1000 AS like_count", "o_orderkey % 100 AS comment_count", "o_orderkey % 10 AS share_count",
    )


def clean_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as comments; the owner is the customer with the order's last digits."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS comment_id", "CAST(l_orderkey % 1000 AS STRING) AS influencer_tiktok_id",
        "concat(l_returnflag, l_linestatus, l_linenumber) AS comment_text",
    )


def clean_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as replies; those with little tax answer a comment that was never captured."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(if(l_tax > 0.02, '', 'gone-'), l_orderkey, '-', l_linenumber) AS main_comment_id",
        "if(l_returnflag = 'A', 'Creator', 'fan') AS label_text",
    )


def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS influencer_tiktok_id", "event_type AS hashtag") \
        .groupBy("influencer_tiktok_id", "hashtag").count().withColumnRenamed("count", "frequency")


def category_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS hashtag", "if(event_type IN ('click', 'view'), 'browsing', 'buying') AS category"
    ).distinct()
