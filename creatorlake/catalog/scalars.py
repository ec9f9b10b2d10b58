"""Scalar semantics over whole tables."""

from __future__ import annotations

from creatorlake import constants as k
from creatorlake.catalog.inputs import RUN_TS, event_captures, table
from creatorlake.catalog.registry import query
from creatorlake.functions import coerce, tags, times, urls, variants
from creatorlake.sources.responses import captured, decoded, failed, with_large_flag

@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN CAST(floor(l_extendedprice) AS BIGINT)
             WHEN l_returnflag = 'A' THEN CAST(l_orderkey AS BIGINT) ELSE 0 END AS parsed
    FROM lineitem""")
def comma_number(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        """CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN format_number(floor(l_extendedprice), 0)
            WHEN l_returnflag = 'A' THEN CAST(l_orderkey AS STRING)
            WHEN l_returnflag = 'N' THEN concat(l_quantity, 'K') ELSE concat('-', l_orderkey) END AS raw""")
    return df.selectExpr("* EXCEPT (raw)", f"{coerce.comma_int('raw')} AS parsed")


@query("""
    SELECT event_id,
        CAST(CASE event_type WHEN 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT)
            WHEN 'view' THEN CASE WHEN value = floor(value) THEN floor(value) END
            WHEN 'signup' THEN user_id WHEN 'purchase' THEN NULL ELSE 1000 + event_id % 10 END AS BIGINT) AS lax,
        CAST(CASE event_type WHEN 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT)
            WHEN 'view' THEN trunc(value) WHEN 'signup' THEN NULL WHEN 'purchase' THEN NULL
            ELSE 1000 + event_id % 10 END AS BIGINT) AS truncated,
        CASE WHEN event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS BIGINT) IN (0, 1)
                THEN CAST(json_extract_string(props, '$.k') AS BIGINT) = 1
            WHEN event_type = 'view' AND value IN (0, 1) THEN value = 1 END AS flag
    FROM events""")
def lax_coercion(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", """parse_json(CASE event_type
        WHEN 'click' THEN get_json_object(props, '$.k') WHEN 'view' THEN CAST(value AS STRING)
        WHEN 'signup' THEN concat('" +', user_id, '.00 "') WHEN 'purchase' THEN concat('"', user_id, ',000"')
        ELSE concat('"1_00', event_id % 10, '"') END) AS v""")
    return df.selectExpr("event_id", f"{coerce.lax_int('v')} AS lax", f"{coerce.truncating_int('v')} AS truncated",
                         f"{coerce.lax_bool('v')} AS flag")


@query("""
    SELECT event_id, json_extract_string(props, '$.k') AS k, '30' AS missing, '30' AS through_number, 'null' AS kept_null
    FROM events""")
def nested_get(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr(
        "event_id", "parse_json(concat('{\"n\":null,\"a\":', props, '}')) AS v")
    return df.selectExpr(
        "event_id", f"to_json({variants.safe_get('v', 'a.k', '30')}) AS k",
        f"to_json({variants.safe_get('v', 'a.z.y', '30')}) AS missing",
        f"to_json({variants.safe_get('v', 'a.k.x', '30')}) AS through_number",
        f"to_json({variants.get_or_default('v', 'n', '30')}) AS kept_null")


@query(f"""
    SELECT event_id, CASE event_type WHEN 'click' THEN date_trunc('second', ts)
        WHEN 'view' THEN ts WHEN 'purchase' THEN TIMESTAMP '1970-01-01 00:00:00' WHEN 'error' THEN NULL
        ELSE TIMESTAMP '{RUN_TS}' END AS happened_at
    FROM events""")
def epoch_to_ts(spark, sf_dir):
    micros = "unix_micros(CAST(ts AS TIMESTAMP))"
    df = table(spark, sf_dir, "events").selectExpr("event_id", f"""parse_json(CASE event_type
        WHEN 'click' THEN concat('{{"t":', {micros} div 1000000, '}}')
        WHEN 'view' THEN concat('{{"t":', CAST({micros} AS DECIMAL(20, 0)) / 1000000, '}}')
        WHEN 'signup' THEN if(event_id % 2 = 0, concat('{{"t":', {micros} div 1000, '}}'), concat('{{"t":"', {micros}, '"}}'))
        WHEN 'purchase' THEN '{{}}' ELSE concat('{{"t":', {micros}, '00000}}') END) AS v""")
    df = df.selectExpr("event_id", f"{variants.get_or_default('v', 't', '0')} AS t")
    return df.selectExpr("event_id", f"{times.epoch_to_timestamp('t', RUN_TS)} AS happened_at")


@query("""
    SELECT page_id, form, CASE form WHEN 'bad port' THEN NULL WHEN 'ftp' THEN NULL WHEN 'no scheme' THEN NULL
        WHEN 'blank' THEN url || '%20x' ELSE url END AS normal
    FROM pages, (VALUES ('as is'), ('upper'), ('default port'), ('bad port'), ('ftp'), ('no scheme'), ('blank'), ('dots')) f(form)""")
def url_normalize(spark, sf_dir):
    rest = "substring(url, length(site) + 1)"
    df = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "regexp_extract(url, '^https?://[^/]+', 0) AS site")
    df = df.selectExpr("page_id", f"""stack(8, 'as is', url, 'upper', concat(upper(site), {rest}),
        'default port', concat(site, if(startswith(url, 'https'), ':443', ':80'), {rest}),
        'bad port', concat(site, ':70000', {rest}), 'ftp', concat('ftp', substring(url, locate(':', url))),
        'no scheme', substring(url, locate(':', url) + 3), 'blank', concat('\t', url, ' x '),
        'dots', concat(site, '/gone/./..', {rest})) AS (form, raw)""")
    return df.selectExpr("page_id", "form", f"{urls.normalize_url('raw')} AS normal")


@query("""
    SELECT c_custkey, 'https://www.tiktok.com/@' || c_name AS profile_url, 'https://www.tiktok.com/@' || c_name AS with_at,
        'https://www.tiktok.com/@@' || c_name AS plain, 'https://www.tiktok.com/@' || c_name || '/video/' || c_custkey AS video_url
    FROM customer""")
def built_urls(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "concat('@', c_name) AS at_name")
    return df.selectExpr(
        "c_custkey", f"{urls.profile_url('c_name')} AS profile_url", f"{urls.profile_url('at_name')} AS with_at",
        f"{urls.plain_profile_url('at_name')} AS plain", f"{urls.video_url('c_name', 'CAST(c_custkey AS STRING)')} AS video_url")


@query("""
    SELECT event_id, '#' || event_type AS with_hash, event_type || user_id AS without_hash, event_type <> 'view' AS valid
    FROM events""")
def hashtag_forms(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr(
        "event_id", "if(event_id % 2 = 0, concat('  ', event_type), concat('#', event_type, ' ')) AS a",
        "concat('#', upper(event_type), '#', user_id) AS b", "concat(event_type, if(event_type = 'view', 'é', '_1')) AS c")
    return df.selectExpr("event_id", f"{tags.with_hash('a')} AS with_hash", f"{tags.without_hash('b')} AS without_hash",
                         f"{tags.is_valid_tag('c')} AS valid")


@query("""
    SELECT conv_id, turn, CASE role WHEN 'user' THEN 'OBJECT' WHEN 'assistant' THEN 'OBJECT' ELSE 'STRING' END AS kind,
        CASE WHEN role <> 'system' THEN text END AS body_text, length(text) AS text_length
    FROM conversations""")
def body_decode(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "text", "role = 'assistant' AS is_base64",
        """CASE role WHEN 'user' THEN concat('[', to_json(struct(text)), ',5]')
            WHEN 'assistant' THEN base64(encode(to_json(struct(text)), 'UTF-8')) ELSE concat('{', text) END AS raw""")
    df = decoded(df.selectExpr("*", "CAST(raw AS VARIANT) AS body"))
    return df.selectExpr(
        "conv_id", "turn", "substring_index(schema_of_variant(body), '<', 1) AS kind",
        "try_variant_get(body, '$.text', 'string') AS body_text",
        "CAST(length(coalesce(try_variant_get(body, '$.text', 'string'), substring(try_variant_get(body, '$', 'string'), 2))) AS BIGINT) AS text_length")


@query("""
    SELECT event_id, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'search' WHEN 'signup' THEN 'posts'
        WHEN 'purchase' THEN 'comments' END AS endpoint, event_type <> 'error' AS captured
    FROM events""")
def route_responses(spark, sf_dir):
    rules = {"search": k.SEARCH_ENDPOINT, "posts": k.POST_LIST_ENDPOINT, "comments": k.COMMENT_LIST_ENDPOINT}
    cases = " ".join(f"WHEN url rlike r'(?i){pattern}' THEN '{name}'" for name, pattern in rules.items())
    df = event_captures(spark, sf_dir)
    routed = captured(df).selectExpr("response_seq", "url", "true AS captured").unionByName(
        failed(df).selectExpr("response_seq", "url", "false AS captured"))
    return routed.selectExpr("response_seq AS event_id", f"CASE {cases} END AS endpoint", "captured")


@query("""
    SELECT event_id, event_type <> 'view' AND CAST(trunc(value * 20000) AS BIGINT) > 1048576 AS is_large
    FROM events""")
def large_response(spark, sf_dir):
    return with_large_flag(event_captures(spark, sf_dir)).selectExpr("response_seq AS event_id", "is_large_response AS is_large")
