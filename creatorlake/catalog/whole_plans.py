"""The cleaning plan end to end, and tables written and read back, held against the SQL of their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from creatorlake.catalog import cleaning as parts
from creatorlake.catalog import inputs
from creatorlake.catalog.captures import _authors_out
from creatorlake.catalog.registry import ORACLES, QUERIES, query
from creatorlake.operators import extract
from creatorlake.plans.cleaning import clean
from creatorlake.session import new_staging_path
from creatorlake.sinks import files
from creatorlake.sources import interchange, large_documents, responses, snapshots


def _cleaned(spark, sf_dir, posts=inputs.post_records):
    return clean(inputs.profile_records(spark, sf_dir), posts(spark, sf_dir), inputs.comment_records(spark, sf_dir), inputs.RUN_TS)


@query(ORACLES["clean_profiles"])
def plan_influencers(spark, sf_dir):
    return _cleaned(spark, sf_dir).influencers


@query(ORACLES["clean_posts"])
def plan_posts(spark, sf_dir):
    return _cleaned(spark, sf_dir).posts


@query(ORACLES["clean_comments"])
def plan_comments(spark, sf_dir):
    return _cleaned(spark, sf_dir).comments


@query(ORACLES["post_hashtags"])
def plan_post_hashtags(spark, sf_dir):
    return _cleaned(spark, sf_dir, inputs.tagged_documents).post_hashtags


@query(ORACLES["hashtag_frequency"])
def plan_hashtag_frequency(spark, sf_dir):
    return _cleaned(spark, sf_dir, inputs.tagged_documents).hashtag_frequency


@query(ORACLES["reply_rows"])
def plan_reply_comments(spark, sf_dir):
    tables = clean(inputs.profile_records(spark, sf_dir), inputs.post_records(spark, sf_dir), inputs.reply_records(spark, sf_dir), inputs.RUN_TS)
    return tables.reply_comments


@query(" UNION ALL ".join(f"({ORACLES[q]})" for q in ("quarantine_profiles", "quarantine_posts", "quarantine_comments")))
def plan_quarantine(spark, sf_dir):
    rejected = _cleaned(spark, sf_dir).quarantine
    return rejected.selectExpr("entity", "record_id", "array_join(violations, '; ') AS violations")


@query(f"""
    SELECT 'influencers' AS item, count(*) AS row_count FROM ({ORACLES["clean_profiles"]})
    UNION ALL SELECT 'posts', count(*) FROM documents
    UNION ALL SELECT 'comments', count(*) FROM conversations
    UNION ALL SELECT 'reply_comments', count(*) FROM ({ORACLES["reply_rows"]})
    UNION ALL SELECT 'post_hashtags', count(*) FROM ({ORACLES["post_hashtags"]})
    UNION ALL SELECT 'hashtag_frequency', count(*) FROM ({ORACLES["hashtag_frequency"]})
    UNION ALL SELECT 'hashtag_influencer_pairs', (SELECT count(*) FROM (SELECT DISTINCT source, tag FROM ({parts.KEPT})))
        + 2 * (SELECT count(*) FROM ({ORACLES["clean_profiles"]}))""")
def plan_summary(spark, sf_dir):
    """All counts of a cleaning run, comments with replies among them."""
    return clean(inputs.profile_records(spark, sf_dir), inputs.tagged_documents(spark, sf_dir), inputs.reply_records(spark, sf_dir),
                 inputs.RUN_TS).summary()


def _written(spark, tables, fmt):
    return files.write_tables(tables, new_staging_path(spark, "written"), "0007", fmt)


@query(ORACLES["clean_profiles"])
def written_parquet(spark, sf_dir):
    df = parts.clean_profiles(spark, sf_dir)
    return spark.read.schema(df.schema).parquet(_written(spark, {"influencers": df}, "parquet")["influencers"])


@query(ORACLES["flat_profiles"])
def written_csv(spark, sf_dir):
    df = QUERIES["flat_profiles"](spark, sf_dir)
    path = _written(spark, {"profiles": df}, "csv")["profiles"]
    return spark.read.schema(df.schema).options(header=True, escape='"').csv(path)


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS username, CAST(floor(c_acctbal) AS BIGINT) AS follower_count,
        CAST(c_custkey AS BIGINT) AS source_id FROM customer""")
def written_json(spark, sf_dir):
    """JSON Lines out, interchange records in."""
    path = files.export_json({"profiles": inputs.profiles(spark, sf_dir)}, new_staging_path(spark, "written"), "0007")["profiles"]
    return interchange.read_json_lines(spark, path).selectExpr(
        "variant_get(record, '$.user_id', 'string') AS user_id", "variant_get(record, '$.username', 'string') AS username",
        "variant_get(record, '$.follower_count', 'bigint') AS follower_count",
        "variant_get(record, '$.raw_author_data.id', 'bigint') AS source_id")


@query(ORACLES["relation_rows"])
def restored_snapshot(spark, sf_dir):
    """Two runs saved, the newer one, which has an empty table, restored."""
    root = new_staging_path(spark, "snapshots")
    edges = QUERIES["relation_rows"](spark, sf_dir)
    profiles = inputs.profiles(spark, sf_dir)
    snapshots.save_snapshot({"profiles": profiles, "relations": edges.selectExpr("user_id", "'old' AS hashtag")}, root, "0006")
    snapshots.save_snapshot({"profiles": profiles.where("user_id IS NULL"), "relations": edges}, root, "0007")
    tables = snapshots.restore_latest(spark, root)
    return tables["relations"].unionByName(tables["profiles"].selectExpr("user_id", "username AS hashtag"))


@query(ORACLES["extract_authors"])
def landed_responses(spark, sf_dir):
    """Search responses landed as JSON Lines, with their bodies as text or as JSON, and read by the schema of the landing zone."""
    captures = inputs.search_captures(spark, sf_dir)
    path = f"{new_staging_path(spark, 'landed')}/responses"
    captures.write.json(path)
    return _authors_out(extract.extract_authors(responses.decoded(responses.read_responses(spark, path))))


def _exported(spark, sf_dir):
    """The flat tables, their summary and a metadata row as CSV."""
    tables = {"profiles": QUERIES["flat_profiles"](spark, sf_dir), "posts": QUERIES["flat_posts"](spark, sf_dir),
              "comments": QUERIES["flat_comments"](spark, sf_dir), "profile_hashtag_relations": QUERIES["relation_rows"](spark, sf_dir)}
    return tables, files.export_csv(tables, QUERIES["relationship_summary"](spark, sf_dir), new_staging_path(spark, "export"), "0007", inputs.RUN_TS)


@query(ORACLES["export_metadata"])
def exported_metadata(spark, sf_dir):
    schema = QUERIES["export_metadata"](spark, sf_dir).schema
    return spark.read.schema(schema).options(header=True, escape='"').csv(_exported(spark, sf_dir)[1]["metadata"])


@query(ORACLES["flat_comments"])
def exported_comments(spark, sf_dir):
    tables, written = _exported(spark, sf_dir)
    rows = spark.read.schema(tables["comments"].schema).options(header=True, escape='"').csv(written["comments"])
    return rows.fillna("", ["profile_username", "profile_display_name"])


#: Customers of one document: bounds what is put together before it is written.
CUSTOMERS_PER_DOCUMENT = 1000


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name || ' }],"' AS username, CAST(floor(c_acctbal) AS BIGINT) AS follower_count,
        (row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey)) - 1 AS item_pos FROM customer""")
def split_documents(spark, sf_dir):
    """Indented documents, one a file, read back by splits of lines."""
    path = f"{new_staging_path(spark, 'exports')}/documents"
    rows = inputs.table(spark, sf_dir, "customer").selectExpr(
        f"c_custkey div {CUSTOMERS_PER_DOCUMENT} AS document", "struct(c_custkey AS place, CAST(c_custkey AS STRING) AS user_id, "
        "concat(c_name, ' }],\"') AS username, CAST(floor(c_acctbal) AS BIGINT) AS follower_count) AS r")
    rows.groupBy("document").agg(F.array_sort(F.collect_list("r")).alias("profiles")).selectExpr(
        "document", "to_json(struct(array('[{') AS posts, profiles), map('pretty', 'true')) AS text").write.partitionBy("document").text(path)
    found = large_documents.entity_records(large_documents.read_elements(spark, path), "profiles")
    return found.selectExpr(
        "variant_get(record, '$.user_id', 'string') AS user_id", "variant_get(record, '$.username', 'string') AS username",
        "variant_get(record, '$.follower_count', 'bigint') AS follower_count", "CAST(record_pos.item_pos AS BIGINT) AS item_pos")
