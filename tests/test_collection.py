"""A whole run over a bronze table, and what sinks and summaries do with odd inputs."""

import pytest
from pyspark.sql import functions as F

from creatorlake.catalog import collection as catalog
from creatorlake.catalog import inputs
from creatorlake.functions.urls import normalize_url
from creatorlake.operators import summaries
from creatorlake.plans import collection
from creatorlake.sinks import files
from creatorlake.sources import bronze
from tests.conftest import plan_text


@pytest.fixture(scope="module")
def landed(spark, sf_dir):
    return catalog._landed(spark, sf_dir)


def test_each_stage_reads_its_own_partition(spark, landed):
    run = collection.collect_bronze(spark, landed, catalog.RUN_ID, staged=False)
    for df, endpoint in [(run.authors, "search"), (run.posts, "posts"), (run.comments, "comments")]:
        plan = plan_text(df)
        assert f"(endpoint#" in plan and f"= {endpoint})" in plan.split("PartitionFilters")[1], endpoint
        assert plan.count("FileScan") == 1


def test_positions_rise_with_arrival(spark, sf_dir, landed):
    posts = bronze.read(spark, landed, "posts", [catalog.RUN_ID])
    got = [r.url for r in posts.where("body IS NOT NULL").orderBy("response_seq").collect()]
    want = [r.url for r in inputs.post_captures(spark, sf_dir).orderBy("response_seq").select("url").collect()]
    assert got == want
    assert bronze.read(spark, landed).select("response_seq").distinct().count() == bronze.read(spark, landed).count()


def test_landing_again_replaces_the_run(spark, tmp_path):
    rows = spark.sql("""SELECT * FROM VALUES (2L, 'https://example.com', '{"a":1}'), (1L, 'HTTPS://WWW.TIKTOK.COM/api/post/item_list/?x=1', '5'),
        (3L, CAST(NULL AS STRING), CAST(NULL AS STRING)) AS t(response_seq, url, text)""").selectExpr(
        "response_seq", "url", "CAST(text AS VARIANT) AS body", "false AS is_base64", "'t' AS ctx_hashtag", "'u' AS ctx_user_id", "'p' AS ctx_post_id")
    root = str(tmp_path / "bronze")
    for run, df in [("a", rows), ("b", rows.limit(1)), ("a", rows)]:
        bronze.land(df, root, run, ["response_seq"])
    assert {(r.run_id, r.endpoint): r["count"] for r in bronze.read(spark, root).groupBy("run_id", "endpoint").count().collect()} in (
        {("a", "posts"): 1, ("a", "other"): 2, ("b", "other"): 1}, {("a", "posts"): 1, ("a", "other"): 2, ("b", "posts"): 1})
    assert bronze.read(spark, root, "search").count() == 0


def test_an_empty_append_keeps_earlier_rows(spark, tmp_path):
    full = spark.range(3).withColumnRenamed("id", "k")
    for df in (full, full.where("false"), full):
        written = files.write_tables({"t": df}, str(tmp_path), "r1", mode="append")
    assert spark.read.parquet(written["t"]).count() == 6
    assert files.write_tables({"new": full.where("false")}, str(tmp_path), "r1", mode="append") == {}
    assert not (tmp_path / "new" / "run_id=r1").exists()


def test_requested_tags_are_found_however_typed(spark):
    def frame(rows, fields):
        return spark.createDataFrame(rows, fields)

    requested = frame([("#a",), ("a",), (" b ",), ("c",), ("#d",), (" d",)], "hashtag string")
    ranked = frame([("#a", "1"), ("b", "2")], "hashtag string, user_id string")
    none = frame([], "user_id string, post_id string")
    failed = summaries.failed_items(requested, ranked, none, none, none, none)
    assert sorted(r.item_id for r in failed.collect()) == [" d", "c"]
    found = summaries.hashtag_metadata(requested, ranked, "2025-01-01 00:00:00")
    assert {r.hashtag.strip(" #"): r.profiles_found for r in found.collect()} == {"a": 1, "b": 1, "c": 0, "d": 0}


@pytest.mark.parametrize("name", ["u", "p", "c", "s", "done", "x"])
def test_addresses_in_columns_of_any_name(spark, name):
    df = spark.createDataFrame([("HTTP://Example.com/a/../b c",)], f"{name} string")
    assert df.select(F.expr(normalize_url(name))).first()[0] == "http://example.com/b%20c"


def test_bucketed_tables_are_joined_where_they_lie(spark, sf_dir):
    """No exchange above a bucketed scan; only the side that is keyed otherwise moves."""
    from creatorlake.catalog import relations as catalog_relations
    from creatorlake.operators import relations

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        silver = catalog_relations._silver(spark, sf_dir)
        posts = silver["posts"].select("post_id")
        todo = plan_text(relations.posts_to_do(posts, silver["comments"].select("post_id")))
        owned = plan_text(relations.comment_owner(silver["comments"], silver["owners"]))
        flat = plan_text(relations.flat_posts(silver["posts"], silver["owners"]))
        profiles = inputs.profiles(spark, sf_dir)
        comments = plan_text(relations.flat_comments(silver["comments"], silver["owners"], profiles))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in (todo, owned, flat):
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    # Owners are joined to names by owner first; the comments, the large side, stay.
    assert comments.count("Exchange") == 3
