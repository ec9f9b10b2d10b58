"""Steps that shared inputs, landing and merging must take for work to spread and for little to be written."""

import os

from pyspark.sql import functions as F

from creatorlake import session
from creatorlake.catalog import QUERIES
from creatorlake.sinks.entities import EntityTable
from creatorlake.sources import bronze

ROWS = "k string, v long, response_seq long, item_pos int"


def tasks(df):
    return df.groupBy(F.spark_partition_id()).count().where("count > 0").count()


def test_one_large_row_group_is_dealt_out(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert tasks(one) == 1 and tasks(session.dealt(one)) >= 4
    assert session.dealt(one).agg(F.sum("id"), F.count("*")).first()[:] == (199_990_000, 20_000)
    small, none = one.where("id < 100"), one.where("false")
    assert session.dealt(small) is small and session.dealt(none) is none


def test_payloads_of_one_task_are_dealt_out(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS c_custkey", "concat('Customer', id) AS c_name", "1 AS c_nationkey", "1.0D AS c_acctbal", "'A' AS c_mktsegment")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = QUERIES["clean_profiles"](spark, str(tmp_path))
    assert found.count() == 3000 and tasks(found) > 1


def test_landed_files_are_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bronze, "ROWS_PER_FILE", 10)
    rows = spark.range(45).selectExpr("id AS response_seq", "'u' AS url", "CAST('{}' AS VARIANT) AS body", "false AS is_base64", "'' AS ctx_hashtag",
                                      "'' AS ctx_user_id", "'' AS ctx_post_id")
    root = bronze.land(rows, str(tmp_path / "bronze"), "1", ["response_seq"])
    assert len(bronze.read(spark, root).inputFiles()) >= 5 and bronze.read(spark, root).count() == 45


def test_merging_alone_writes_nothing_but_the_table(spark, tmp_path):
    """What only the table needs goes into the table at once: nothing is staged, and nothing stays beside the new files."""
    table = EntityTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    staged = set(os.listdir(session.staging_root(spark)))
    for token, low in (("a", 0), ("b", 50)):
        table.merge_once(spark.range(low, low + 100).selectExpr("CAST(id AS STRING) AS k", f"id + {low} AS v", "id AS response_seq", "0 AS item_pos"), token)
    assert set(os.listdir(session.staging_root(spark))) == staged
    got = {r.k: (r.v, r.run_id, r.first_place.run_id) for r in table.read().collect()}
    assert table.read().count() == 150 and got["10"] == (10, "a", "a") and got["60"] == (110, "b", "a") and got["120"] == (170, "b", "b")
    table.merge_once(spark.createDataFrame([("60", 1, 0, 0)], ROWS), "0")
    assert {r.k: r.first_place.run_id for r in table.read().where("k = '60'").collect()} == {"60": "0"} and table.read().count() == 150


def test_streamed_responses_land_compressed(spark, sf_dir):
    QUERIES["streamed_progress"](spark, sf_dir)
    root = session.staging_root(spark)
    newest = max((f"{root}/{d}" for d in os.listdir(root) if d.startswith("streamed-")), key=os.path.getmtime)
    files = [f for f in os.listdir(f"{newest}/landing") if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
