"""First N items per key: one shuffle where no key is hot, two where one is, the same rows either way."""

import random

from creatorlake.operators import topn
from tests.conftest import plan_text

SCHEMA = "post_id string, comment_id string, response_seq long, item_pos int"


def captures():
    rng = random.Random(5)
    keys = [None, "", "hot", *map(str, range(30))]
    return [("hot" if rng.random() < 0.4 else rng.choice(keys), rng.choice([None, *map(str, range(9))]), n, p) for n in range(400) for p in range(2)]


def wanted(rows, n):
    first = {}
    for row in sorted(rows, key=lambda r: r[2:]):
        first.setdefault(row[:2], row)
    kept, count = set(), {}
    for row in sorted(first.values(), key=lambda r: r[2:]):
        count[row[0]] = count.get(row[0], 0) + 1
        if count[row[0]] <= n:
            kept.add((*row, count[row[0]]))
    return kept


def test_both_plans_give_the_first_items(spark):
    rows = captures()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for n in (1, 3, 1200):
        for hot in (True, False):
            got = [tuple(r) for r in topn.first_comments_per_post(df, n, hot).collect()]
            assert len(got) == len(set(got)) and set(got) == wanted(rows, n)


def test_without_a_hot_key_rows_are_shuffled_once(spark):
    df = spark.createDataFrame(captures(), SCHEMA)
    plans = {hot: plan_text(topn.first_comments_per_post(df, 3, hot)).count("Exchange hashpartitioning") for hot in (True, False)}
    assert plans == {True: 2, False: 1}
    posts = df.selectExpr("post_id AS user_id", "comment_id AS post_id", "response_seq", "item_pos")
    assert plan_text(topn.first_posts_per_profile(posts, 3, False)).count("Exchange hashpartitioning") == 1


def test_hot_keys_are_found_by_their_own_rows(spark, monkeypatch):
    monkeypatch.setattr(topn, "HOT_ROWS", 20)
    even = spark.range(400).selectExpr("CAST(id % 40 AS STRING) AS k")
    assert not topn.holds_hot_key(even, "k") and not topn.holds_hot_key(even.where("false"), "k")
    # Groups that are large because many keys share them do not make a key hot.
    monkeypatch.setattr(topn, "HOT_GROUPS", 2)
    assert not topn.holds_hot_key(even, "k")
    for hot in ("'a'", "CAST(NULL AS STRING)"):
        assert topn.holds_hot_key(even.union(spark.range(21).selectExpr(f"{hot} AS k")), "k")


def test_a_hot_post_is_planned_with_two_shuffles(spark, tmp_path, monkeypatch):
    from creatorlake.catalog import QUERIES

    lines = spark.range(60).selectExpr(
        "id % 6 AS l_orderkey", "id AS l_partkey", "id % 3 AS l_suppkey", "CAST(id AS INT) AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice",
        "0.0D AS l_discount", "0.0D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS l_shipdate")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {}
    for rows in (5, 100):
        monkeypatch.setattr(topn, "HOT_ROWS", rows)
        df = QUERIES["first_n_comments"](spark, str(tmp_path))
        found[rows] = plan_text(df).count("Exchange hashpartitioning"), sorted(map(tuple, df.collect()), key=str)
    assert found[5][0] == 2 and found[100][0] == 1 and found[5][1] == found[100][1] and len(found[5][1]) == 18
