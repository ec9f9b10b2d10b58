"""Properties of ranking, dedup, resume, sinks, snapshots and streams on small fixtures."""

import json

from pyspark.sql import functions as F

from creatorlake.operators import dedup, ranking, relations, summaries, topn
from creatorlake.sinks import files
from creatorlake.sources import interchange, responses, snapshots
from creatorlake.streaming import ingest
from tests.conftest import plan_text


def captures(spark, rows):
    return spark.createDataFrame(rows, "hashtag string, user_id string, follower_count long, heart_count long, response_seq long, item_pos int")


def test_ties_at_the_border_keep_the_earlier_arrival(spark):
    df = captures(spark, [("t", "a", 5, 0, 2, 0), ("t", "b", 5, 0, 1, 0), ("t", "c", 9, 0, 3, 0), ("t", "c", 99, 0, 4, 0)])
    got = topn.top_profiles_per_hashtag(df, 2).orderBy("rn").collect()
    assert [(r.user_id, r.follower_count) for r in got] == [("c", 9), ("b", 5)]


def test_large_n_equals_small_n_plan(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', CAST(id % 7 AS STRING)) AS k", "id AS pos")
    order = [F.asc("pos")]
    big = topn.top_n(df, ["k"], order, 1200)
    plain = topn._limit(df, ["k"], order, 1200)
    assert sorted(big.collect()) == sorted(plain.collect())


def test_groups_are_trimmed_before_the_shuffle(spark):
    df = captures(spark, [("t", "a", 5, 0, 2, 0)])
    assert plan_text(dedup.keep_first(df, ["user_id"])).count("WindowGroupLimit") >= 1


def test_last_wins_at_first_position(spark):
    df = captures(spark, [("t", "a", 1, 0, 5, 0), ("s", "a", 2, 0, 9, 1), ("t", "b", 3, 0, 7, 0)]).withColumns({"rn": F.lit(1), "score": F.lit(1)})
    got = {r.user_id: (r.hashtag, r.response_seq, r.item_pos) for r in relations.merge_profiles(df).collect()}
    assert got == {"a": ("s", 5, 0), "b": ("t", 7, 0)}


def test_percent_rank_equals_window(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', CAST(id % 5 AS STRING)) AS g",
                                      "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 4 = 0 THEN 0.5 ELSE (id * 7919 % 1000 - 300) * 1e6 END AS v")
    ours = ranking.percent_rank_in_groups(df, "g", "v", 3, "pr")
    want = df.where("v IS NOT NULL").selectExpr("id", "percent_rank() OVER (PARTITION BY g ORDER BY v) AS want")
    assert ours.join(want, "id").where("abs(pr - want) > 1e-12").count() == 0
    assert ours.where("pr IS NULL").count() == df.where("v IS NULL").count()


def test_complete_when_nothing_is_open(spark):
    none = spark.createDataFrame([], "hashtag string, user_id string, post_id string")
    assert relations.resume_point(none, none, none).collect() == [("complete", None)]


def test_averages_of_nothing(spark):
    none = spark.createDataFrame([], "user_id string, post_id string")
    row = summaries.load_summary(none, none).first()
    assert (row.success_rate, row.average_posts_per_profile) == (0.0, 0.0)


def test_csv_and_empty_tables(spark, tmp_path):
    full = spark.sql("SELECT 'a' AS k, '' AS e, CAST(NULL AS STRING) AS n, array('x') AS tags, true AS b, 'say \"hi\"' AS q")
    written = files.write_tables({"full": full, "empty": full.where("false")}, str(tmp_path), "r1", "csv", python_words=True)
    assert set(written) == {"full"}
    lines = spark.read.text(written["full"]).collect()
    assert [r.value for r in lines] == ["k,e,n,tags,b,q", 'a,,,"[""x""]",True,"say ""hi"""']


def test_snapshot_round_trip(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshots.restore_latest(spark, root) is None
    for run, raw in [("0006", '{"a":1}'), ("0007", '{"a":2}')]:
        df = spark.sql("SELECT 'u' AS user_id").withColumn("raw", F.parse_json(F.lit(raw)))
        snapshots.save_snapshot({"profiles": df, "posts": df.where("false" if run == "0007" else "true")}, root, run)
    got = snapshots.restore_latest(spark, root)
    assert [(r.user_id, r.raw) for r in got["profiles"].selectExpr("user_id", "to_json(raw) AS raw").collect()] == [("u", '{"a":2}')]
    assert got["posts"].count() == 0 and got["posts"].dtypes == got["profiles"].dtypes
    states = snapshots.snapshot_states(spark, root, 1)
    assert {tuple(r) for r in states.collect()} == {("0007", "kept"), ("0006", "expired")}


def test_newest_snapshot_file(spark, tmp_path):
    import os

    for k, name in enumerate(["b.json", "a.json"]):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    newest = snapshots.newest_files(snapshots.list_files(spark, str(tmp_path))).collect()
    assert [r.source_file.rsplit("/", 1)[1] for r in newest] == ["a.json"]


def test_csv_export_counts_what_it_wrote(spark, tmp_path):
    flat = {"profiles": spark.range(3), "posts": spark.range(0), "comments": spark.range(2), "profile_hashtag_relations": spark.range(1)}
    written = files.export_csv(flat, spark.sql("SELECT 1 AS a"), str(tmp_path), "r1", "2025-01-01 00:00:00")
    assert set(written) == {"profiles", "comments", "profile_hashtag_relations", "summary", "metadata"}
    row = spark.read.csv(written["metadata"], header=True).first()
    assert (row.profiles_count, row.posts_count, row.comments_count, row.relations_count, row.total_files_created) == ("3", "0", "2", "1", "4")


def test_one_ranking_for_any_number_of_weights(spark):
    from creatorlake.operators import metrics

    df = spark.range(50).selectExpr("CAST(id AS STRING) AS influencer_tiktok_id", *[f"CAST(id * {k + 3} % 17 AS DOUBLE) AS m{k}" for k in range(6)])
    plans = [plan_text(metrics.qualification_score(df, {f"m{k}": 1.0 for k in range(n)})) for n in (2, 6)]
    assert plans[0].count("FileScan") == plans[1].count("FileScan")
    assert not any("Cartesian" in p or "NestedLoop" in p for p in plans)
    wide = spark.createDataFrame([("a", 1e300), ("b", None), ("c", 2.0)], "influencer_tiktok_id string, m double")
    assert {r[0]: r[1] for r in metrics.qualification_score(wide, {"m": 1.0}).collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_no_payload_is_parsed_beside_a_scan(spark, sf_dir):
    """Filters that Spark infers or pushes down must not evaluate payloads a second time at the scan."""
    import re

    from creatorlake.catalog import QUERIES

    for name in ("extract_authors", "extract_posts", "extract_comments", "first_author_per_hashtag", "last_author", "merged_profiles",
                 "top_profiles_per_hashtag", "hashtag_frequency", "hashtag_frequency_skip", "search_summary", "clean_profiles"):
        lines = plan_text(QUERIES[name](spark, sf_dir)).split("\n")
        for above, line in zip(lines, lines[1:]):
            assert not ("FileScan" in line and re.search("Filter.*(parse_?json|variant_get)", above, re.I)), (name, above[:200])


def test_json_export_reads_back(spark, tmp_path):
    df = spark.sql("SELECT 'p' AS post_id, parse_json('{\"desc\":\"x\"}') AS raw_post_data")
    path = files.export_json({"posts": df}, str(tmp_path), "r1")["posts"]
    record = interchange.read_json_lines(spark, path).selectExpr("to_json(record) AS r").first().r
    assert json.loads(record) == {"post_id": "p", "raw_post_data": {"desc": "x"}}


def test_response_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    rows = [{"response_seq": i, "url": "u", "body": {"k": i}} for i in range(3)]
    (landing / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = ingest.response_stream(spark, str(landing))
    ingest.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert responses.captured(responses.read_responses(spark, str(landing))).count() == 3
