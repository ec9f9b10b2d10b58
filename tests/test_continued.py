"""Merges, counts and streams that are cut short or repeated end as one run over everything would."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from creatorlake.operators import cleaning
from creatorlake.operators.incremental import TagCounts
from creatorlake.sinks.entities import EntityTable
from creatorlake.sinks.files import exists
from creatorlake.streaming import keyed

ROWS = "k string, v long, response_seq long, item_pos int"


def runs(seed=1):
    rng = random.Random(seed)
    keys = [None, "", "hot", *map(str, range(40))]
    return {f"r{n}": [("hot" if rng.random() < 0.5 else rng.choice(keys), rng.randrange(100), s, p) for s in range(60) for p in range(2)] for n in (3, 1, 2)}


def wanted(taken, keep):
    """Per key the row of its last (or first) place, and its first place."""
    places = collections.defaultdict(list)
    for run, rows in taken.items():
        for k, v, s, p in rows:
            places[k].append(((run, s, p), v))
    return {k: (*(max if keep == "last" else min)(x), min(x)[0]) for k, x in places.items()}


def held(table):
    return {r.k: ((r.run_id, r.response_seq, r.item_pos), r.v, tuple(r.first_place)) for r in table.read().collect()}


@pytest.mark.parametrize("keep", ["last", "first"])
def test_merges_in_any_order_equal_one_run(spark, tmp_path, keep):
    table = EntityTable(spark, str(tmp_path / "t"), ["k"], keep=keep, buckets=5)
    taken = {}
    for run, rows in runs().items():
        taken[run] = rows
        for _ in range(2):  # a repeat changes nothing
            table.merge(spark.createDataFrame(rows, ROWS), run)
            assert held(table) == wanted(taken, keep)
        table.merge_once(spark.createDataFrame(rows, ROWS).withColumn("v", F.lit(-1).cast("long")), run, "done before")
        table.merge(spark.createDataFrame(rows, ROWS), run)
        table.merge_once(spark.createDataFrame([], ROWS), run, "nothing")
    assert table.read().count() == len(wanted(taken, keep))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = EntityTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    table.merge(spark.createDataFrame([(str(i), i, i, 0) for i in range(200)], ROWS), "a")

    def files():
        return {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in (tmp_path / "t" / "rows").glob("bucket=*/*.parquet")}

    before = files()
    done = table.merge(spark.createDataFrame([("7", -7, 0, 0), ("new", 1, 0, 1)], ROWS), "b")
    assert len(before) == 16 and 1 <= len(done.buckets) <= 2
    assert {b for b, f in files().items() if f != before[b]} == {f"bucket={b}" for b in done.buckets}
    assert {r.k: r.v for r in done.before.collect()} == {"7": 7} and {r.k: r.v for r in done.after.collect()} == {"7": -7, "new": 1}


POST = "post_id string, influencer_tiktok_id string, hashtags array<string>, violations array<string>, record_pos long"
PROFILE = "tiktok_id string, hashtags array<string>, violations array<string>, record_pos long"


@pytest.mark.parametrize("fails", ["commit", "apply", "end"])
def test_counts_follow_captures_and_survive_a_stop(spark, tmp_path, monkeypatch, fails):
    """After each run, stopped once at the named step and repeated, counts equal a recount of the last captures."""
    rng = random.Random(4)
    posts = EntityTable(spark, str(tmp_path / "posts"), ["post_id"], ["record_pos"], buckets=3)
    profiles = EntityTable(spark, str(tmp_path / "profiles"), ["tiktok_id"], ["record_pos"], buckets=3)
    counts = TagCounts(str(tmp_path / "counts"), posts, profiles)
    last_posts, last_profiles = {}, {}
    for run in ("r1", "r2", "r3"):
        new = [(str(i), rng.choice("xyz"), rng.choices("abcd", k=rng.randrange(5)), rng.choice([[], [], ["bad"]]), i) for i in range(30) if rng.random() < 0.5]
        people = [(who, rng.choices(["#A", "b"], k=2), [], i) for i, who in enumerate("xyz") if rng.random() < 0.6]
        frames = spark.createDataFrame(new, POST), spark.createDataFrame(people, PROFILE)
        if run == "r2":
            stop(monkeypatch, fails)
            with pytest.raises(RuntimeError):
                counts.update(*frames, run)
            monkeypatch.undo()
        counts.update(*frames, run)
        counts.update(*frames, run)
        last_posts.update({p[0]: p for p in new})
        last_profiles.update({p[0]: p for p in people})
        want = collections.Counter((p[1], t) for p in last_posts.values() if not p[3] for t in p[2])
        want.update((p[0], t.strip("#").lower()) for p in last_profiles.values() for t in p[1])
        assert {(r[0], r[1]): r[2] for r in counts.counts().select("influencer_tiktok_id", "hashtag", "frequency").collect()} == dict(want)


def stop(monkeypatch, step):
    def failing(*args, **kwargs):
        raise RuntimeError(step)

    if step == "apply":
        monkeypatch.setattr(EntityTable, "apply", failing)
    else:
        commit = EntityTable.commit

        def sometimes(self, token):
            if token.endswith("changes") == (step == "commit"):
                failing()
            commit(self, token)

        monkeypatch.setattr(EntityTable, "commit", sometimes)


def test_first_wins_stream_restarts(spark, tmp_path, monkeypatch):
    """Stopped after the merge of the second batch, before its commit; then run to the end; then one batch repeated."""
    table = EntityTable(spark, str(tmp_path / "t"), ["k"], keep="first", buckets=4)
    taken = runs(5)["r1"]
    for k in range(4):
        spark.createDataFrame(taken[::-1][k::4], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))

    def start():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landing"))
        return keyed.first_wins(stream, table, str(tmp_path / "checkpoint"))

    commit = EntityTable.commit

    def failing(self, token):
        if token == "batch 1":
            raise RuntimeError("stopped")
        commit(self, token)

    monkeypatch.setattr(EntityTable, "commit", failing)
    with pytest.raises(Exception, match="stopped"):
        start().awaitTermination()
    monkeypatch.undo()
    assert table.committed("batch 0") and not table.committed("batch 1")
    start().awaitTermination()
    want = wanted({"": taken}, "first")
    assert held(table) == want
    table.merge_once(spark.createDataFrame([("hot", -1, -1, -1)], ROWS), "", "batch 3")
    assert held(table) == want
    with pytest.raises(ValueError):
        keyed.first_wins(None, EntityTable(spark, "x", ["k"]), "y")


def test_rows_a_year_late_are_counted(spark, tmp_path):
    counts = keyed.WindowCounts(spark, str(tmp_path / "w"), "1 hour", "2 hours")
    batches = [[("2024-05-01 10:10:00", "a")] * 3 + [("2024-05-01 11:00:00", "b")], [("2024-05-02 00:00:00", "a"), ("2024-05-01 09:59:59", "b")],
               [("2023-05-01 10:10:00", "a"), ("2024-05-01 10:20:00", "a"), ("2024-05-01 22:30:00", "a"), (None, "a")], []]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "t string, hashtag string").selectExpr("CAST(t AS TIMESTAMP) AS event_time", "hashtag")
        for _ in range(2):  # a repeated batch counts once
            counts.absorb(df, k)
    got = {(str(r.window_start), r.hashtag): (r.uses, r.late_uses) for r in counts.read().where("window_start IS NOT NULL").collect()}
    assert got == {("2024-05-01 10:00:00", "a"): (4, 1), ("2024-05-01 11:00:00", "b"): (1, 0), ("2024-05-02 00:00:00", "a"): (1, 0),
                   ("2024-05-01 09:00:00", "b"): (1, 0), ("2023-05-01 10:00:00", "a"): (1, 1), ("2024-05-01 22:00:00", "a"): (1, 0)}
    late = spark.read.parquet(str(tmp_path / "w" / "late")).orderBy("event_time").collect()
    assert [str(r.event_time) for r in late] == ["2023-05-01 10:10:00", "2024-05-01 10:20:00"]


def test_nothing_saved_yet(spark, tmp_path):
    table = EntityTable(spark, str(tmp_path / "t"), ["k"])
    assert not table.exists() and not table.committed("a")
    table.merge_once(spark.createDataFrame([], ROWS), "a")
    assert not exists(spark, str(tmp_path / "t" / "rows")) and table.committed("a")
    none = TagCounts(str(tmp_path / "c"), table, table)
    assert none.counts().count() == 0 and cleaning.hashtag_frequency(none.counts()).count() == 0
