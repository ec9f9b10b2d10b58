"""Golden mini-documents: records in, clean tables and quarantine out."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from creatorlake.operators import cleaning as c
from creatorlake.operators.quality import error_log, quarantine
from creatorlake.plans.cleaning import clean
from creatorlake.sources import interchange

RUN = "2025-01-02 03:04:05"
RUN_TIME = dt.datetime(2025, 1, 2, 3, 4, 5)
DROP = object()


def records(spark, items):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "record_pos int, j string")
    return df.select("record_pos", F.try_parse_json("j").alias("record"))


def profile(author=None, **over):
    base = {"user_id": "u1", "username": "ann", "display_name": "Ann", "raw_author_data": {} if author is None else author}
    base.update(over)
    return {k: v for k, v in base.items() if v is not DROP}


def post(raw=None, **over):
    base = {"post_id": "p1", "user_id": "u1", "raw_post_data": {} if raw is None else raw}
    base.update(over)
    return {k: v for k, v in base.items() if v is not DROP}


def comment(raw=None, **over):
    base = {"comment_id": "c1", "post_id": "p1", "user_id": "u1", "raw_comment_data": {} if raw is None else raw}
    base.update(over)
    return {k: v for k, v in base.items() if v is not DROP}


def tag(name, kind=1):
    return {"type": kind, "hashtagName": name}


def column(checked, name):
    return [getattr(r, name) if not r.violations else "reject" for r in checked.orderBy("record_pos").collect()]


def test_profile_defaults(spark):
    row = c.influencers(c.check_profiles(records(spark, [profile()]), RUN)).first()
    assert row.asDict() == {
        "tiktok_id": "u1", "username": "ann", "sec_uid": "", "display_name": "Ann", "bio_text": "",
        "is_verified": False, "is_private": False, "profile_url": None, "avatar_thumb": None,
        "avatar_medium": None, "avatar_large": None, "follower_count": 0, "following_count": 0,
        "total_likes": 0, "video_count": 0, "comment_setting": None, "duet_setting": None,
        "stitch_setting": None, "download_setting": None, "created_at": RUN_TIME, "updated_at": RUN_TIME,
    }


def test_follower_count(spark):
    given = ["12", " 12 ", "1_000", "12.0", "1,000", "12.5", None, -1, 5.0, True]
    checked = c.check_profiles(records(spark, [profile(follower_count=v) for v in given]), RUN)
    assert column(checked, "follower_count") == [12, 12, 1000, 12, "reject", "reject", "reject", "reject", 5, 1]


def test_profile_text_rules(spark):
    given = [
        profile(user_id=7), profile(user_id=""), profile(user_id=DROP), profile(username="x" * 51),
        profile(username="😀" * 50), profile(display_name=""), profile(display_name="x" * 101),
        profile({"secUid": None}), profile({"signature": None}), profile({"signature": 5}),
        profile(raw_author_data=None), profile(raw_author_data=DROP), profile(raw_author_data=[]), 5, None,
    ]
    checked = c.check_profiles(records(spark, given), RUN)
    keep = [v != "reject" for v in column(checked, "tiktok_id")]
    assert keep == [False, False, False, False, True, False, False, False, True, False, False, True, False, False, False]


def test_settings_and_flags(spark):
    checked = c.check_profiles(records(spark, [profile({"commentSetting": v}) for v in [0, 3, 4, None, "2", -1]]), RUN)
    assert column(checked, "comment_setting") == [0, 3, "reject", None, 2, "reject"]
    checked = c.check_profiles(records(spark, [profile({"verified": v}) for v in ["yes", 2, None, 1.0]]), RUN)
    assert column(checked, "is_verified") == [True, "reject", "reject", True]


def test_bad_address_never_rejects(spark):
    checked = c.check_profiles(records(spark, [profile(profile_url=v) for v in ["http://a.com", "x", None, 5, ""]]), RUN)
    assert column(checked, "profile_url") == ["http://a.com/", None, None, None, None]


def test_profile_tags(spark):
    given = [
        profile(found_under_hashtags=["#A", "a", "#", "#été"]),
        profile(user_id="u2", found_under_hashtags=None),
        profile(user_id="u3", found_under_hashtags=["b"], username=""),
        profile(user_id="u4", found_under_hashtags=["b", 5]),
        profile(user_id="u5", found_under_hashtags="b"),
    ]
    checked = c.check_profiles(records(spark, given), RUN)
    assert column(checked, "tiktok_id") == ["u1", "u2", "reject", "reject", "reject"]
    no_posts = c.check_posts(records(spark, [post(5)]), RUN)
    counts = c.tag_counts(c.profile_tags(checked), c.post_tags(no_posts))
    assert {(r.hashtag, r.frequency) for r in counts.collect()} == {("a", 2), ("", 1), ("été", 1)}
    assert [(r.hashtag, r.frequency) for r in c.hashtag_frequency(counts).collect()] == [("a", 2)]


def test_view_count(spark):
    texts = ["1,234", "1.2K", "-5", "+5", " 12 ", "12.0", ""]
    others = [-5, 5.0, 5.5, True, None, [], {}]
    checked = c.check_posts(records(spark, [post({"stats": {"playCount": v}}) for v in texts + others]), RUN)
    assert column(checked, "view_count") == [1234, 0, 0, 0, 0, 0, 0, "reject", 5, "reject", 1, 0, "reject", "reject"]


def test_stats_fall_back_as_a_whole(spark):
    second = {"diggCount": 7}
    firsts = [{}, None, DROP, [], "", 0, False, {"playCount": 1}, "text", [1]]
    given = [post({k: v for k, v in {"stats": s, "statsV2": second}.items() if v is not DROP}) for s in firsts]
    checked = c.check_posts(records(spark, given), RUN)
    assert column(checked, "like_count") == [7, 7, 7, 7, 7, 7, 7, 0, 0, 0]


def test_duration(spark):
    videos = [{}, {"duration": None}, {"duration": 0}, {"duration": 600}, {"duration": 601}, None, 5, {"duration": "60"}]
    checked = c.check_posts(records(spark, [post({"video": v}) for v in videos]), RUN)
    assert column(checked, "duration") == [30, 30, "reject", 600, "reject", 30, 30, 60]


def test_posted_at(spark):
    given = [post({}), *[post({"createTime": v}) for v in ["1690000000", 1690000000000, 1e20, None, 1690000000]]]
    checked = c.check_posts(records(spark, given), RUN)
    assert column(checked, "posted_at") == [
        dt.datetime(1970, 1, 1), RUN_TIME, RUN_TIME, "reject", RUN_TIME, dt.datetime(2023, 7, 22, 4, 26, 40)]


def test_description(spark):
    given = [post({}), *[post({"desc": v}) for v in [None, "😀" * 2000, "x" * 2001, 5]]]
    got = column(c.check_posts(records(spark, given), RUN), "description")
    assert got == ["", "reject", "😀" * 2000, "reject", "reject"]


def test_post_records_that_are_no_objects(spark):
    given = [post(raw_post_data=None), post(raw_post_data=DROP), post(5), 5, None, [], post(post_id=7), post(user_id=None)]
    assert column(c.check_posts(records(spark, given), RUN), "post_id") == [
        "reject", "p1", "reject", "reject", "reject", "reject", "reject", "reject"]


TAG_CASES = [
    ([tag("a"), tag("été"), tag("b")], ["a"], ["a", "b"]),
    ([tag("a"), tag("A"), tag("")], ["a", "a"], ["a", "a"]),
    ([tag("a"), tag("x", 0), tag("b")], ["a", "b"], ["a", "b"]),
    ([tag("a"), tag("b\n"), tag("c")], ["a"], ["a", "c"]),
    ([tag("x" * 101), tag("c")], [], ["c"]),
    ([tag("a"), 5, tag("c")], ["a"], ["a", "c"]),
    ([tag("a"), tag(None), tag("c")], ["a"], ["a", "c"]),
    ([tag("a"), {"type": 1}, tag("c")], ["a", "c"], ["a", "c"]),
    ([tag("a", True), tag("b", 1.0), tag("c", "1"), tag("d", None)], ["a", "b"], ["a", "b"]),
    (None, [], []),
    ("text", [], []),
    ({"type": 1}, [], []),
    ([], [], []),
]


@pytest.mark.parametrize("mode", ["cut", "skip"])
def test_post_hashtags(spark, mode):
    given = [post({"textExtra": t}, post_id=f"p{i}") for i, (t, _, _) in enumerate(TAG_CASES)]
    checked = c.check_posts(records(spark, given), RUN, mode)
    assert column(checked, "hashtags") == [cut if mode == "cut" else skip for _, cut, skip in TAG_CASES]
    assert c.posts(checked).count() == len(TAG_CASES)


def test_comments(spark):
    given = [
        comment({}), comment({"share_info": None}), comment({"share_info": {"title": None}}), comment({"share_info": 5}),
        comment({"reply_comment_total": -1}), comment({}, comment_id=""), comment({"digg_count": -1}),
        comment({"text": None}), comment(raw_comment_data=None), 5, comment({"create_time": 1e20}),
    ]
    assert column(c.check_comments(records(spark, given), RUN), "comment_id") == [
        "c1", "reject", "reject", "reject", "c1", "", "reject", "reject", "reject", "reject", "reject"]


def test_replies(spark):
    ok = {"cid": "r", "user": {"uid": "x"}, "text": "t"}
    cases = [
        (None, 0), (ok, 1), ([ok, ok], 2), ([ok, {**ok, "digg_count": -1}, ok], 2), ([ok, {**ok, "user": None}, ok], 1),
        ([ok, 5, ok], 1), ("text", 0), (7, 0), ({}, 1), ([], 0), ([{**ok, "label_text": 5}, ok], 1),
        ([{**ok, "label_text": None}], 1),
    ]
    given = [comment({"reply_comment": r}, comment_id=f"c{i}") for i, (r, _) in enumerate(cases)]
    given.append(comment({"reply_comment": ok, "digg_count": -1}, comment_id="bad"))
    checked = c.check_comments(records(spark, given), RUN)
    replies = c.reply_comments(c.check_replies(checked))
    got = {r.main_comment_id: r["count"] for r in replies.groupBy("main_comment_id").count().collect()}
    assert got == {f"c{i}": n for i, (_, n) in enumerate(cases) if n}
    assert c.comments(checked).count() == len(cases)


def test_quarantine_holds_what_is_not_valid(spark):
    given = [profile(), profile(user_id=7, follower_count=-1)]
    checked = c.check_profiles(records(spark, given), RUN)
    bad = quarantine(checked, "profile", "tiktok_id")
    row = bad.first()
    assert bad.count() + c.influencers(checked).count() == len(given)
    assert row.violations == ["tiktok_id: text, 1 or longer", "follower_count: integer, 0 or more"]
    assert json.loads(row.raw)["user_id"] == 7
    log = error_log(bad, "CLEANING", RUN)
    assert [r.message for r in log.collect()] == row.violations


def test_document_to_tables(spark, tmp_path):
    document = {
        "profiles": [profile(found_under_hashtags=["#Fit"]), profile(user_id="")],
        "posts": [post({"textExtra": [tag("Fit"), tag("gym")]}), post({"textExtra": [tag("fit")]}, post_id="p2")],
        "comments": [comment({"reply_comment": {"cid": "r1", "user": {"uid": "x"}}})],
    }
    path = tmp_path / "export.json"
    path.write_text(json.dumps(document, indent=2), encoding="utf-8-sig")
    documents = interchange.read_documents(spark, str(path))
    parts = [interchange.entity_records(documents, e) for e in ["profiles", "posts", "comments"]]
    tables = clean(*parts, run_ts=RUN)
    counts = {name: df.count() for name, df in tables.outputs().items()}
    assert counts == {"influencers": 1, "posts": 2, "comments": 1, "reply_comments": 1, "post_hashtags": 3, "hashtag_frequency": 2}
    freq = {(r.hashtag, r.frequency) for r in tables.hashtag_frequency.collect()}
    assert freq == {("fit", 3), ("gym", 1)}
    assert tables.quarantine.count() == 1
    lazy = clean(*parts, run_ts=RUN, staged=False)
    assert {(r.hashtag, r.frequency) for r in lazy.hashtag_frequency.collect()} == freq


def test_broken_document_raises(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('{"profiles": [')
    with pytest.raises(Exception):
        interchange.entity_records(interchange.read_documents(spark, str(path)), "profiles").count()


def test_json_lines(spark, tmp_path):
    path = tmp_path / "posts.jsonl"
    path.write_text("\n".join([json.dumps(post()), "{broken", json.dumps(post(post_id="p2"))]))
    checked = c.check_posts(interchange.read_json_lines(spark, str(path)), RUN)
    assert column(checked, "post_id") == ["p1", "reject", "p2"]
    assert "broken" in quarantine(checked, "post", "post_id").first().raw


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, "p1", "u1", '{"desc":"x"}')], "n int, post_id string, user_id string, j string")
    df = df.select("n", "post_id", "user_id", F.parse_json("j").alias("raw_post_data"))
    checked = c.check_posts(interchange.rows_as_records(df, ["n"]), RUN)
    assert c.posts(checked).first().description == "x"


def test_check_needs_no_shuffle(spark):
    from tests.conftest import plan_text

    checked = c.check_posts(records(spark, [post()]), RUN)
    assert "Exchange" not in plan_text(c.post_hashtags(checked))
