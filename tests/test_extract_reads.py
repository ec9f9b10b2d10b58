"""Extraction reads each field once, in compiled code, and values of odd types as before."""

import re

from pyspark.sql import functions as F

from creatorlake.operators import extract
from tests.conftest import plan_text

CONTEXT = "'t' AS ctx_hashtag, 'u' AS ctx_user_id, 'p' AS ctx_post_id"


def responses(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "response_seq long, text string")
    return df.selectExpr("response_seq", "parse_json(text) AS body", *CONTEXT.split(", "))


def test_ids_and_numbers_of_odd_types(spark):
    ids = {"null": None, "false": None, "0": None, "0.0": None, '""': None, "[]": None, "{}": None, '"0"': "0", '"false"': "false", "true": "true",
           "7": "7", "1.50": "1.5", "[0]": "[0]", '{"a":1}': '{"a":1}'}
    bodies = ['{"data":[{"item":{"author":{"id":%s}}}]}' % i for i in ids]
    got = {r.response_seq: r.user_id for r in extract.extract_authors(responses(spark, *bodies)).collect()}
    assert got == {n: v for n, v in enumerate(ids.values()) if v is not None}
    numbers = {"5": 5, "5.9": 5, "-5.9": -5, "true": 1, '" 1_0 "': 10, "1e3": 1000, "null": None, '"1.0"': None, '"x"': None, "[]": None, "{}": None}
    bodies = ['{"data":[{"item":{"author":{"id":1,"verified":%s},"authorStats":{"heartCount":%s}}}]}' % (n, n) for n in numbers]
    got = {r.response_seq: (r.heart_count, r.verified) for r in extract.extract_authors(responses(spark, *bodies)).collect()}
    assert {n: v[0] for n, v in got.items()} == {n: v for n, v in enumerate(numbers.values()) if v is not None}
    assert got[3][1] is True and got[0][1] is None


def test_items_that_are_no_objects(spark):
    author = '{"item":{"author":{"id":"%s","uniqueId":null}}}'
    bodies = [f'{{"data":[{author % "a"},{{}},{{"item":5}},{{"item":{{"author":"x"}}}},{author % "b"},%s,{author % "c"}]}}' % end for end in ("5", "null", "[]", '"x"')]
    got = [(r.response_seq, r.item_pos, r.user_id, r.username, r.display_name, r.follower_count)
           for r in extract.extract_authors(responses(spark, *bodies, '{"data":{}}', "[]", '{"data":[]}')).collect()]
    assert sorted(got) == sorted((n, pos, who, None, "", 0) for n in range(4) for pos, who in ((0, "a"), (4, "b")))
    stats = ['{"data":[{"item":{"author":{"id":1},"authorStats":%s}}]}' % s for s in ("null", "3", "[]", "{}")]
    assert [r.response_seq for r in extract.extract_authors(responses(spark, *stats)).collect()] == [3]


def test_missing_and_null_fields_of_posts_and_comments(spark):
    items = ["{}", '{"id":null,"cid":null,"create_time":null}', '{"id":7,"cid":{"a":1},"create_time":"12"}', "5", '{"id":"","cid":"c","create_time":"x"}']
    body = ",".join(items)
    posts = extract.extract_posts(responses(spark, f'{{"itemList":[{body}]}}')).collect()
    assert [(r.item_pos, r.post_id) for r in posts] == [(0, ""), (1, None), (2, "7"), (4, "")]
    text = '"{\\"comments\\":[%s]}"' % body.replace('"', '\\"')
    for form in (f'{{"comments":[{body}]}}', text):
        comments = extract.extract_comments(responses(spark, form)).collect()
        assert [(r.item_pos, r.comment_id, r.create_time) for r in comments] == [(0, "", 0), (1, None, None), (2, '{"a":1}', 12), (4, "c", None)]


def test_bodies_are_read_whole_and_kinds_once(spark, tmp_path):
    responses(spark, "{}").write.parquet(str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    # As a column over the scan, a body was read as text too, every object written out for it.
    assert "body:struct<0:variant>" in plan_text(extract.extract_comments(landed)).replace("body:variant", "body:struct<0:variant>")
    kinds = [line for line in plan_text(extract.extract_authors(landed)).split("\n") if "SchemaOfVariant" in line]
    assert len(kinds) == 1 and kinds[0].count("SchemaOfVariant.schemaOfVariant") == 6
