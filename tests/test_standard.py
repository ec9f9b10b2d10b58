"""Canonical composition against the standard library, and texts of records however they are written."""

import json
import random
import unicodedata

from pyspark.sql import functions as F

from creatorlake.functions import encoding
from creatorlake.operators.standard import standard_records, without_repeats
from creatorlake.plans.cleaning import clean

BLANKS = "".join(map(chr, encoding.WHITE_SPACE))


def expected(text):
    return unicodedata.normalize("NFC", text).strip(BLANKS)


def check(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").selectExpr("x", f"{encoding.standard('x')} AS y").collect()
    assert [(r.x, r.y) for r in rows if r.y != (None if r.x is None else expected(r.x))] == []


def test_every_assigned_character(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xF900 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    # Hundreds a text, parted by a full stop, and each after a letter and a mark that it may have to pass.
    check(spark, [None, "", BLANKS, BLANKS * 3 + "a b" + BLANKS])
    check(spark, [".".join(map(chr, codes[k:k + 400])) for k in range(0, len(codes), 400)])
    check(spark, [".".join(f"ọ{chr(c)}" for c in codes[k:k + 400]) for k in range(0, len(codes), 400)])


def test_marks_in_any_order(spark):
    rng = random.Random(3)
    marks = [chr(c) for c in range(0x300, 0x370)] + list("aeiouAEn가각각़̈́कַי ᄀ")
    check(spark, ["".join(rng.choices(marks, k=rng.randrange(1, 30))) for _ in range(3000)])


def standardised(value):
    if isinstance(value, str):
        return expected(value)
    if isinstance(value, list):
        return [standardised(v) for v in value]
    if isinstance(value, dict):
        return {k: standardised(v) for k, v in value.items()}
    return value


def test_records_however_written(spark):
    rng = random.Random(5)
    pieces = ['"', "\\", "\n", "\t", "\r", "\f", "\x0b", "\b", "\x01", "\x02", "\x1f", "n", ":", ",", "{", "}", "[", "]", " ", "　", "é", " ", "😀", "u000B", "/"]

    def text():
        return "".join(rng.choices(pieces, k=rng.randrange(12)))

    def value(depth):
        kind = rng.randrange(8)
        if kind < 4 or depth > 3:
            return text()
        if kind < 6:
            return {text(): value(depth + 1) for _ in range(rng.randrange(4))}
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 6 else rng.choice([1, 2.5, True, None, 10**20, -0.001])

    values = [value(0) for _ in range(1500)] + [None, {}, [], "", {" a ": " a ", "a": "\\ "}, "é" * 50_000, " " * 200_000, ' \\"' * 50_000]
    records = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=k % 2 == 0)) for k, v in enumerate(values)] + [(-1, None)], "record_pos long, j string")
    records = records.selectExpr("record_pos", "parse_json(j) AS record")
    got = {r.record_pos: r.j for r in standard_records(records).selectExpr("record_pos", "to_json(record) AS j").collect()}
    assert got.pop(-1) is None and len(got) == len(values)
    assert [v for k, v in enumerate(values) if json.loads(got[k]) != standardised(v)] == []
    assert standard_records(records.where("false")).count() == 0


def test_the_last_valid_record_of_a_profile_stays(spark):
    rows = [("a", [], 1), ("a", [], 3), ("a", ["bad"], 5), ("b", ["bad"], 2), ("b", ["bad"], 4), (None, [], 6)]
    checked = spark.createDataFrame(rows, "k string, violations array<string>, record_pos long")
    assert {r.record_pos for r in without_repeats(checked, "k").collect()} == {3, 5, 2, 4, 6}


def test_cleaning_starts_from_standard_texts(spark):
    """A name within its limit only once trimmed, found twice under ids that differ in blanks."""
    def record(user, name):
        return json.dumps({"user_id": user, "username": name, "display_name": "d", "raw_author_data": {"secUid": "s"}})

    name = "é" * 50
    rows = [(0, record("7", "first")), (1, record(" 7\n", name)), (2, record("8", " "))]
    none = spark.createDataFrame([], "record_pos long, j string").select("record_pos", F.parse_json("j").alias("record"))
    profiles = spark.createDataFrame(rows, "record_pos long, j string").select("record_pos", F.parse_json("j").alias("record"))
    tables = clean(profiles, none, none, "2025-01-01 00:00:00", standard=True)
    assert [(r.tiktok_id, r.username) for r in tables.influencers.collect()] == [("7", "é" * 50)]
    assert [r.violations for r in tables.quarantine.collect()] == [["username: text, 1 to 50"]]
    assert clean(profiles, none, none, "2025-01-01 00:00:00").influencers.count() == 2
