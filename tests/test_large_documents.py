"""A document split over many tasks gives what reading it whole gives."""

import json
import random

import pytest

from creatorlake.sources import interchange, large_documents

ODD = ['}]{[', 'a "quoted" \\" one', "\\", "\\\\", '",', "é😀", "x" * 300, "", "[1, {", "line\nend\ttab", "null"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return rng.choice(ODD)
    if kind < 4:
        return rng.choice([None, True, -1.5e10, 7])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(ODD) + str(k): value(rng, depth + 1) for k in range(rng.randrange(4))}


def rows(df):
    return sorted((r.source_file, r.item_pos, json.dumps(json.loads(r.record), sort_keys=True)) for r in df.selectExpr(
        "record_pos.source_file", "record_pos.item_pos", "to_json(record) AS record").collect())


@pytest.mark.parametrize("indent, split", [(2, 400), (4, 5000), ("\t", 1 << 27), (0, 700)])
def test_equal_to_reading_whole(spark, tmp_path, indent, split):
    rng = random.Random(split)
    for k in range(3):
        doc = {e: [value(rng) for _ in range(rng.randrange(12) if k else 60)] for e in interchange.ENTITIES}
        doc["posts"] = [{"post_id": str(i), "raw": value(rng)} for i in range(20)] if k else []
        doc = {"load_summary": {"a": [1, {"b": "]"}], "c": "}"}, **doc, "extra": 5, "more": "}"}
        (tmp_path / f"{k}.json").write_text("\ufeff" * (k == 1) + json.dumps(doc, indent=indent, ensure_ascii=k == 2) + "\n" * k, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        elements = large_documents.read_elements(spark, str(tmp_path))
        got = {e: rows(large_documents.entity_records(elements, e)) for e in interchange.ENTITIES}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = interchange.read_documents(spark, str(tmp_path))
    assert got == {e: rows(interchange.entity_records(whole, e)) for e in interchange.ENTITIES}
    assert len(got["profiles"]) >= 60


def test_broken_documents_raise(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"posts": [\n{"a": 1},\n')
    with pytest.raises(ValueError, match="a.json"):
        large_documents.read_elements(spark, str(tmp_path))
