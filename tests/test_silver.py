"""Payload fields come from the scan alone, whatever the shapes of payloads."""

import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from creatorlake.functions.variants import safe_get
from creatorlake.sources import silver
from tests.conftest import plan_text

SHAPES = [None, "null", "{}", "[]", "5", '"a"', '{"n":1}', '{"n":"1"}', '{"n":"x"}', '{"n":[1]}', '{"n":{"a":null}}', '{"n":null,"d":{"e":"f"}}', '{"d":{"e":7}}',
          '{"d":"e"}', '{"d":[{"e":1}]}', '{"N":3}', '{"n":1e300}', '{"n":true}']
TYPED = {"n": ("$.n", "bigint"), "e": ("$.d.e", "string"), "a b": ("$.n.a", "variant")}
DEFAULTED = {"n": ("n", "0"), "e": ("d.e", '"?"')}


def written(spark, tmp_path):
    """Files of unlike shapes in one folder: all rows alike, some odd, all odd, and one that is not shredded."""
    path = str(tmp_path / "t")
    plain = [json.dumps({"n": k, "d": {"e": f"v{k}", "big": "x" * 1000}}) for k in range(300)]
    parts = [(plain, "true"), (plain + SHAPES, "true"), (SHAPES, "true"), (SHAPES + plain[:5], "false")]
    before = spark.conf.get("spark.sql.variant.writeShredding.enabled")
    for rows, shredded in parts:
        spark.conf.set("spark.sql.variant.writeShredding.enabled", shredded)
        df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k long, j string")
        df.coalesce(1).select("k", "j", F.parse_json("j").alias("p`q")).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.variant.writeShredding.enabled", before)
    return path


def test_values_equal_those_of_whole_payloads(spark, tmp_path):
    table = spark.read.parquet(written(spark, tmp_path))
    whole = table.select("k", "j", F.parse_json("j").alias("v"))

    def rows(df, names):
        kinds = dict(df.dtypes)
        return sorted(str(tuple(r)) for r in df.select("k", "j", *[F.to_json(f"`{n}`") if kinds[n] == "variant" else F.col(f"`{n}`") for n in names]).collect())

    want = whole.select("k", "j", *[F.expr(f"try_variant_get(v, '{p}', '{t}')").alias(n) for n, (p, t) in TYPED.items()])
    assert rows(silver.typed_fields(table, "p`q", TYPED), TYPED) == rows(want, TYPED)
    want = whole.select("k", "j", *[F.expr(safe_get("v", p, d)).alias(n) for n, (p, d) in DEFAULTED.items()])
    assert rows(silver.defaulted_fields(table, "p`q", DEFAULTED), DEFAULTED) == rows(want, DEFAULTED)
    back = table.select("j", F.to_json("`p``q`").alias("b")).collect()
    assert [(r.j, r.b) for r in back if (r.j and json.loads(r.j)) != (r.b and json.loads(r.b))] == []


def test_the_scan_reads_the_named_fields_only(spark, tmp_path):
    path = written(spark, tmp_path)
    names = {n for f in (tmp_path / "t").glob("*.parquet") for n in (c.path for c in map(pq.ParquetFile(f).schema.column, range(len(pq.ParquetFile(f).schema))))}
    assert any(n.endswith("typed_value.d.typed_value.big.typed_value") for n in names)
    table = spark.read.parquet(path).drop("j")
    for df, fields in [(silver.typed_fields(table, "p`q", {"e": ("$.d.e", "string")}), "struct<0:string>"),
                       (silver.defaulted_fields(table, "p`q", {"e": ("d.e", "0")}), "struct<0:variant>")]:
        plan = plan_text(df)
        assert f"ReadSchema: struct<k:bigint,p`q:{fields}>" in plan.replace("``", "`"), plan
