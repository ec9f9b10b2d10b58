"""One query per operator: its production parameters over its whole table, cut to the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creatorlake.llm import (
    decontaminate, html_text, language_id, oracles, packing, periodic, quality, resharding, secret_scans, simhash, suffixes, url_filter,
    vectors, whitening,
)
from creatorlake.llm.common import held_out, may_learn, table
from creatorlake.llm.registry import query


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(may_learn(F.col("doc_id"))))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query(oracles.DECONTAMINATION)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query(oracles.SECRETS)
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # One ledger over two sources: what the first has put there is not scanned again for the second.
    path = secret_scans.new_ledger_path(spark)
    secret_scans.update_ledger(table(spark, sf_dir, "benchmark").select("text"), path, first=True)
    found = secret_scans.find(docs, secret_scans.update_ledger(docs, path)).select("doc_id", "spans")

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{rule[0]}") for k, rule in enumerate(secret_scans.RULES)]
    listed = F.transform("spans", lambda s: F.concat_ws(":", secret_scans.kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    found = found.select("doc_id", *counts, F.array_join(listed, ",").alias("spans"))
    return found.withColumn("base_sha256", F.sha2("spans", 256))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.plan(packing.tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


#: The rules of the contract: host, path, action.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query(oracles.URLS)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    found = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(may_learn(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


OLD_SHARDS, SHARDS = 32, 40


@query()
def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resharding.sized(table(spark, sf_dir, "documents"), OLD_SHARDS)
    found = resharding.reshard(rows, [1.0] * SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query()
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"), passage=50)

    def words(spans: str):
        return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", "n_words", words("spans").alias("n_repeated"), listed("spans").alias("spans"),
                        words("removable").alias("n_removable"), listed("removable").alias("removable"))


def _cycled(doc_id, text):
    """The contract's texts: of one document in ten the words from the a-th on repeat the p words there."""
    held = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+", -1)
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cycle(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # As an element of a list the words are split once.
    cycled = F.get(F.transform(F.array(held), cycle), 0)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), cycled).otherwise(text)


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.runs(docs.select("doc_id", _cycled(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", periodic.best().alias("best"), F.array_join(lines, "").alias("lines"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query()
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars", "n_blocks")
