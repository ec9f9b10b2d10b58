"""URL rules by a sort-merge range join over reversed host names, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creatorlake.llm.common import lower_ascii

ADDRESS = r"://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, ADDRESS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _key(name: Column) -> Column:
    """``a.example.org`` as ``org.example.a.``: subdomains follow their domain, and share it as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """What is active once the interval of a rule host opens: the rules of that host and of all that enclose it."""
    rules = rules.select(_key(lower_ascii(F.coalesce("host", F.lit("")))).alias("key"), F.coalesce("path", F.lit("")).alias("path"),
                         "action", F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("rule"))
    labels = F.split(F.substring(F.col("key"), F.lit(1), F.length("key") - 1), r"\.")
    opened = rules.select("key").distinct().withColumn("labels", labels)
    depth = F.sequence(F.lit(1), F.size("labels"))
    prefixes = opened.select(F.col("key").alias("at"), F.explode(depth).alias("n"), "labels")
    prefixes = prefixes.select("at", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("n")), "."), F.lit(".")).alias("key"))
    entry = F.struct(F.col("key"), F.col("path"), F.col("action"), F.col("rule"))
    return prefixes.join(rules, "key").groupBy("at").agg(F.collect_set(entry).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict, which replace columns of those names.

    A rule (host, path, action) fits its host and all subdomains where the url's path starts with the rule's.
    The longest rule, host and path together, wins; then the longer host, then ``block``. Without one
    the rule is null and the verdict ``default``. A null url, or one without ``://``, has an empty host and path.

    A rule's host is the interval of keys with its prefix. Pages and rule openings are sorted together by
    key; the last opening at or before a page carries the stack of all nested intervals open there, and those
    still open are the prefixes of the page's key. Pages of one top label are dealt over as many salted
    sweeps as there are shuffle partitions, each with the few rules of that label, so neither a hot host
    nor a hot domain lands in one task."""
    spark = pages.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    row = F.struct(*[pages[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)])
    addressed = pages.select(row.alias("page"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.xxhash64(*[
        pages[f"`{c}`"] for c in kept if c in ("page_id", "url")]).alias("hash"))
    keyed = addressed.withColumns({"key": _key(F.col("host")), "salt": F.pmod("hash", F.lit(salts)).cast("int")}).drop("hash")
    stacks = _stacks(rules).withColumnRenamed("at", "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    events = keyed.withColumn("opens", F.lit(1)).unionByName(stacks.withColumn("opens", F.lit(0)), allowMissingColumns=True)
    events = events.withColumn("top", F.substring_index("key", ".", 1))
    sweep = Window.partitionBy("top", "salt").orderBy("key", "opens").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("opens = 1")
    fits = F.filter("stack", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        F.length(r["rule"]).alias("length"), F.length(r["key"]).alias("host"), (r["action"] == "block").alias("block"),
        r["rule"].alias("rule"), r["action"].alias("action"))))
    swept = swept.withColumn("best", best)
    return swept.select(*[F.col(f"page.c{i}").alias(c) for i, c in enumerate(kept)], "host", "path", F.col("best.rule").alias("rule"),
                        F.coalesce("best.action", F.lit(default)).alias("verdict"))
