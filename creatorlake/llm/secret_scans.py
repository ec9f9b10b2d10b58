"""Secret scans over an incremental ledger of content-addressed texts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.session import new_staging_path, stage

#: Kind, pattern, group whose length counts, least length; in the order of the report. The patterns are
#: fixed values. Hex and access runs are greedy, so their least length can stand in the pattern itself:
#: a run is found from its start or not at all. That of an assignment can't: a short value still uses up its text.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
RULE_VERSION = "base-1"
SPANS = "array<struct<start: int, kind: int, end: int>>"
#: Matches of a text handled as one list: what a step appends to stays short however many a text has.
BLOCK = 256


def _blocks(items):
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK))
    return F.transform(starts, lambda at: F.slice(items, at + 1, F.lit(BLOCK)))


def _spans(order: int, pattern: str, group: int, least: int):
    """Matches as (start, kind, end) in code points. Text between matches comes from a split at the same
    pattern, so each match begins where the lengths so far end."""
    text, p = F.col("text"), F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group))
    sizes = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"),
                         F.transform(value, F.length).alias("value"))
    none = F.array().cast(SPANS)

    def step(seen, m):
        at = seen["at"] + m["gap"]
        span = F.struct(at.alias("start"), F.lit(order).alias("kind"), (at + m["size"]).alias("end"))
        return F.struct((at + F.coalesce(m["size"], F.lit(0))).alias("at"),
                        F.when(m["value"] >= least, F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"]).alias("spans"))

    def block_step(seen, block):
        start = F.struct(seen["at"].alias("at"), none.alias("spans"))
        return F.aggregate(block, start, step, lambda s: F.struct(s["at"].alias("at"), F.concat(seen["spans"], s["spans"]).alias("spans")))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    # As an element of a list the matches are found once, then cut.
    found = F.transform(F.array(sizes), lambda m: F.aggregate(_blocks(m), start, block_step, lambda s: s["spans"]))
    return F.when(text.rlike(pattern), F.get(found, 0)).otherwise(none)


def versions(paths: DataFrame) -> DataFrame:
    """``paths`` with ``blob``, the SHA-256 of each text; a null text is an empty one."""
    return paths.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))


def scan(blobs: DataFrame) -> DataFrame:
    """Findings per blob and rule version: (blob, rule_version, spans by start, then kind)."""
    found = F.concat(*[_spans(k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(RULES)])
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.sort_array(found).alias("spans"))


def read_ledger(spark, path: str) -> DataFrame:
    return spark.read.schema(f"blob string, rule_version string, spans {SPANS}").parquet(path)


def update_ledger(paths: DataFrame, path: str, first: bool = False) -> DataFrame:
    """Scan the blobs of ``paths`` that the ledger at ``path`` has not seen under this rule version, append
    them, and return the ledger. ``first``: there is no ledger yet.

    Copies combine before the shuffle, at most one text per blob and task, and are one row before they meet the ledger,
    so no blob is hot. Two writers at once may scan a blob twice; readers take one finding of each."""
    spark = paths.sparkSession
    texts = versions(paths.select(F.coalesce("text", F.lit("")).alias("text"))).dropDuplicates(["blob"])
    if not first:
        seen = read_ledger(spark, path).where(F.col("rule_version") == RULE_VERSION).select("blob")
        texts = texts.join(seen, "blob", "left_anti")
    scan(texts).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def known_findings(ledger: DataFrame) -> DataFrame:
    """One row per blob with findings, written: a join with it can split a blob that very many paths have, which it
    could not beside the aggregate itself."""
    found = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).dropDuplicates(["blob"])
    return stage(found.select("blob", F.col("spans").alias("known")), "findings")


def find(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """``paths`` with ``spans``, what the ledger has of each text: no spans is an empty list.

    Null and empty texts have none; repeated rows and paths of the same blob each get their findings; an
    existing column of that name is replaced. Only blobs with findings are joined."""
    kept = [c for c in paths.columns if c.lower() != "spans"]
    row = F.struct(*[paths[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)])
    addressed = paths.select(row.alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    joined = addressed.join(known_findings(ledger), "blob", "left")
    return joined.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], F.coalesce("known", F.array().cast(SPANS)).alias("spans"))


def new_ledger_path(spark) -> str:
    return new_staging_path(spark, "ledger")


def kind_name(kind):
    return F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), kind + 1)


def redact(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``found`` (from ``find``) with every span of its text replaced by ``mark``; overlapping spans merge."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def block_step(seen, block):
        base = seen["at"]
        # The stretch of the text that the block's spans lie in: each span is then cut from little text.
        stop = F.greatest(base, F.array_max(F.transform(block, lambda x: x["end"])))
        start = F.struct(base.alias("at"), F.substr("text", base + 1, stop - base).alias("part"), F.lit("").alias("text"))

        def step(s, x):
            # Text up to the span, then the mark, unless the span begins inside the one before.
            inside = x["start"] < s["at"]
            more = F.when(inside, F.lit("")).otherwise(F.concat(F.substr(s["part"], s["at"] - base + 1, x["start"] - s["at"]), F.lit(mark)))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["part"].alias("part"), F.concat(s["text"], more).alias("text"))

        return F.aggregate(block, start, step, lambda s: F.struct(s["at"].alias("at"), F.concat(seen["text"], s["text"]).alias("text")))

    whole = F.aggregate(_blocks(F.col("spans")), state, block_step, lambda s: F.concat(s["text"], F.substr("text", s["at"] + 1)))
    return found.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))
