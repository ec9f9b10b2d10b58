"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creatorlake.llm.common import lower_ascii
from creatorlake.session import stage

SPAN, GRAM = 10, 5
#: Windows that begin in one block of a text: what is exploded per window is a block, whatever the text's length.
BLOCK = 256
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark windows up to which their table is broadcast: some 200 bytes each, so about 40 MB.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters of the text with A-Z lowered; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def _minima(span: int, gram: int) -> str:
    """SQL for the least hash of the ``gram``-word stretches in each window of ``span`` words."""
    per_window = span - gram + 1
    return f"""IF(n_words >= {span}, transform(sequence(1, size(grams) - {per_window - 1}),
        i -> array_min(slice(grams, i, {per_window}))), array())"""


def _grams(length: int, least: int, most: str | None = None) -> str:
    stop = f"n_words - {length - 1}"
    stop = f"least({most}, {stop})" if most else stop
    return f"""IF(n_words >= {least}, transform(sequence(1, {stop}), i -> xxhash64(slice(words, i, {length}))), array())"""


def benchmark_windows(benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Every window of ``span`` words of every item, (fingerprint, length, win, item_id); an item of fewer
    words, but not none, is one window and its own fingerprint."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).withColumn("n_words", F.size("words")).where("n_words > 0")
    long = items.where(F.col("n_words") >= span).withColumn("grams", F.expr(_grams(gram, span)))
    long = long.select("item_id", "words", F.posexplode(F.expr(_minima(span, gram))).alias("pos", "fingerprint"))
    long = long.select("fingerprint", F.lit(span).alias("length"), F.expr(f"slice(words, pos + 1, {span})").alias("win"), "item_id")
    short = items.where(F.col("n_words") < span)
    short = short.select(F.xxhash64("words").alias("fingerprint"), F.col("n_words").alias("length"), F.col("words").alias("win"), "item_id")
    return long.unionByName(short).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, spans (hit stretches as start, end in words) and items.

    Winnowing: a window's fingerprint is the least hash of its ``gram``-word stretches. Equal windows have
    equal fingerprints, so every shared span of ``span`` words or more gives a match; the words of
    matched windows are then compared, and overlapping or touching windows grow into one stretch. Items shorter
    than a window are matched whole, by a hash of all their words.

    Null and wordless texts have no words and no hits; wordless items match nothing; an item without an id
    marks words but is not listed. Repeated rows come back repeated: rows are told apart by their place.
    A text is cut into overlapping blocks before its windows are listed, so work is linear in its length.
    One row per block carries the counts through the join, so texts are read once, and only
    counts and hits are shuffled; no group is larger than one document's windows."""
    windows = stage(benchmark_windows(benchmark, span, gram), "windows")
    lengths = sorted(r[0] for r in windows.where(F.col("length") < span).select("length").distinct().collect())
    keyed = docs.select("doc_id", "text").withColumns({"row": F.monotonically_increasing_id(), "text_hash": F.xxhash64("text")})
    worded = keyed.select("doc_id", "row", "text_hash", words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    # Blocks overlap by a window less one word, so that every window lies inside the block it begins in.
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_words") - 1), F.lit(BLOCK))
    block = F.transform(blocks, lambda at: F.struct(at.alias("at"), F.slice("words", at + 1, F.lit(BLOCK + span - 1)).alias("words")))
    worded = worded.select("doc_id", "row", "text_hash", F.col("n_words").alias("doc_words"), F.explode(block).alias("block"))
    worded = worded.select("doc_id", "row", "text_hash", "doc_words", "block.at", "block.words", F.size("block.words").alias("n_words"))
    worded = worded.withColumn("grams", F.expr(_grams(gram, span)))
    parts = [F.expr(_minima(span, gram))] + [F.expr(_grams(n, n, str(BLOCK))) for n in lengths]
    # The last entry, without a fingerprint, stands for the document itself.
    worded = worded.select("doc_id", "row", "text_hash", "doc_words", "at", "n_words", "words",
                           F.posexplode(F.concat(*parts, F.array(F.lit(None).cast("long")))).alias("pos", "fingerprint"))
    start, length, offset = F.lit(None), F.lit(None), F.lit(0)
    bounds = []
    for n in [span, *lengths]:
        count = F.least(F.lit(BLOCK), F.greatest(F.col("n_words") - (n - 1), F.lit(0)))
        bounds.append((offset, offset + count, n))
        offset = offset + count
    for low, high, n in reversed(bounds):
        start = F.when(F.col("pos") < high, F.col("pos") - low).otherwise(start)
        length = F.when(F.col("pos") < high, F.lit(n)).otherwise(length)
    entries = worded.withColumns({"inside": start.cast("int"), "span": length.cast("int")})
    entries = entries.withColumn("start", F.col("at") + F.col("inside"))
    side = windows.select(F.col("fingerprint").alias("f"), "length", "win", "item_id", F.lit(True).alias("hit"))
    if windows.count() <= BROADCAST_WINDOWS:
        side = F.broadcast(side)
        here = "slice(words, inside + 1, span)"
    else:
        entries = entries.withColumn("words", F.expr("slice(words, inside + 1, span)"))
        here = "words"
    # As a pair of inequalities the word check is no join key, and is evaluated for equal fingerprints only.
    same = F.expr(f"fingerprint = f AND span = length AND {here} <= win AND {here} >= win")
    found = entries.join(side, same, "left").where("hit OR fingerprint IS NULL")
    found = found.groupBy("row", "doc_id", "text_hash").agg(
        F.max("doc_words").alias("n_words"),
        F.collect_set(F.when(F.col("hit"), F.struct(F.col("start"), (F.col("start") + F.col("span")).alias("end")))).alias("windows"),
        F.collect_set("item_id").alias("items"))
    # Windows of unlike lengths nest, so stretches are read from the hit words, not from the windows.
    hit = F.sort_array(F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["start"], w["end"] - 1)))))
    spans = F.transform(F.array(hit), lambda at: F.arrays_zip(
        F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) < x - 1)),
        F.transform(F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) > x + 1, F.lit(True))), lambda x: x + 1)))
    spans = F.get(spans, 0).cast("array<struct<start: int, end: int>>")
    return found.select("doc_id", "text_hash", "n_words", spans.alias("spans"), "items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` no benchmark window occurs in, all columns kept. A verdict depends on the text
    alone, so rows are matched by id and text hash, nulls too."""
    hit = contamination(docs, benchmark).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left_anti")
