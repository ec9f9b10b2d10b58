"""Repeated passages from sparse suffixes: only those at content-selected minimisers are kept, matched and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.llm.common import Rolling, chunks, utf8, word_spans
from creatorlake.session import stage

#: Least length of a repeated passage, and of the word stretch whose hash selects a suffix.
PASSAGE, GRAM = 50, 8
BYTES, WORDS = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _letters() -> np.ndarray:
    """Bytes of words: digits, letters with A-Z lowered and all of non-ASCII characters; others are 0."""
    to = np.zeros(256, np.uint8)
    to[48:58] = np.arange(48, 58)
    to[97:123] = np.arange(97, 123)
    to[65:91] = np.arange(97, 123)
    to[128:] = np.arange(128, 256)
    return to


def _sliding(values: np.ndarray, width: int, better) -> np.ndarray:
    """``better`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = better(out[:-step], out[step:])
        have += step
    return out


class Suffixes:
    """Word hashes of a chunk of texts, and the least gram hash of every window of a passage's length."""

    def __init__(self, passage: int, gram: int):
        self.passage, self.gram = passage, gram
        self.letters, self.of_bytes, self.of_words = _letters(), Rolling(BYTES), Rolling(WORDS)

    def read(self, data: np.ndarray, offsets: np.ndarray):
        folded = self.letters[data]
        starts, ends, self.first = word_spans(folded > 0, offsets)
        self.words = self.of_bytes(folded, starts, ends)
        n, grams = len(self.words), self.passage - self.gram + 1
        self.windows = np.zeros(0, bool)
        if n < self.passage:
            return self
        at = np.arange(n - self.gram + 1)
        self.grams = self.of_words(self.words, at, at + self.gram) | np.uint64(1)
        self.least = _sliding(self.grams, grams, np.minimum)
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        start = np.arange(len(self.least))
        self.windows = start + self.passage <= row_end[start]
        return self

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of minimisers: least of some window inside their text, all of them where several tie."""
        if not self.windows.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        width = self.passage - self.gram + 1
        valid = np.where(self.windows, self.least, np.uint64(0))
        edge = np.zeros(width - 1, np.uint64)
        most = _sliding(np.concatenate([edge, valid, edge]), width, np.maximum)
        at = np.flatnonzero(most == self.grams)
        return at, self.grams[at]


def _anchors(text, passage: int, gram: int):
    @F.arrow_udf("struct<n_words: long, anchors: array<long>>")
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        suffixes = Suffixes(passage, gram)
        for column in columns:
            data, offsets = utf8(column)
            words, sizes, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for a, b in chunks(offsets):
                suffixes.read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at, found = suffixes.anchors()
                words.append(np.diff(suffixes.first))
                sizes.append(np.diff(np.searchsorted(at, suffixes.first)))
                held.append(found)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(held).view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(words)), lists], ["n_words", "anchors"])

    return of(text)


def _passages(texts: DataFrame, passage: int, gram: int) -> DataFrame:
    """(passage, node, start) of every window whose minimiser is one of the row's ``anchors``."""

    def extend(batches):
        suffixes = Suffixes(passage, gram)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            nodes, anchors = batch.column("node").to_numpy(), batch.column("anchors")
            for a, b in chunks(offsets):
                suffixes.read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not suffixes.windows.any():
                    continue
                first, starts = suffixes.first, []
                for row in range(a, b):
                    low, high = first[row - a], min(first[row - a + 1], len(suffixes.windows))
                    wanted = anchors[row].values.to_numpy().view(np.uint64)
                    at = np.flatnonzero(np.isin(suffixes.least[low:high], wanted) & suffixes.windows[low:high]) + low
                    starts.append(at)
                at = np.concatenate(starts)
                row = np.searchsorted(first, at, "right") - 1
                held = suffixes.of_words(suffixes.words, at, at + passage)
                yield pa.RecordBatch.from_pydict({"passage": held.view(np.int64), "node": nodes[a + row],
                                                  "start": (at - first[row]).astype(np.int32)})

    return texts.select("node", "text", "anchors").mapInArrow(extend, "passage long, node long, start int")


def _merged(starts, passage: int):
    """Windows as stretches: sorted starts into (start, end) wherever the next window begins beyond the last one's end."""

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def of(column: pa.Array) -> pa.Array:
        lists = []
        for row in column:
            p = np.sort(row.values.to_numpy()) if row.is_valid and len(row.values) else np.zeros(0, np.int64)
            cut = np.flatnonzero(np.diff(p) > passage)
            if len(p):
                begin, end = p[np.concatenate([[0], cut + 1])], p[np.concatenate([cut, [-1]])] + passage
                lists.append([{"start": int(s), "end": int(e)} for s, e in zip(begin, end)])
            else:
                lists.append([])
        return pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return of(starts)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` with repeated passages: doc_id, n_words, spans, removable.

    ``spans`` are the stretches (start, end, in words) made of windows of ``passage`` words that occur at least
    twice anywhere, in one text or several; ``removable`` those made of windows with an earlier occurrence, by
    smallest doc_id of the text, then place. Words are digits, letters and non-ASCII characters, A-Z lowered.

    A suffix is retained where its first ``gram`` words hash lowest in some window, so equal windows retain
    suffixes at the same place. Suffixes whose first words occur once are done with; around each of the others, every
    window it is the minimiser of is compared, left and right of it, by a 64-bit hash of all its words, and
    neighbouring windows join into maximal stretches. A sort that compares each suffix with its two neighbours only
    would lose a passage that longer ones interleave: a partner that agrees on fewer words to the right and on more
    to the left need not be next to it. Equal texts are one node and repeat as a whole. Counts combine before
    shuffles and are written before they are joined, so that joins split a hot hash. Texts that are null or shorter
    than a passage have no row, nor has an empty table."""
    blob = F.md5(F.coalesce("text", F.lit("")))
    marked = docs.select("doc_id", blob.alias("blob"), _anchors(F.col("text"), passage, gram).alias("found"))
    marked = stage(marked.select("doc_id", "blob", "found.*"), "suffixes")
    classes = marked.groupBy("blob").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"),
                                         F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors"))
    classes = stage(classes.where(F.col("n_words") >= passage).withColumn("node", F.monotonically_increasing_id()), "classes")
    suffixes = classes.select("node", F.explode("anchors").alias("anchor"))
    shared = stage(suffixes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    wanted = suffixes.join(shared, "anchor").groupBy("node").agg(F.collect_set("anchor").alias("anchors"))
    wanted = classes.select("node", "blob").join(wanted, "node")
    texts = docs.select(blob.alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    windows = stage(_passages(texts.join(wanted, "blob"), passage, gram), "windows")

    order = windows.join(classes.select("node", "first"), "node")
    earliest = F.min(F.struct("first", "node", "start")).alias("earliest")
    again = stage(order.groupBy("passage").agg(F.count("*").alias("n"), earliest).where("n > 1").drop("n"), "passages")
    hits = windows.join(again, "passage").groupBy("node").agg(
        F.collect_list("start").alias("starts"),
        F.collect_list(F.when((F.col("node") != F.col("earliest.node")) | (F.col("start") != F.col("earliest.start")), F.col("start"))).alias("later"))
    hits = hits.select("node", _merged(F.col("starts"), passage).alias("spans"), _merged(F.col("later"), passage).alias("removable"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    found = classes.select("node", "blob", "copies", "first", "n_words").join(hits, "node", "left")
    found = found.where("copies > 1 OR spans IS NOT NULL")
    empty = F.array().cast("array<struct<start: int, end: int>>")
    found = found.select("blob", "copies", "first", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans"),
                         F.coalesce("removable", empty).alias("removable"), whole.alias("whole"))
    rows = marked.select("doc_id", "blob", "n_words").join(found, "blob")
    # All copies but one of the smallest id can go as a whole; which, if ids repeat, is left to the caller.
    copy = (F.col("copies") > 1) & ~F.col("doc_id").eqNullSafe(F.col("first"))
    return rows.select("doc_id", "n_words", "spans", F.when(copy, F.col("whole")).otherwise(F.col("removable")).alias("removable"))
