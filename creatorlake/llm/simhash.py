"""SimHash near-duplicates: 64-bit fingerprints, compared tile by tile with exclusive-or and bit counts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.llm.common import chunks, components, forest, utf8, word_spans
from creatorlake.session import stage

SEED = 42
BLOCKS, BLOCK_BITS = 4, 16
TILE = 4096


def _lanes() -> np.ndarray:
    """Each byte value with its bits spread over eight bytes, so that sums of up to 255 of them never carry."""
    v = np.arange(256, dtype=np.uint64)
    return sum(((v >> np.uint64(j)) & np.uint64(1)) << np.uint64(8 * j) for j in range(8))


def _fingerprint_chunk(data: np.ndarray, offsets: np.ndarray, words: int, lanes: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends, first = word_spans((data != 32) & ((data < 9) | (data > 13)), offsets)
    count = np.diff(first)
    if not len(starts):
        return np.zeros(n, np.uint64)
    # One space between the words of a row, nothing else: a shingle is then one stretch of bytes.
    inner = np.ones(len(starts), bool)
    inner[first[1:][count > 0] - 1] = False
    length = ends - starts + 1
    begin = np.cumsum(length) - length
    keep = (data != 32) & ((data < 9) | (data > 13))
    keep[ends[inner]] = True
    data[ends[inner]] = 32
    gaps = np.cumsum(~inner) - ~inner  # no separator follows the last word of a row
    text = data[keep].tobytes()
    begin = begin - gaps
    stop = begin + ends - starts
    kinds = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    at = np.cumsum(kinds) - kinds
    row = np.repeat(np.arange(n), kinds)
    word = first[row] + np.arange(len(row)) - at[row]
    last = np.minimum(word + words, first[row + 1]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(text[a:b], SEED) for a, b in zip(begin[word].tolist(), stop[last].tolist())], np.uint64, len(row))
    # Sums of at most 255 shingles in byte lanes, then of those sums per row.
    step = np.arange(len(row)) - at[row]
    cut = np.flatnonzero(step % 255 == 0)
    votes = np.zeros((n, 64), np.int64)
    filled = kinds > 0
    parts = np.searchsorted(cut, at[filled])
    for lane in range(8):
        sums = np.add.reduceat(lanes[(h >> np.uint64(8 * lane)) & np.uint64(255)], cut)
        votes[filled, 8 * lane : 8 * lane + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), parts, axis=0)
    set_bits = (2 * votes > kinds[:, None]).astype(np.uint64)
    return (set_bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def fingerprints(docs: DataFrame, words: int, name: str = "fingerprint") -> DataFrame:
    """``docs`` with ``name`` (a long) of their whole texts, a majority vote per bit over the XXH64 of
    every shingle of ``words`` words, repeats included. Texts without words, null ones too, have 0."""

    @F.arrow_udf("long")
    def fingerprint(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lanes = _lanes()
        for column in columns:
            data, offsets = utf8(column)
            found = [_fingerprint_chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, lanes)
                     for a, b in chunks(offsets)]
            yield pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))

    return docs.withColumn(name, fingerprint(F.col("text")))


def _compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    near = np.empty((len(a), len(b)), bool)
    for k in range(0, len(a), 256):
        np.less_equal(np.bitwise_count(a[k : k + 256, None] ^ b[None, :]), radius, out=near[k : k + 256])
    if same:
        near = np.triu(near, 1)
    return forest(a, b, near, same)


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect all those of ``distinct`` within ``radius`` bits.

    A fingerprint's cell holds the bit counts of its four 16-bit blocks. Flipping a bit moves one count by
    one, so only cells whose counts differ by ``radius`` or less in all are compared; all others are
    skipped. A cell is cut into tiles of about ``tile`` fingerprints by hash, and a tile pair yields a
    spanning forest of its links, never all of them: output is linear in what the tiles hold."""
    fp = F.col("fingerprint")
    # Counts sit in base 32 with room below and above, so that adding an offset never carries.
    counts = [F.bit_count(F.shiftrightunsigned(fp, BLOCK_BITS * k).bitwiseAND((1 << BLOCK_BITS) - 1)) + radius for k in range(BLOCKS)]
    base = BLOCK_BITS + 2 * radius + 1
    cell = sum((c.cast("int") * base**k for k, c in enumerate(counts)), F.lit(0))
    celled = distinct.select("fingerprint", cell.alias("cell"))
    # One row per cell: 17^4 at most, so it may be broadcast.
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("parts"))
    placed = celled.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("fingerprint"), "parts").cast("int"))
    tiles = stage(placed.groupBy("cell", "part").agg(F.collect_list("fingerprint").alias("held")), "tiles")
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=BLOCKS) if sum(map(abs, d)) <= radius]
    ahead = sorted(x for x in (sum(v * base**k for k, v in enumerate(d)) for d in steps) if x >= 0)
    left = tiles.select("cell", "part", F.col("held").alias("a"), F.explode(F.array(*map(F.lit, ahead))).alias("ahead"))
    left = left.select((F.col("cell") + F.col("ahead")).alias("cell"), F.col("part").alias("part_a"), "a", "ahead")
    pairs = left.join(tiles.withColumnRenamed("held", "b"), "cell").where("ahead > 0 OR part_a <= part")
    pairs = pairs.select("a", "b", F.expr("ahead = 0 AND part_a = part").alias("same"))

    def compare(batches):
        for batch in batches:
            sides = []
            for name in ("a", "b"):
                column = batch.column(name)
                sides.append((column.flatten().to_numpy().view(np.uint64), np.asarray(column.offsets) - column.offsets[0].as_py()))
            (a, at), (b, bt) = sides
            same = batch.column("same").to_pylist()
            found = [_compare(a[at[k] : at[k + 1]], b[bt[k] : bt[k + 1]], same[k], radius) for k in range(len(same))]
            x, y = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_pydict({"a": x, "b": y})

    return pairs.mapInArrow(compare, "a long, b long")


def _named(marked: DataFrame, radius: int) -> DataFrame:
    """Per fingerprint of ``marked``: (fingerprint, root, component_id)."""
    nodes = stage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    stars = components(links(nodes, radius))
    rooted = nodes.join(stars, F.col("fingerprint") == F.col("node"), "left")
    rooted = rooted.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.drop("first").join(named, "root")


def near_duplicates(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (long) and component_id, the smallest doc_id reachable over
    fingerprints ``radius`` or fewer bits apart.

    Rows with equal fingerprints are one node, so copies are never compared; repeated rows come back
    repeated. Null doc_ids belong to a component but do not name it (null if it has no other).
    Texts without words share fingerprint 0 and link like any other. An empty table gives no rows."""
    marked = stage(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fingerprint"), "fingerprints")
    # A hot fingerprint is split by adaptive skew handling: the other side has one row for it.
    return marked.join(_named(marked, radius), "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """One row of ``docs`` per component, all columns kept: the smallest doc_id, a null one only if there is no
    other; among rows that share it, any one of the smallest fingerprint."""
    marked = stage(fingerprints(docs, words, "_fingerprint"), "fingerprints")
    narrow = marked.select("doc_id", F.col("_fingerprint").alias("fingerprint"))
    # Least first in ascending order of (id is null, id, fingerprint): one row per component, combined before the shuffle.
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fingerprint"))).alias("best")
    rooted = narrow.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    kept = rooted.join(_named(narrow, radius).select("fingerprint", "root"), "fingerprint").groupBy("root").agg(best)
    kept = kept.select(F.col("best.doc_id").alias("_id"), F.col("best.fingerprint").alias("_kept"))
    chosen = marked.join(kept, (F.col("_fingerprint") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return chosen.dropDuplicates(["_fingerprint", "doc_id"]).drop("_fingerprint")
