"""Helpers shared by the operators: table reads, held-out rows, Arrow text, word hashes, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creatorlake.session import stage

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case. ``lower`` does the same, faster, where all bytes are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, *LOWER))


def held_out(doc_id: Column) -> Column:
    """True for rows no model may learn from; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    offset_type = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, offset_type)[column.offset : column.offset + n + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least: bounds the working arrays of a batch."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def slices(offsets: np.ndarray, lap: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray]]:
    """Like ``chunks``, but longer rows are cut: (first row, last row, offsets within the data). Each further cut of a row
    begins ``lap`` bytes before the last one's end."""
    for first, last in chunks(offsets, limit):
        start, end = int(offsets[first]), int(offsets[last])
        if end - start <= limit + lap:
            yield first, last, offsets[first : last + 1]
            continue
        for at in range(start, max(end - lap, start + 1), limit):
            yield first, last, np.array([at, min(at + limit + lap, end)])


def per_row(rows: int, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's stretch, which begins at ``starts`` and may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    bounds = np.append(starts[:rows], len(values))
    return total[bounds[1:]] - total[bounds[:-1]]


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each run of word bytes that stays inside its row, and each row's first word."""
    edge = np.zeros(len(is_word) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(is_word)
    before[:1] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.zeros_like(is_word)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Rolling:
    """Hashes of substrings by prefix sums modulo 2^64: equal content hashes alike wherever it stands."""

    def __init__(self, base: int):
        self.base = base | 1
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 1 << 12)
            self.up = np.full(size, self.base, np.uint64)
            self.down = np.full(size, pow(self.base, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def __call__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.up[: len(symbols)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (multiply and shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def forest(a: np.ndarray, b: np.ndarray, near: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what ``near`` connects: at most one less than the nodes, whatever its density.
    ``same``: both sides are one tile, and ``near`` is upper triangular."""
    i, j = np.nonzero(near)
    if len(i) <= len(a) + len(b):
        return a[i], b[j]
    left, right = [], []
    seen_a, seen_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if same:
        near = near | near.T
        seen_b = seen_a
    for start in np.flatnonzero(near.any(1)):
        if seen_a[start]:
            continue
        seen_a[start] = True
        todo = [(True, start)]
        while todo:
            on_left, k = todo.pop()
            row, seen = (near[k], seen_b) if on_left else (near[:, k], seen_a)
            new = np.flatnonzero(row & ~seen)
            if len(new):
                seen[new] = True
                left.append(np.full(len(new), a[k] if on_left else b[k]))
                right.append((b if on_left else a)[new])
                todo += [(not on_left or same, x) for x in new]
    return np.concatenate(left), np.concatenate(right)


def to_least(both: DataFrame, least: DataFrame) -> DataFrame:
    """Larger neighbours tied to the least node that their smaller end knows."""
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every linked node: rows (node, root), roots themselves left out.

    ``edges`` has columns a and b. Alternating large and small stars: a node ties its larger neighbours to
    the smallest node it knows, then its parents to the least of them, until nothing changes. No group is
    gathered: minima combine before the shuffle, and are written before they are joined, as Spark splits a hot
    node's neighbours only where both sides of a join come straight from their exchanges. A lost executor repeats
    tasks of one step."""
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now, seen = stage(ordered, "links"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stage(to_least(both, least).distinct(), "large")
        parent = stage(large.groupBy("u").agg(F.min("v").alias("m")), "parent")
        small = large.join(parent, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.union(parent.select("u", F.col("m").alias("v"))).distinct(), "links")
