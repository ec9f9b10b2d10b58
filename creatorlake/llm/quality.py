"""Quality scores by Bradley-Terry pairwise ranking over features of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.llm.common import Rolling, chunks, per_row, utf8, word_spans
from creatorlake.session import stage

#: Labelled rows of a cell, on average: inside one, every row is compared with every row of unlike label.
CELL = 1024
PASS = 0.7
BASE = 0x9E3779B97F4A7C15
#: Byte classes counted per word: upper and lower case, digits, sentence marks, table bars, exclamation marks,
#: other ASCII signs, line ends, bytes of non-ASCII letters.
CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:?'\"()-", b"|", b"!", b"#$%&*+/<=>@[\\]^_`{}~", b"\n", bytes(range(128, 256))]


def _class_table() -> np.ndarray:
    to = np.full(256, len(CLASSES), np.uint8)
    for k, held in enumerate(CLASSES):
        to[np.frombuffer(held, np.uint8)] = k
    return to


def features(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> np.ndarray:
    """A row of numbers per text: shares of byte classes, repeated neighbouring words, word and line lengths.

    Shares enter as they are and as logarithms, so that a few junk bytes and many both show. An
    empty text has zeros."""
    n = len(offsets) - 1
    kind = _class_table()[data]
    starts, ends, first = word_spans((data != 32) & ((data < 9) | (data > 13)), offsets)
    words = np.diff(first).astype(float)
    per_word = np.maximum(words, 1)[:, None]
    counts = np.stack([per_row(n, offsets[:-1], kind == k) for k in range(len(CLASSES))], 1)
    held = rolling(data, starts, ends)
    again = [np.zeros(len(held)) for _ in range(3)]
    for lag, seen in enumerate(again, 1):
        seen[lag:] = held[lag:] == held[:-lag]
    repeats = per_row(n, first[:-1], np.stack(again, 1))
    bytes_ = np.maximum(np.diff(offsets), 1)[:, None]
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)[:, None]
    shares = np.hstack([counts / per_word, repeats / per_word, counts[:, :1] / letters, counts[:, 6:7] / bytes_])
    return np.hstack([shares, np.log1p(100 * shares), np.log1p(words)[:, None], np.log1p(bytes_ / per_word)])


@dataclass
class Model:
    weights: np.ndarray
    offset: float
    taught: int = 0


def _featured(text):
    @F.arrow_udf("array<double>")
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rolling = Rolling(BASE)
        for column in columns:
            data, offsets = utf8(column)
            rows = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rolling) for a, b in chunks(offsets)]
            flat = np.concatenate(rows) if rows else np.zeros((0, 1))
            at = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(flat.ravel()))

    return of(text)


def _pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over all pairs of a good and a bad row: their number, the slope and the curvature of the Bradley-Terry loss, in one row."""
    lost = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None], -30, 30)))
    held = lost * (1 - lost)
    mixed = good.T @ held @ bad
    curve = good.T @ (good * held.sum(1)[:, None]) + bad.T @ (bad * held.sum(0)[:, None]) - mixed - mixed.T
    return np.concatenate([[float(lost.size)], lost.sum(1) @ good - lost.sum(0) @ bad, curve.ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], size: int, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of least mean loss with a small ridge, from sums over pairs at given weights."""
    w = np.zeros(size)
    for _ in range(rounds):
        held = sums(w)
        if not held[0]:
            break
        slope = held[1 : size + 1] / held[0] - ridge * w
        step = np.linalg.solve(held[size + 1 :].reshape(size, size) / held[0] + ridge * np.eye(size), slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def rank(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Bradley-Terry weights: the better of a pair wins with probability 1 / (1 + exp(-w . (x_better - x_worse))).
    Logistic loss over all pairs of unlike labels, by Newton's method."""
    return _newton(lambda w: _pair_sums(x[label == 1], x[label == 0], w), x.shape[1])


def _matrix(rows: pa.ListScalar, size: int) -> np.ndarray:
    return rows.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums_over(cells: DataFrame, middle: np.ndarray, scale: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The sums over the pairs of all cells (good, bad), at given weights: one row of sums a task, added up by Spark."""
    size = len(middle)

    def at(w: np.ndarray) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + size * size)
            for batch in batches:
                for good, bad in zip(batch["good"], batch["bad"]):
                    total += _pair_sums(*[(_matrix(rows, size) - middle) / scale for rows in (good, bad)], w)
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

        added = cells.mapInArrow(summed, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("sum"))
        return np.array([r["sum"] for r in sorted(added.collect(), key=lambda r: r["pos"])])

    return at


def order_statistic(values: DataFrame, place: int, bins: int = 1000) -> float:
    """The value at a place (from 0) of the sorted column ``v``, exactly: counts per bin, then per bin of the bin that holds it."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        # The share is below one where v is below the upper end, which has a bin of its own.
        bin_ = F.floor((F.col("v") - low) / (high - low) * bins)
        held = values.where(F.col("v").between(low, high)).groupBy(F.when(F.col("v") == high, bins).otherwise(F.least(bin_, F.lit(bins - 1))).alias("bin"))
        for row in sorted(held.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["bin"]):
            if place < row["n"]:
                low, high = row["low"], row["high"]
                break
            place -= row["n"]
    return float(low)


def fit(docs: DataFrame, labels: DataFrame, cell: int = CELL) -> Model:
    """Learn from the documents (doc_id, text) of all labelled rows (doc_id, label).

    Labelled rows are dealt into random cells of some ``cell`` rows; all pairs of unlike labels in a cell are compared, so every
    row teaches, the work grows with the rows, and up to ``cell`` rows are all pairs there are. Features are shuffled, not
    texts. The score of the quantile at which the labelled zeros would end becomes PASS, so that as large a share of
    documents passes as is labelled 1. Rows with null ids or labels teach nothing; with one label only, nothing is
    learnt and all documents score alike."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select("doc_id", "label").distinct()
    # An id that many documents share teaches once; both sides have few rows an id, so none is hot.
    found = docs.select("doc_id", _featured(F.col("text")).alias("x")).groupBy("doc_id").agg(F.min("x").alias("x"))
    taught = stage(found.join(known, "doc_id"), "taught")
    total, zeros, ones = taught.agg(F.count("*"), F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    if not zeros or not ones:
        return Model(np.zeros(1), 0.0, total)
    spread = taught.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("middle"), F.stddev_pop("col").alias("scale"))
    spread = sorted(spread.collect(), key=lambda r: r["pos"])
    middle, scale = (np.array([r[k] for r in spread]) for k in ("middle", "scale"))
    scale += 1e-9
    cells = taught.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(-(-total // cell))).alias("cell")).agg(
        *[F.collect_list(F.when(F.col("label") == k, F.col("x"))).alias(name) for name, k in (("good", 1), ("bad", 0))])
    w = _newton(_sums_over(stage(cells, "cells"), middle, scale), len(middle)) / scale

    @F.arrow_udf("double")
    def raw(x: pa.Array) -> pa.Array:
        return pa.array((x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w)) * w).sum(1))

    values = stage(taught.select(raw("x").alias("v")), "raw")
    cut = (order_statistic(values, zeros - 1) + order_statistic(values, zeros)) / 2
    return Model(w, float(np.log(PASS / (1 - PASS)) - cut), total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` in 0..1 and ``predicted`` (score >= PASS), which replace columns of those names.

    Whole texts, null ones as empty, each scored from its own bytes: repeated rows score alike, and no row moves."""

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rolling = Rolling(BASE)
        for column in columns:
            data, offsets = utf8(column)
            raw = [np.zeros(0)]
            for a, b in chunks(offsets):
                x = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rolling)
                raw.append((x * model.weights).sum(1) + model.offset)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(raw), -30, 30))))

    return docs.withColumn("score", scored(F.col("text"))).withColumn("predicted", (F.col("score") >= PASS).cast("int"))
