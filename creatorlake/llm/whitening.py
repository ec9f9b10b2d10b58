"""Whitening of embeddings: eigenvectors in single precision, refined by matrix products in higher precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.session import stage

#: Vector components become whole numbers of this many steps a unit.
STEPS = 256
#: Rows whose products are summed at once.
BLOCK = 4096
WIDE = np.longdouble
ROUNDS = 60


def quantised(vectors: DataFrame, column: str = "embedding", steps: int = STEPS) -> DataFrame:
    """Rows of ``vectors`` with ``x``, floor(steps * component) as whole numbers, an existing column of that name replaced.

    Left out are rows whose vector is null, empty or holds null, NaN or infinite entries, and those whose length
    is not that of most rows (of equally common lengths the longer counts)."""
    held = F.col(f"`{column}`")
    whole = F.forall(held, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(held.isNotNull() & (F.size(held) > 0) & F.coalesce(whole, F.lit(False)))
    sizes = kept.groupBy(F.size(held).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    x = F.transform(held, lambda c: F.floor(c.cast("double") * float(steps)))
    return kept.where(F.size(held) == size).withColumn("x", x)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _products(y: np.ndarray) -> np.ndarray:
    """The exact sum of outer products of whole numbers: by doubles where no sum can pass 2^53, else by big integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = y.astype(object)
    return big.T @ big


def _summed(x: DataFrame, cells) -> dict[tuple[int, int], int]:
    """Sums over all rows of the (i, j, value) that ``cells`` makes of blocks of rows: one row a cell and task is
    shuffled, and as many cells as the dimension squared reach the driver. Sums hold up to 38 digits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            rows = _rows(batch.column(0))
            for k in range(0, len(rows), BLOCK):
                for key, value in cells(rows[k : k + BLOCK]):
                    total[key] = total.get(key, 0) + int(value)
        keys = sorted(total)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([k[0] for k in keys], pa.int32()), "j": pa.array([k[1] for k in keys], pa.int32()),
            "value": pa.array([str(total[k]) for k in keys], pa.string())})

    parts = x.select("x").mapInArrow(of, "i int, j int, value string")
    found = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value"))
    return {(r["i"], r["j"]): int(r["value"]) for r in found.collect()}


@dataclass
class Moments:
    """Of the distinct vectors: how many, sums per dimension, and n^2 times their covariance, all exact."""

    n: int
    sums: list[int]
    spread: list[list[int]]

    def covariance(self) -> np.ndarray:
        """The covariance as sums of three doubles, so in the widest type to its last bit."""

        def wide(value: int):
            exact, out = Fraction(value, self.n * self.n), WIDE(0)
            for _ in range(3):
                part = float(exact)
                exact -= Fraction(part)
                out += WIDE(part)
            return out

        return np.array([[wide(v) for v in row] for row in self.spread], WIDE).reshape(len(self.sums), len(self.sums))


def moments(distinct: DataFrame) -> Moments:
    """Two passes over ``distinct`` (a column x, each vector once). Vectors are centred on the rounded mean, whole
    numbers, before they are multiplied; the rest of the mean, under one half, is taken off exactly at the end."""

    def sums(x: np.ndarray):
        yield (-1, 0), len(x)
        big = x if int(np.abs(x).max(initial=0)) < 1 << 48 else x.astype(object)
        yield from (((i, 0), v) for i, v in enumerate(big.sum(0)))

    found = _summed(distinct, sums)
    n = found.pop((-1, 0), 0)
    total = [found[i, 0] for i in range(len(found))]
    if not n:
        return Moments(0, [], [])
    centre = [(2 * s + n) // (2 * n) for s in total]
    middle = np.array(centre, np.int64)

    def products(x: np.ndarray):
        held = _products(x - middle)
        yield from (((i, j), held[i, j]) for i in range(len(held)) for j in range(i, len(held)))

    held = _summed(distinct, products)
    rest = [s - n * c for s, c in zip(total, centre)]
    d = len(total)
    spread = [[n * held[min(i, j), max(i, j)] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    return Moments(n, total, spread)


def refined(a: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in the widest float type.

    Starts from the eigenvectors of the matrix in single precision. Each round of Ogita and Aishima's iteration
    measures by matrix products how far the vectors X are from orthogonal (R = I - X'X) and from diagonalising
    (S = X'AX), and corrects all of them at once, quadratically. Vectors whose eigenvalues lie closer together
    than the error can tell apart are only made orthogonal by that; each such cluster is then turned by the
    eigenvectors of the small matrix X'(A - mu I)X, whose own scale is the cluster's width."""
    a = np.asarray(a, WIDE)
    scale = np.abs(a).max(initial=WIDE(0))
    if scale == 0:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    # Doubles take the first rounds, then the widest type the rest.
    for kind in (np.float64, WIDE):
        x, values = _rounds(a.astype(kind), x.astype(kind), rounds)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _rounds(a: np.ndarray, x: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Corrections until what is left is rounding, or no longer shrinks."""
    one, least = np.eye(len(a), dtype=a.dtype), 2 * len(a) * np.finfo(a.dtype).eps
    norm, last = np.sqrt((a * a).sum()), np.inf
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ (a @ x)
        # Symmetric to the last bit, so that corrections of close pairs cancel where they should.
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        away = s - np.diag(np.diag(s))
        left = max(np.abs(away).max(), np.abs(r).max())
        if left < least / 8 or (left < least and left > last / 2):
            break
        last = left
        error = 2 * (np.sqrt((away * away).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > error
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x, values = _clusters(a, x + x @ step, values, error)
    return x, values


def _clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, error) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order].copy(), values[order].copy()
    ends = np.flatnonzero(np.append(values[:-1] - values[1:] > error, True)) + 1
    start = 0
    for end in ends:
        if end - start > 1:
            held = x[:, start:end]
            mu = values[start:end].mean()
            small = held.T @ (a @ held - mu * held)
            size = np.abs(small).max()
            if size > 0:
                turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(a.dtype)[:, ::-1]
                # A turn is orthogonal to double precision only: one step of the same correction mends it.
                turn = turn + turn @ (np.eye(end - start, dtype=a.dtype) - turn.T @ turn) / 2
                x[:, start:end] = held @ turn
        start = end
    return x, values


@dataclass
class Model:
    n: int
    sums: list[int]
    centre: list[int]
    rest: np.ndarray
    project: np.ndarray
    explained: list[float]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whitened components, of x less its exact mean."""
        return ((x - np.array(self.centre, np.int64)).astype(np.float64) - self.rest) @ self.project

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2; null beyond 64 bits."""
        most = int(np.abs(x).max(initial=0))
        far = self.n * most + max(map(abs, self.sums), default=0)
        kind = np.int64 if far * far * max(x.shape[1], 1) < 1 << 63 else object
        z = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [v if v < 1 << 63 else None for v in (z * z).sum(1).tolist()]


def fit(distinct: DataFrame, components: int) -> Model | None:
    """The transform of ``distinct`` vectors x; None for an empty table."""
    held = moments(distinct)
    if not held.n:
        return None
    values, vectors = refined(held.covariance())
    trace = Fraction(sum(held.spread[i][i] for i in range(len(held.sums))), held.n**2)
    components = min(components, len(held.sums))
    centre = [(2 * s + held.n) // (2 * held.n) for s in held.sums]
    rest = np.array([float(Fraction(s - held.n * c, held.n)) for s, c in zip(held.sums, centre)])
    # Below rounding of the whole a variance counts as none: such a component is 0 for every row.
    some = values[:components] > float(trace) * 64 * np.finfo(WIDE).eps
    project = np.where(some, vectors[:, :components] / np.sqrt(np.where(some, values[:components], 1)), 0).astype(np.float64)
    explained = [float(v / WIDE(float(trace))) if ok else 0.0 for v, ok in zip(values, some)]
    return Model(held.n, held.sums, centre, rest, project, explained)


def identity_error(distinct: DataFrame, model: Model) -> float:
    """How far the covariance of the whitened vectors is from the identity: its largest absolute entry, measured in
    a pass over all distinct vectors, which are centred before they are multiplied."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.project.shape[1]
        total, first = np.zeros((m, m), WIDE), np.zeros(m, WIDE)
        for batch in batches:
            w = model.whiten(_rows(batch.column(0)))
            total += w.T @ w
            first += w.sum(0)
        yield pa.RecordBatch.from_pydict({
            "cell": list(range(m * m + m)), "value": np.concatenate([total.ravel(), first]).astype(np.float64)})

    parts = distinct.select("x").mapInArrow(of, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    m, held = model.project.shape[1], {r["cell"]: r["value"] for r in parts.collect()}
    mean = np.array([held[m * m + i] for i in range(m)]) / model.n
    covariance = np.array([held[i] for i in range(m * m)]).reshape(m, m) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(m)).max(initial=0))


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 4, steps: int = STEPS) -> DataFrame:
    """A row per usable row of ``vectors`` and component: the row's columns, ``component`` (from 1, by falling variance), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``; columns of these names are replaced.

    See ``quantised`` for rows left out. The fit takes each distinct vector once, so copies, however many, weigh
    as one: they combine before the shuffle. Only sums per pair of dimensions reach the driver. Components of
    no variance (all vectors alike, or fewer vectors than dimensions) are 0 and explain 0; ``identity_error`` then
    is 1. Vectors of fewer dimensions than ``components`` give as many rows as they have. Ties of eigenvalues leave the
    choice of directions open, the same for all rows. An empty table gives no rows."""
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in vectors.columns if c.lower() not in added]
    row = F.struct(*[vectors[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)])
    rows = quantised(vectors.select(row.alias("row"), vectors[f"`{column}`"].alias("vector")), "vector", steps).select("row", "x")
    distinct = stage(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, components)
    error = identity_error(distinct, model) if model else 0.0

    @F.arrow_udf("struct<deviation: long, whitened: array<double>>")
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            x = _rows(column)
            w = model.whiten(x)
            at = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.StructArray.from_arrays([pa.array(model.deviation(x), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(w.ravel()))],
                                             ["deviation", "whitened"])

    if model is None:
        found = rows.where("false").select("row", F.lit(0).alias("at"), F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"))
        shares, n = F.lit(0.0), 0
    else:
        found = rows.select("row", of("x").alias("found")).select("row", "found.deviation", F.posexplode("found.whitened").alias("at", "whitened"))
        shares, n = F.get(F.array(*[F.lit(v) for v in model.explained]), F.col("at")), model.n
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], (F.col("at") + 1).alias("component"),
                        F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
