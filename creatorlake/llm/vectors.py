"""Embedding near-duplicates by an inverted multi-index: a grid of cells from two codebooks, one per vector half."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.llm.common import components, forest
from creatorlake.session import stage

#: Bound of the fit: vectors that teach the codebooks and the number of cells to visit.
SAMPLE = 4096
#: Vectors a cell holds on average, and the most codewords a sample of that size can teach.
CELL, CODEWORDS = 64, 256
#: Share of pairs exactly at the threshold, the hardest ones, that the visited cells are to hold.
RECALL = 0.999
#: Vectors and probes in a tile.
TILE, PROBES = 1024, 4096


@dataclass
class Index:
    codebooks: tuple[np.ndarray, np.ndarray]
    visits: int

    def distances(self, unit: np.ndarray) -> list[np.ndarray]:
        half = unit.shape[1] // 2
        out = []
        for part, words in zip((unit[:, :half], unit[:, half:]), self.codebooks):
            out.append((part**2).sum(1)[:, None] + (words**2).sum(1) - 2 * part @ words.T)
        return out

    def traverse(self, unit: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest cells of each vector, nearest first: a multi-sequence walk over its codewords sorted by
        distance on either half. The n-th cell lies where (rank + 1) * (rank + 1) <= n, so only that staircase is summed."""
        visits = visits or self.visits
        k = len(self.codebooks[0])
        distances = self.distances(unit)
        order = [d.argsort(1, kind="stable") for d in distances]
        near = [np.take_along_axis(d, o, 1) for d, o in zip(distances, order)]
        i, j = np.array([(i, j) for i in range(k) for j in range(k) if (i + 1) * (j + 1) <= visits]).T
        best = (near[0][:, i] + near[1][:, j]).argsort(1, kind="stable")[:, :visits]
        return np.take_along_axis(order[0], i[best], 1) * k + np.take_along_axis(order[1], j[best], 1)


def _codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    words = points[np.random.default_rng(0).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = ((words**2).sum(1) - 2 * points @ words.T).argmin(1)
        for w in np.unique(nearest):
            words[w] = points[nearest == w].mean(0)
    return words


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled by a power of two first, which is exact, so that squares of large or small components stay in range.
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(sample: np.ndarray, total: int, threshold: float, recall: float = RECALL) -> Index:
    """Codebooks by k-means over a sample's halves; visits from the sample moved to exactly ``threshold``: how
    many cells one vector of such a pair must visit to meet the other, either way round."""
    unit = _unit(sample)
    k = int(np.clip(round((total / CELL) ** 0.5), 1, min(CODEWORDS, len(unit))))
    half = unit.shape[1] // 2
    index = Index((_codebook(unit[:, :half], k), _codebook(unit[:, half:], k)), k * k)
    noise = np.random.default_rng(1).normal(size=unit.shape)
    noise -= (noise * unit).sum(1, keepdims=True) * unit
    moved = _unit(threshold * unit + (1 - threshold**2) ** 0.5 * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12))
    ranks = []
    for x, y in ((unit, moved), (moved, unit)):
        (a, b), (c, d) = index.distances(x), index.distances(y)
        i, j = c.argmin(1), d.argmin(1)
        at = np.arange(len(x))
        reach = a[at, i] + b[at, j]
        # Cells nearer than the partner's, from one sorted half and each codeword of the other.
        ranks.append(np.array([np.searchsorted(np.sort(a[r]), reach[r] - b[r]).sum() for r in at]))
    index.visits = int(min(k * k, np.quantile(np.minimum(*ranks), recall, method="higher") + 1))
    return index


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _indexed(classes: DataFrame, index: Index) -> DataFrame:
    """Every class with its cell and the cells it visits. Components stay of the type they have."""
    vector = dict(classes.dtypes)["embedding"]

    def assign(batches):
        for batch in batches:
            visited = index.traverse(_unit(_matrix(batch.column("embedding")))).astype(np.int32)
            flat = pa.array(visited.ravel())
            at = pa.array(np.arange(len(visited) + 1, dtype=np.int32) * visited.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), batch.column("embedding"),
                                              pa.array(visited[:, 0]), pa.ListArray.from_arrays(at, flat)],
                                             names=["node", "weight", "embedding", "cell", "visited"])

    return classes.mapInArrow(assign, f"node long, weight long, embedding {vector}, cell int, visited array<int>")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Links of each tile pair: rows (a, n) adding n links to node a, and rows (a, b) that span its links."""

    def side(column: pa.ListArray, row: int):
        held = column[row].values
        return [held.field(name) for name in ("node", "weight", "embedding", "cells")]

    def verify(batches):
        for batch in batches:
            out = {"a": [], "b": [], "n": []}
            for row in range(batch.num_rows):
                node_p, weight_p, p, cell_p = side(batch.column("probes"), row)
                node_m, weight_m, m, visited_m = side(batch.column("members"), row)
                node_p, node_m, weight_p, weight_m = (x.to_numpy() for x in (node_p, node_m, weight_p, weight_m))
                p, m, cell_p, visited_m = (_matrix(x) for x in (p, m, cell_p, visited_m))
                near = _unit(p) @ _unit(m).T >= threshold
                near &= node_p[:, None] != node_m[None, :]
                if not near.any():
                    continue
                # A member that visits the probe's cell finds this link itself; otherwise it is counted for both here.
                cells, which = np.unique(cell_p[:, 0], return_inverse=True)
                mutual = np.stack([(visited_m == c).any(1) for c in cells])[which]
                left, right = near @ weight_m, (near & ~mutual).T @ weight_p
                a, b = forest(node_p, node_m, near)
                out["a"] += [node_p[left > 0], node_m[right > 0], a]
                out["n"] += [left[left > 0], right[right > 0], np.zeros(len(a), np.int64)]
                out["b"] += [np.full((left > 0).sum() + (right > 0).sum(), -1), b]
            yield pa.RecordBatch.from_pydict({k: np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for k, v in out.items()})

    return pairs.mapInArrow(verify, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs of rows with a cosine of ``threshold`` or more in double precision, found in the cells
    their vectors visit and verified; none below it. Equal vectors are one class, indexed once and
    counted with its size. Each link is found from either side and counted on both. Cells are cut into
    tiles by hash and meet the probes that visit them tile by tile, so a crowded cell is many small
    tasks; a tile pair yields counts and a spanning forest, never its pairs.

    Null or zero vectors, those with null or non-finite components, and those of another length than most
    link with nothing and are their own component. Null vec_ids count as links but name no component."""
    spark = vectors.sparkSession
    # Floats travel as they are, which is half of doubles, and are read as doubles where they are compared. Row numbers
    # are fixed once by writing them.
    vector = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(vector).alias("embedding"))
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("embedding", F.expr(f"IF({finite}, embedding, NULL)"))
    lengths = rows.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("size")).count()
    usual = lengths.orderBy(F.desc("count"), "size").first()
    alone = F.col("vec_id").alias("component_id")
    if usual is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone, F.lit(True).alias("kept"))
    rows = rows.withColumn("embedding", F.when(F.size("embedding") == usual["size"], F.col("embedding")))
    valid = rows.where("embedding IS NOT NULL")
    classes = valid.groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    taught = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toPandas()["embedding"]
    index = fit(np.stack(taught.to_list()).astype(np.float64), classes.count(), threshold)

    held = stage(_indexed(classes.select("node", "weight", "embedding"), index), "cells")
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    # One row per cell, CODEWORDS squared at most, so it may be broadcast.
    placed = held.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    member = F.struct("node", "weight", "embedding", F.col("visited").alias("cells"))
    members = placed.groupBy("cell", "part").agg(F.collect_list(member).alias("members"))
    visits = held.select("node", "weight", "embedding", F.array("cell").alias("cells"), F.explode("visited").alias("cell"))
    counts = visits.groupBy("cell").agg(F.ceil(F.count("*") / PROBES).alias("parts"))
    visits = visits.join(F.broadcast(counts), "cell").withColumn("piece", F.pmod(F.xxhash64("node"), "parts"))
    probes = visits.groupBy("cell", "piece").agg(F.collect_list(F.struct("node", "weight", "embedding", "cells")).alias("probes"))
    found = stage(_verified(members.join(probes, "cell").select("probes", "members"), threshold), "links")

    links = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    stars = components(found.where("b >= 0").select("a", "b"))
    rooted = classes.select("node", "embedding", "weight", "first").join(stars, "node", "left").join(links, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    rooted = rooted.join(named, "root").select("embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = valid.join(rooted, "embedding").select("vec_id", "n_links", "component_id")
    lone = rows.where("embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), alone)
    return linked.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
