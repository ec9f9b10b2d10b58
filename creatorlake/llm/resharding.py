"""Resharding by minimum-cost flow: fill new capacities with the fewest bytes moved, then rewrite affected shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creatorlake.session import stage
from creatorlake.sinks.files import delete, exists

#: Bytes a document takes besides its text.
OVERHEAD = 16
#: A document above this share of an average shard is placed by itself, so there are fewer than GRAIN of them a shard.
GRAIN = 64
#: Rows that one window sorts, on average, and slots that one task of a rewrite writes.
BUCKET_ROWS = 50_000
KEY = ["doc_id", "size", "text_crc32", "old_shard", "copy"]


def min_cost_flow(supply: list[float], capacity: list[float], cost) -> dict[tuple[int, int], float]:
    """Bytes to send from each supply i to each capacity j at the least sum of bytes * cost(i, j).

    Successive shortest paths, found by relaxing arcs until none improves; shard numbers are small."""
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], float] = {}
    left, room = list(supply), list(capacity)
    price = {(i, j): cost(i, j) for i in range(n) for j in range(m)}
    tiny = 1e-9 * (sum(supply) + 1)
    while max(left, default=0) > tiny:
        dist = [0.0 if x > tiny else float("inf") for x in left] + [float("inf")] * m
        back = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for (i, j), c in price.items():
                if dist[i] + c < dist[n + j] - 1e-12:
                    dist[n + j], back[n + j], changed = dist[i] + c, i, True
                if flow.get((i, j), 0) > tiny and dist[n + j] - c < dist[i] - 1e-12:
                    dist[i], back[i], changed = dist[n + j] - c, n + j, True
        end = min((j for j in range(m) if room[j] > tiny), key=lambda j: dist[n + j], default=None)
        if end is None:
            break
        path, node = [], n + end
        while back[node] >= 0:
            path.append((back[node], node))
            node = back[node]
        amount = min([left[node], room[end]] + [flow[(b, a - n)] for a, b in path if a >= n])
        for a, b in path:
            arc = (a, b - n) if b >= n else (b, a - n)
            flow[arc] = flow.get(arc, 0) + (amount if b >= n else -amount)
        left[node] -= amount
        room[end] -= amount
    return {arc: x for arc, x in flow.items() if x > tiny}


def _level(loads: list[float], weights: list[float], total: float) -> list[float]:
    """Room of each shard so that all rooms take ``total`` and loads plus rooms are as level as can be."""
    order = sorted(range(len(loads)), key=lambda j: loads[j] / weights[j])
    height, weight, held = 0.0, 0.0, 0.0
    for at, j in enumerate(order):
        weight, held = weight + weights[j], held + loads[j]
        height = (total + held) / weight
        if at + 1 == len(order) or height <= loads[order[at + 1]] / weights[order[at + 1]]:
            break
    return [max(0.0, height * w - x) for x, w in zip(loads, weights)]


def _place(rows, loads: list[float], weights: list[float], share: float) -> list[int]:
    """Shards of single documents, largest first: its own while that has room, else the emptiest."""
    out = {}
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k]["size"], str(rows[k]))):
        size, old = rows[k]["size"], rows[k]["old_shard"]
        stays = old < len(loads) and loads[old] + size <= share * weights[old]
        to = old if stays else min(range(len(loads)), key=lambda j: (loads[j] + size) / weights[j])
        loads[to] += size
        out[k] = to
    return [out[k] for k in range(len(rows))]


def _hash():
    return F.xxhash64("doc_id", "text_crc32", "copy")


def _offsets(rows: DataFrame, group: str, value) -> DataFrame:
    """What stands before each bucket of a group: one row per bucket, so a group's running sum is short."""
    sums = rows.groupBy(group, "bucket").agg(value.cast("long").alias("held"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))


def sized(docs: DataFrame, old_shards: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32 and ``old_shard``: the shard of documents read from a layout, or the one of ``old_shards``
    that a text without a shard falls into."""
    text = F.coalesce("text", F.lit(""))
    old = F.col("shard") if old_shards is None else F.pmod(F.xxhash64(text), F.lit(old_shards)).cast("int")
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       old.alias("old_shard"))


def reshard(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Rows (doc_id, size, text_crc32, old_shard) with the copy number among equal rows, ``shard`` and ``slot``.

    ``weights`` are the relative capacities of shards 0, 1, ...; an old shard keeps its number. Large
    documents, fewer than GRAIN a shard, are placed one by one; the bytes of all others flow from old shards
    to the room left, and keeping a byte is free while moving it costs one. Each flow is a stretch of
    an old shard in hashed order; a document goes where its middle falls, so a shard is off by
    half a small document per stretch. Positions and slots come from sums per bucket and windows
    within buckets; equal rows are numbered first, so buckets stay even whatever repeats. Only
    shard sizes and the large documents reach the driver. An empty table gives no rows."""
    spark = rows.sparkSession
    counted = rows.groupBy(*KEY[:-1]).agg(F.count("*").alias("copies"))
    counted = stage(counted, "sizes")
    total = counted.agg(F.sum(F.col("size") * F.col("copies")), F.sum("copies")).first()
    share = (total[0] or 0) / sum(weights)
    buckets = max(1, (total[1] or 0) // (BUCKET_ROWS * len(weights)) + 1)
    single = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    limit = share * sum(weights) / len(weights) / GRAIN
    large = single.where(F.col("size") > limit).collect()
    loads = [0.0] * len(weights)
    placed = list(zip(large, _place(large, loads, weights, share)))
    small = single.where(F.col("size") <= limit)
    held = {r[0]: r[1] for r in small.groupBy("old_shard").agg(F.sum("size")).collect()}
    supply = [float(held.get(i, 0)) for i in range(max(held, default=-1) + 1)]
    flow = min_cost_flow(supply, _level(loads, weights, sum(supply)), lambda i, j: 0.0 if i == j else 1.0)

    stretches = []
    for i in range(len(supply)):
        at = 0.0
        # The part that stays comes first.
        parts = sorted(((j, x) for (k, j), x in flow.items() if k == i), key=lambda p: (p[0] != i, p[0]))
        for j, x in parts:
            last = j == parts[-1][0]
            stretches.append((i, float(at), float("inf") if last else at + x, j))
            at += x
    # At most old plus new shards less one arcs carry flow.
    blocks = F.broadcast(spark.createDataFrame(stretches, "old_shard int, low double, high double, shard int"))
    small = small.withColumn("bucket", F.pmod(_hash(), F.lit(buckets)))
    within = Window.partitionBy("old_shard", "bucket").orderBy(_hash(), *KEY)
    middle = F.col("before") + F.sum("size").over(within) - F.col("size") / 2
    small = small.join(_offsets(small, "old_shard", F.sum("size")), ["old_shard", "bucket"]).withColumn("middle", middle)
    moved = small.join(blocks, "old_shard").where("middle >= low AND middle < high").select(*KEY, "shard")
    if placed:
        fields = f"doc_id {dict(rows.dtypes)['doc_id']}, size long, text_crc32 long, old_shard int, copy long, shard int"
        one_by_one = spark.createDataFrame([(*[r[k] for k in KEY], j) for r, j in placed], fields)
        moved = moved.unionByName(one_by_one)
    moved = stage(moved, "placed").withColumn("bucket", F.pmod(_hash(), F.lit(buckets)))
    order = Window.partitionBy("shard", "bucket").orderBy(_hash(), *KEY)
    slotted = moved.withColumn("number", F.row_number().over(order)).join(_offsets(moved, "shard", F.count("*")), ["shard", "bucket"])
    return slotted.select(*KEY, "shard", (F.col("before") + F.col("number") - 1).alias("slot"))


def layout(spark: SparkSession, path: str) -> DataFrame:
    """The documents that ``rewrite`` wrote: doc_id, text, shard, slot. ``shard`` is a partition."""
    return spark.read.parquet(path).select("doc_id", "text", F.col("shard").cast("int").alias("shard"), "slot")


def rewrite(docs: DataFrame, planned: DataFrame, path: str) -> list[int]:
    """Write anew the folders ``shard=k`` under ``path`` of shards that documents leave or enter, in slot order, and
    remove those of shards left without any; the others stay as they are. Returns the shards written.

    A shard is as many tasks and files as it has stretches of BUCKET_ROWS slots. ``docs`` has doc_id and text, and may
    be read from ``path``: rows are written to the staging folder first. ``planned`` is read three times, so it should be staged.
    An empty plan writes nothing."""
    spark = planned.sparkSession
    counts = planned.select("old_shard", "shard").groupBy("old_shard", "shard").agg(F.count("*").alias("n")).collect()
    held = {r["shard"] for r in counts}
    moved = {k for r in counts if r["old_shard"] != r["shard"] for k in (r["old_shard"], r["shard"])}
    touched = sorted(moved & held)
    if touched:
        wanted = planned.where(F.col("shard").isin(touched)).select(
            "doc_id", "text_crc32", F.lit(None).cast("string").alias("text"), "copy", "shard", "slot")
        none = [F.lit(None).cast(t).alias(c) for c, t in wanted.dtypes if c in ("copy", "shard", "slot")]
        texts = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "text", *none)
        # Places and texts meet in one shuffle: texts are numbered like the copies of the plan, then each follows its place.
        met = wanted.withColumn("is_text", F.lit(False)).unionByName(texts.withColumn("is_text", F.lit(True))).repartition("doc_id", "text_crc32")
        numbered = Window.partitionBy("doc_id", "text_crc32", "is_text").orderBy("text")
        paired = Window.partitionBy("doc_id", "text_crc32", "copy").orderBy("is_text")
        met = met.withColumn("copy", F.when(F.col("is_text"), F.row_number().over(numbered).cast("long")).otherwise(F.col("copy")))
        met = met.withColumns({c: F.coalesce(c, F.lag(c).over(paired)) for c in ("shard", "slot")})
        out = stage(met.where("is_text AND shard IS NOT NULL").select("shard", "slot", "doc_id", "text"), "rewritten")
        stretches = out.repartition("shard", F.floor(F.col("slot") / BUCKET_ROWS)).sortWithinPartitions("shard", "slot")
        stretches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for k in sorted(moved - held):
        if exists(spark, f"{path}/shard={k}"):
            delete(spark, f"{path}/shard={k}")
    return touched
