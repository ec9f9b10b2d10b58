"""Keeping one row per key.

Arrival order is a column list, never row order. ``row_number() = 1`` plans a per-task group limit
before the shuffle, so at most one row per key and map task travels: a hot key stays cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

POSITION = ["response_seq", "item_pos"]


def _one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rank).where("rn = 1").drop("rn")


def keep_first(df: DataFrame, keys: list[str], position: list[str] = POSITION) -> DataFrame:
    return _one(df, keys, [F.col(c).asc() for c in position])


def keep_last(df: DataFrame, keys: list[str], position: list[str] = POSITION) -> DataFrame:
    return _one(df, keys, [F.col(c).desc() for c in position])


def keep_last_at_first_position(df: DataFrame, keys: list[str], position: list[str] = POSITION) -> DataFrame:
    """The last row per key, with the position of the first one."""
    payload = [c for c in df.columns if c not in keys and c not in position]
    pos = F.struct(*position)
    grouped = df.groupBy(*keys).agg(
        F.min(pos).alias("first_position"), F.max_by(F.struct(*payload), pos).alias("kept")
    )
    return grouped.select(*keys, "first_position.*", "kept.*")


def distinct_edges(df: DataFrame, left: str, right: str) -> DataFrame:
    """A relation is a set of pairs; pairs are merged map-side before they are shuffled."""
    return df.select(left, right).dropDuplicates([left, right])
