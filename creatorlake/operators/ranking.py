"""Exact ranks over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# A value is read as three digits of this many bits: a window sees 2^21 rows at most, of high digits 2^22.
DIGIT_BITS = 21


def percent_rank_in_groups(df: DataFrame, group: str, value: str, decimals: int, name: str) -> DataFrame:
    """Add ``name`` = (rank - 1) / (rows - 1) of ``value`` within ``group``, rounded to ``decimals``
    digits first; 0 for a group of one, NULL for a NULL value (which is not counted) and for one that
    does not fit 64 bits once scaled.

    A plain ``percent_rank`` window would sort a whole group in one task. Here rows collapse to counts
    per (group, value) map-side, and the counts are summed up digit by digit, from the high digits to
    the low ones; every window spans one digit only. Results go back to the rows by an equi-join whose
    other side has unique keys."""
    scaled = F.expr(f"try_cast(round({value} * {10**decimals}) AS BIGINT)")
    df = df.withColumn("scaled_value", scaled)
    counts = (
        df.where("scaled_value IS NOT NULL")
        .groupBy(group, "scaled_value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({
            "high": F.shiftright("scaled_value", 2 * DIGIT_BITS),
            "middle": F.shiftright("scaled_value", DIGIT_BITS).bitwiseAND((1 << DIGIT_BITS) - 1),
            "low": F.col("scaled_value").bitwiseAND((1 << DIGIT_BITS) - 1),
        })
    )
    by_middle = counts.groupBy(group, "high", "middle").agg(F.sum("n").alias("n"))
    by_high = by_middle.groupBy(group, "high").agg(F.sum("n").alias("n"))
    totals = by_high.groupBy(group).agg(F.sum("n").alias("group_rows"))

    def below(keys: list[str], digit: str) -> Column:
        before = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(before), F.lit(0))

    high = by_high.select(group, "high", below([group], "high").alias("below_high"))
    middle = by_middle.select(group, "high", "middle", below([group, "high"], "middle").alias("below_middle"))
    ranks = (
        counts.select(group, "scaled_value", "high", "middle", below([group, "high", "middle"], "low").alias("below_low"))
        .join(middle, [group, "high", "middle"])
        .join(high, [group, "high"])
        .join(totals, group)
        .select(
            group, "scaled_value",
            F.expr(
                "coalesce(try_divide(below_high + below_middle + below_low, group_rows - 1), 0D)"
            ).alias(name),
        )
    )
    return df.join(ranks, [group, "scaled_value"], "left").drop("scaled_value")
