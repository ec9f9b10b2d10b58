"""Record rules: every record carries the list of rules it breaks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from creatorlake.functions.sql import text_literal
from creatorlake.functions.times import timestamp_literal


def length_between(name: str, low: int, high: int | None = None) -> str:
    """Length in code points; NULL (missing or wrong type) fails."""
    return f"length({name}) >= {low}" if high is None else f"length({name}) BETWEEN {low} AND {high}"


def at_least(name: str, low: int) -> str:
    return f"{name} >= {low}"


def present(name: str) -> str:
    return f"{name} IS NOT NULL"


def with_violations(df: DataFrame, rules: Mapping[str, str], *lists: str) -> DataFrame:
    """Add ``violations``: names of the rules whose condition is false or unknown.

    They come out of a one-row ``inline``: Catalyst cannot push a filter on generated columns below
    the projection, which would evaluate every coercion a second time inside the predicate. ``lists``
    are array columns that pass the same way, since exploding them later implies a filter too."""
    broken = [f"if({ok}, NULL, {text_literal(name)})" for name, ok in rules.items()]
    row = [f"array_compact(array({', '.join(broken)})) AS violations", *lists]
    return df.selectExpr(*[c for c in df.columns if c not in lists], f"inline(array(struct({', '.join(row)})))")


def valid(df: DataFrame) -> DataFrame:
    return df.where("size(violations) = 0")


def quarantine(df: DataFrame, entity: str, record_id: str) -> DataFrame:
    """Rejected records with their reasons and the record as JSON."""
    return df.where("size(violations) > 0").selectExpr(
        f"'{entity}' AS entity", "record_pos", f"{record_id} AS record_id", "violations", "to_json(record) AS raw"
    )


def error_log(rejected: DataFrame, phase: str, run_ts) -> DataFrame:
    """One log row per broken rule."""
    return rejected.selectExpr(
        f"{timestamp_literal(run_ts)} AS timestamp",
        f"'{phase}' AS phase",
        "concat(upper(entity), '_VALIDATION_ERROR') AS error_type",
        "explode(violations) AS message",
        "record_id AS item_id",
        "CAST(NULL AS STRING) AS exception_str",
    )


def where_computed(df: DataFrame, condition: str) -> DataFrame:
    """``where`` on freshly coerced columns, kept above their projection like the violations are."""
    return df.select("*", F.expr(f"explode(array({condition}))").alias("keep")).where("keep").drop("keep")
