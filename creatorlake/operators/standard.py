"""Records made alike ahead of cleaning: one encoding of texts, one record per profile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from creatorlake.functions.encoding import joined_parts, json_parts, standard_values
from creatorlake.operators.dedup import keep_last


def standard_records(records: DataFrame) -> DataFrame:
    """``(record_pos, record VARIANT)`` with every text value, however deep, composed and trimmed.

    Names, numbers and nesting stay; a record that needs no change is passed on as it is, a null one stays null.
    Work is linear in the length of a record, however its quotes, escapes and blanks lie. Narrow: no shuffle."""
    cut = records.selectExpr("record_pos", "record", "to_json(record) AS before").selectExpr("*", f"{json_parts('before')} AS parts")
    return cut.selectExpr("record_pos", "record", "before", f"{joined_parts(standard_values('parts'))} AS after").selectExpr(
        "record_pos", "IF(before <=> after, record, parse_json(after)) AS record")


def without_repeats(checked: DataFrame, key: str) -> DataFrame:
    """Checked records, of which the valid ones are unique by ``key``: the last one stays. Rejected ones all stay, for
    the quarantine. ``checked`` is read twice, so it should be staged."""
    last = keep_last(checked.where("size(violations) = 0"), [key], ["record_pos"])
    return last.unionByName(checked.where("size(violations) > 0"))
