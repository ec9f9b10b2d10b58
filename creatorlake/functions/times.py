"""Unix seconds to zone-free timestamps."""

from __future__ import annotations

from creatorlake.functions.variants import is_nothing, kind, scalar

# First and last second that a calendar date can hold; outside them the run time stands in.
FIRST_SECOND = -62135510400
LAST_SECOND = 253402300799
# Beyond these even the year number overflows, and the whole record is refused.
REFUSED_ABOVE = 67768036191676799
REFUSED_BELOW = -67768040609740800


def timestamp_literal(value) -> str:
    """A zone-free timestamp from text or a datetime."""
    return f"TIMESTAMP_NTZ'{value}'"


def seconds_to_timestamp(seconds: str) -> str:
    """Microsecond exact; arithmetic on TIMESTAMP_NTZ, so the session zone plays no part."""
    micros = f"CAST(round(CAST({seconds} AS DECIMAL(32, 6)) * 1000000) AS BIGINT)"
    return f"timestampadd(MICROSECOND, {micros}, {timestamp_literal('1970-01-01 00:00:00')})"


def epoch_to_timestamp(v: str, run_ts) -> str:
    """Number in range: its time. Text, null, list, object or a date out of range: ``run_ts``.
    Absurdly large: NULL, which rejects the record."""
    d = scalar(v, "double")
    number = f"({kind(v)} IN ('BIGINT', 'BOOLEAN', 'DOUBLE', 'FLOAT') OR {kind(v)} LIKE 'DECIMAL%')"
    return f"""CASE
        WHEN {is_nothing(v)} OR NOT {number} OR isnan({d}) THEN {timestamp_literal(run_ts)}
        WHEN {d} > {REFUSED_ABOVE} OR {d} < {REFUSED_BELOW} THEN NULL
        WHEN {d} >= {FIRST_SECOND} AND {d} < {LAST_SECOND + 1}
            THEN {seconds_to_timestamp(scalar(v, 'decimal(32, 6)'))}
        ELSE {timestamp_literal(run_ts)} END"""
