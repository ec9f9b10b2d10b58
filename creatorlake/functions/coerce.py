"""Number and boolean coercions. NULL means the value is not acceptable."""

from __future__ import annotations

from creatorlake.constants import FALSE_WORDS, TRUE_WORDS
from creatorlake.functions.sql import matches, text_literal, words
from creatorlake.functions.variants import kind, scalar

_BLANK = r"[ \t\n\x0B\f\r]*"
_INT_TEXT = rf"\A{_BLANK}[+-]?[0-9]+(_[0-9]+)*{_BLANK}\z"
_INT_TEXT_ZERO_FRACTION = rf"\A{_BLANK}[+-]?[0-9]+(_[0-9]+)*(\.0+)?{_BLANK}\z"
_DIGITS = text_literal(r"[+-]?[0-9][0-9_]*")


def _text_to_bigint(s: str) -> str:
    return f"try_cast(replace(regexp_extract({s}, {_DIGITS}, 0), '_', '') AS BIGINT)"


def _is_fraction_type(v: str, k: str | None = None) -> str:
    k = kind(v) if k is None else k
    return f"({k} LIKE 'DECIMAL%' OR {k} IN ('DOUBLE', 'FLOAT'))"


def comma_int(s: str) -> str:
    """Text with thousands commas: digits only gives the number, anything else gives 0."""
    bare = f"replace({s}, ',', '')"
    return f"if({matches(bare, r'\A[0-9]+\z')}, try_cast({bare} AS BIGINT), 0L)"


def lax_int(v: str) -> str:
    """Whole numbers, zero-fraction numbers, booleans, and text such as " 12 ", "+5", "1_000", "12.0"."""
    d, s = scalar(v, "double"), scalar(v, "string")
    # Doubles at or beyond 2^63 do not fit BIGINT.
    return f"""CASE
        WHEN {kind(v)} IN ('BIGINT', 'BOOLEAN') THEN {scalar(v, 'bigint')}
        WHEN {kind(v)} = 'STRING'
            THEN if({matches(s, _INT_TEXT_ZERO_FRACTION)}, {_text_to_bigint(s)}, NULL)
        WHEN {_is_fraction_type(v)} AND {d} = floor({d}) AND abs({d}) < 9223372036854775808D
            THEN {scalar(v, 'bigint')} END"""


def truncating_int(v: str, k: str | None = None) -> str:
    """Like ``lax_int`` but numbers lose their fraction and text must be a plain integer. ``k`` is a column that holds the kind
    of ``v``, for wide projections: their code must stay small enough to be compiled."""
    s, k = scalar(v, "string"), kind(v) if k is None else k
    return f"""CASE
        WHEN {k} = 'STRING' THEN if({matches(s, _INT_TEXT)}, {_text_to_bigint(s)}, NULL)
        WHEN {k} IN ('BIGINT', 'BOOLEAN') OR {_is_fraction_type(v, k)} THEN {scalar(v, 'bigint')} END"""


def counter(v: str) -> str:
    """Text goes through ``comma_int``; every other type through ``lax_int``."""
    return f"if({kind(v)} = 'STRING', {comma_int(scalar(v, 'string'))}, {lax_int(v)})"


def lax_bool(v: str, k: str | None = None) -> str:
    word, d, k = f"lower({scalar(v, 'string')})", scalar(v, "double"), kind(v) if k is None else k
    return f"""CASE
        WHEN {k} = 'BOOLEAN' THEN {scalar(v, 'boolean')}
        WHEN {k} = 'STRING' THEN
            CASE WHEN {word} IN ({words(TRUE_WORDS)}) THEN true
                 WHEN {word} IN ({words(FALSE_WORDS)}) THEN false END
        WHEN {k} = 'BIGINT' OR {_is_fraction_type(v, k)} THEN
            CASE {d} WHEN 1 THEN true WHEN 0 THEN false END END"""
