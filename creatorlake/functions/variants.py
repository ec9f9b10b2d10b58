"""Reading irregular JSON held as VARIANT."""

from __future__ import annotations


def kind(v: str) -> str:
    """Type name of a scalar: BIGINT, DECIMAL(p,s), DOUBLE, STRING, BOOLEAN, VOID, ..."""
    return f"schema_of_variant({v})"


def field(v: str, path: str) -> str:
    """Value at a dotted path; SQL NULL if missing, variant null if JSON null."""
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def scalar(v: str, sql_type: str) -> str:
    return f"try_variant_get({v}, '$', '{sql_type}')"


def fields(v: str, keys: list[str]) -> str:
    """Several fields of an object in one read: a struct of VARIANT, SQL NULL for a missing key and for
    the whole struct if ``v`` is no object. One walk over the object instead of one per field."""
    members = ", ".join(f"{key}: variant" for key in keys)
    return f"try_variant_get({v}, '$', 'struct<{members}>')"


def default(v: str, default_json: str) -> str:
    """JSON text in place of a missing value; JSON null is kept."""
    return f"coalesce({v}, parse_json('{default_json}'))"


def get_or_default(v: str, key: str, default: str) -> str:
    """The default (JSON text) stands in for a missing key only; JSON null is kept."""
    return f"coalesce({field(v, key)}, parse_json('{default}'))"


def plain(v: str, key: str, sql_type: str, default: str) -> str:
    """``get_or_default`` read as a plain type (``default`` is one of its values): looked up again only where nothing was read."""
    return f"coalesce(try_variant_get({v}, '$.{key}', '{sql_type}'), if({field(v, key)} IS NULL, {default}, NULL))"


def unless_nothing(v: str, default_json: str) -> str:
    """JSON text in place of a missing value or JSON null."""
    return f"if({is_nothing(v)}, parse_json('{default_json}'), {v})"


def safe_get(v: str, path: str, default_json: str) -> str:
    """The default stands in for a missing key, a wrong container on the way, and JSON null."""
    return unless_nothing(field(v, path), default_json)


def as_array(v: str) -> str:
    """ARRAY<VARIANT>, or NULL for anything but a list."""
    return scalar(v, "array<variant>")


def list_at(v: str, path: str) -> str:
    """The list at a path in one step; NULL if missing or no list."""
    return f"try_variant_get({v}, '$.{path}', 'array<variant>')"


def is_object(v: str) -> str:
    # An empty struct reads no field: the test costs the same however large the object is.
    return f"({scalar(v, 'struct<>')} IS NOT NULL)"


def is_nothing(v: str) -> str:
    """Missing or JSON null."""
    return f"({v} IS NULL OR is_variant_null({v}))"


def is_empty(v: str, k: str | None = None) -> str:
    """Missing, null, false, zero, empty text, empty list or empty object. ``k`` is a column that holds the kind of ``v``."""
    return (
        f"CASE WHEN {is_nothing(v)} THEN true"
        f" WHEN {kind(v) if k is None else k} = 'STRING' THEN {scalar(v, 'string')} = ''"
        f" ELSE coalesce(size({scalar(v, 'map<string, variant>')}) = 0, false)"
        f" OR coalesce(size({as_array(v)}) = 0, false) OR coalesce({scalar(v, 'double')} = 0, false) END"
    )


def text(v: str) -> str:
    """Text only: numbers, booleans and containers give NULL."""
    return f"if({kind(v)} = 'STRING', {scalar(v, 'string')}, NULL)"
