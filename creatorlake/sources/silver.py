"""Fields of payloads in silver tables, without reading whole payloads.

Parquet files written by Spark hold a VARIANT column by field ("shredded"), as found from a file's first rows; what does not
fit stays beside its field as it was, so a payload reads back whole whatever its shape. A projection made of literal paths
becomes part of the scan, which then reads these fields alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from creatorlake.functions.sql import text_literal
from creatorlake.functions.variants import safe_get


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def typed_fields(table: DataFrame, payload: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``table`` with ``{name: (path, type)}`` of its payload in place of that.

    Paths are like ``$.stats.playCount``. A value that is missing, null or does not convert to its type gives NULL."""
    named = {name: F.expr(f"try_variant_get({_quoted(payload)}, {text_literal(path)}, '{dtype}')") for name, (path, dtype) in fields.items()}
    return _replaced(table, payload, named)


def defaulted_fields(table: DataFrame, payload: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The same with ``{name: (path, default)}``: VARIANT values by the rules of ``safe_get``, the default as JSON text in
    place of a missing key, a wrong container on the way, and JSON null. Paths are like ``stats.playCount``."""
    return _replaced(table, payload, {name: F.expr(safe_get(_quoted(payload), path, default)) for name, (path, default) in fields.items()})


def _replaced(table: DataFrame, payload: str, named: Mapping) -> DataFrame:
    return table.select(*[table[_quoted(c)] for c in table.columns if c != payload], *[value.alias(name) for name, value in named.items()])
