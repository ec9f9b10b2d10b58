"""Captured response bodies."""

from __future__ import annotations

from creatorlake.functions.variants import is_object, kind, scalar


def _is_text(v: str) -> str:
    # ``kind`` walks a whole container, so objects, which most bodies are, are told apart first.
    return f"NOT {is_object(v)} AND {kind(v)} = 'STRING'"


def decode_text(body: str, is_base64: str) -> str:
    """Plain text of a body that may be base64."""
    return f"if(coalesce({is_base64}, false), CAST(try_to_binary({body}, 'base64') AS STRING), {body})"


def first_of_list(v: str) -> str:
    """A non-empty list stands for its first element."""
    return f"coalesce(try_variant_get({v}, '$[0]', 'variant'), {v})"


def parse_text(body: str, is_base64: str) -> str:
    """VARIANT body as landed: text is decoded and parsed, or stays text; anything else is parsed already."""
    decoded = decode_text(scalar(body, "string"), is_base64)
    return f"if({_is_text(body)}, coalesce(try_parse_json({decoded}), CAST({decoded} AS VARIANT)), {body})"


def reparse_text(body: str) -> str:
    """A body that is still text gets one more parse; NULL if that fails."""
    return f"if({_is_text(body)}, try_parse_json({scalar(body, 'string')}), {body})"


def is_large_response(headers: str, threshold: int) -> str:
    return f"coalesce(try_cast(try_element_at({headers}, 'content-length') AS BIGINT) > {threshold}, false)"
