"""Hashtags."""

from __future__ import annotations

from creatorlake.constants import HASHTAG_MAX_LENGTH, HASHTAG_PATTERN
from creatorlake.functions.sql import let, matches


def with_hash(tag: str) -> str:
    """Trimmed, with a leading ``#``."""
    return f"if(startswith(trim({tag}), '#'), trim({tag}), concat('#', trim({tag})))"


def without_hash(tag: str) -> str:
    """Lower case, every ``#`` removed."""
    return f"lower(replace({tag}, '#', ''))"


def is_valid_tag(tag: str) -> str:
    return f"coalesce({matches(tag, HASHTAG_PATTERN)} AND length({tag}) <= {HASHTAG_MAX_LENGTH}, false)"


def before_first_false(values: str, flags: str) -> str:
    """The elements before the first one whose flag is false; one pass, no row explosion, each argument evaluated once.

    ``flags`` is written over ``held``, the name the values have inside."""
    cut = let("cut", f"CAST(array_position({flags}, false) AS INT)", "if(cut > 0, slice(held, 1, cut - 1), held)")
    return let("held", values, cut)
