"""Text in standard encoding: canonical composition (NFC) and no white space at its ends. This project's own definition."""

from __future__ import annotations

# Characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDS = "".join(f"\\u{c:04x}" for c in WHITE_SPACE)

# Characters below U+0020 never stand in JSON text themselves, so two of them may stand for escapes while it is cut.
_BACKSLASH, _QUOTE = "char(1)", "char(2)"
_ESCAPES = {r"'\\n'": "char(10)", r"'\\r'": "char(13)", r"'\\t'": "char(9)", r"'\\f'": "char(12)", r"'\\u000B'": "char(11)"}


def composed(s: str) -> str:
    """Canonical composition by the Unicode library that Spark itself compares text with; ASCII text is left alone."""
    return f"""CASE WHEN {s} IS NULL OR octet_length({s}) = char_length({s}) THEN {s}
        ELSE reflect('com.ibm.icu.text.Normalizer', 'compose', {s}, false) END"""


def standard(s: str) -> str:
    return f"trim(BOTH '{_ENDS}' FROM {composed(s)})"


def json_parts(json: str) -> str:
    """Compact JSON text cut at the quotes of its strings: every second part is a name or a text value, the escapes of
    white space resolved in it. ``joined_parts`` is the inverse."""
    text = f"replace(replace({json}, '\\\\\\\\', {_BACKSLASH}), '\\\\\"', {_QUOTE})"
    for escape, character in _ESCAPES.items():
        text = f"replace({text}, {escape}, {character})"
    return f"split({text}, '\"')"


def joined_parts(parts: str) -> str:
    text = f"array_join({parts}, '\"')"
    for escape, character in _ESCAPES.items():
        text = f"replace({text}, {character}, {escape})"
    return f"replace(replace({text}, {_QUOTE}, '\\\\\"'), {_BACKSLASH}, '\\\\\\\\')"


def standard_values(parts: str) -> str:
    """Text values in standard encoding; names, and all that stands between strings, as they are."""
    is_name = f"startswith(coalesce(get({parts}, __i + 1), ''), ':')"
    return f"transform({parts}, (__p, __i) -> IF(__i % 2 = 0 OR {is_name}, __p, {standard('__p')}))"
