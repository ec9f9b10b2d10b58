"""Small helpers for writing SQL text."""

from __future__ import annotations


def text_literal(s: str) -> str:
    if "'" not in s:
        return f"r'{s}'"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(s: str, pattern: str) -> str:
    return f"({s} rlike {text_literal(pattern)})"


def words(values: list[str]) -> str:
    return ", ".join(text_literal(v) for v in values)


def named(columns: dict[str, str]) -> list[str]:
    """``{name: expression}`` as select items."""
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
