"""Literals, names and aliases."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def literal(value: str | float | None) -> str:
    """A value as Spark SQL writes it."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def listed(values: Iterable[str]) -> str:
    return ", ".join(literal(value) for value in values)


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def aliased(expressions: Mapping[str, str]) -> list[str]:
    """`expression AS name` for each name."""
    return [f"{expression} AS {name(column)}" for column, expression in expressions.items()]
