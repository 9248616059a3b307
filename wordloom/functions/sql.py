"""Literals for expressions that are written as SQL text.

Expressions with hundreds of rules are put together as text and parsed once by Spark;
building them call by call takes far longer than running them.
"""

from __future__ import annotations

from collections.abc import Iterable


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(expr: str, words: Iterable[str]) -> str:
    """`expr IN (..)`; false for an empty list."""
    listed = ", ".join(map(lit, words))
    return f"{expr} IN ({listed})" if listed else "false"


def case(whens: Iterable[tuple[str, str]], otherwise: str) -> str:
    text = " ".join(f"WHEN {condition} THEN {value}" for condition, value in whens)
    return f"CASE {text} ELSE {otherwise} END" if text else otherwise
