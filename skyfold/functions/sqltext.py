"""Quoting of names and texts inside SQL expressions."""

from __future__ import annotations


def identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(texts) -> str:
    return ", ".join(literal(text) for text in texts)
