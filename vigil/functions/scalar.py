"""SQL snippets that Spark and other ANSI engines evaluate alike."""

from __future__ import annotations

from collections.abc import Mapping


def num(x: float) -> str:
    """A double literal (plain decimals would be exact decimals)."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def rounded(x: str, places: int = 4) -> str:
    """Rounded after a nudge far below the last place, so that ties of the decimal text fall the same way everywhere."""
    return f"round(({x}) + 1e-9, {places})"


def lookup(column: str, table: Mapping[str, float], default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {num(v)}" for k, v in table.items()) + f" ELSE {num(default)} END"


def listed(*conditional: tuple[str, str]) -> str:
    """Comma-joined names whose condition holds."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conditional) + ")"
