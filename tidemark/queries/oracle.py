"""Shared SQL fragments of the DuckDB twins and a small composer for them."""

from __future__ import annotations

import re

GRID_CUT = 0.4871
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def sql(body: str) -> str:
    """Prefix `body` with every CTE it needs, in dependency order."""
    ordered: list[str] = []

    def need(text: str, inside: tuple[str, ...] = ()) -> None:
        for name in CTES:
            if name not in ordered and name not in inside and re.search(rf"\b{name}\b", text):
                need(CTES[name], (*inside, name))
                ordered.append(name)

    need(body)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in ordered)
    own = re.match(r"\s*WITH\s", body)
    return f"WITH {parts},\n{body[own.end():]}" if own else f"WITH {parts}\n{body}"


def rnd(expr: str, digits: int = 6) -> str:
    """Double on a decimal grid, by the same arithmetic steps as on the Spark side.

    Sums differ in the last bits between engines. The cut between two grid points is kept
    off one half, where averages of short decimals fall exactly.
    """
    return f"floor(({expr}) * 1e{digits} + {GRID_CUT}::DOUBLE) / 1e{digits}"


def rounded(columns, digits: int = 6, alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(f"{rnd(p + c, digits)} AS {c}" for c in columns)


def in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case_map(values: dict, key: str, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items())
    return f"CASE {key} {arms} ELSE {default} END"
