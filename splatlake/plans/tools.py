"""How queries are registered: a Spark callable and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..adapters import CTE, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``f(load) -> DataFrame``; ``load(view)`` reads a view. ``oracle`` goes on from the adapters' CTE."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
        if oracle:
            text, head = oracle.strip(), CTE
            if text.startswith("with recursive "):
                text, head = "with " + text[15:], CTE.replace("with ", "with recursive ", 1)
            ORACLES[name] = f"{head}, {text[5:]}" if text.startswith("with ") else f"{head} {text}"
        return f

    return add


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({expr}, {digits}) + 0e0)"


def rounded(columns: dict[str, str] | list[str] | tuple[str, ...], digits: int = 6) -> list[str]:
    items = columns.items() if isinstance(columns, dict) else [(c, c) for c in columns]
    return [f"{r(e, digits)} as {n}" for n, e in items]


def pick(name: str, source: str, exprs: list[str], where: str | None = None) -> None:
    """A query that is a projection of a view, the same text in both dialects."""
    tail = f" where {where}" if where else ""
    query(name, f"select {', '.join(exprs)} from {source}{tail}")(lambda load: (load(source).where(where) if where else load(source)).selectExpr(*exprs))
