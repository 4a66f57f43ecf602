"""Registry of named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barline.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, tuple[str, str, bool]] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: str, body: str) -> None:
    """Declare a SQL building block that oracle queries can list in ``needs``."""
    VIEWS[name] = (tuple(needs.split()), body.strip())


def _with(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def sql_text(needs: str, body: str, recursive: bool = False) -> str:
    parts = [f"{n} AS (\n{VIEWS[n][1]}\n)" for n in _with(tuple(needs.split()))]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        body = body[5:]
        return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + ",\n" + body
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, needs: str = "", sql: str | None = None, recursive: bool = False):
    """Register a Spark query and, when given, its oracle SQL."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = (needs, sql, recursive)
        return fn

    return register


def oracle() -> dict[str, str]:
    """Complete SQL text per query, with the building blocks it needs in front."""
    return {name: sql_text(*spec) for name, spec in ORACLE.items()}
