"""Collecting queries: a name, a function of the views, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from kinfold.plans.fixtures import oracle, view

Views = Callable[[str], DataFrame]


class Queries:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, f: Callable[[Views], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, folder: f(lambda x: view(spark, folder, x))
        if sql:
            self.oracles[name] = oracle(sql)

    def scalar(self, name: str, table: str, inputs: str, f: Callable[[], Column], sql: str, key: str = "id") -> None:
        """A function of columns that `inputs` derives (SQL of both engines, and `=> ` splits off another form for DuckDB)."""
        ours, _, theirs = inputs.partition(" => ")
        self.add(name, lambda v: v(table).selectExpr(f"{key} AS id", *_split(ours)).select("id", f().alias("result")), f"SELECT id, {sql} AS result FROM (SELECT {key} AS id, {theirs or ours} FROM {{{table}}}) t")


def _split(text: str) -> list[str]:
    """Comma-separated SQL columns, commas within brackets or quotes apart."""
    out, depth, quoted, now = [], 0, False, ""
    for c in text:
        quoted ^= c == "'"
        depth += (c in "([") * (not quoted) - (c in ")]") * (not quoted)
        if c == "," and not depth and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]
