"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import load
from .derived import frame, with_clause

def _filtered_counts(sql: str) -> str:
    """Spell ``count_if(c)`` as a filtered count, which DuckDB types BIGINT like Spark does."""
    mark, out = "count_if(", sql
    while mark in out:
        start = out.index(mark)
        at, depth, quoted = start + len(mark), 1, False
        while depth:
            c = out[at]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            at += 1
        inner = out[start + len(mark) : at - 1]
        out = f"{out[:start]}count(*) FILTER (WHERE {inner}){out[at:]}"
    return out


Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries take named input frames; the oracle sees the same inputs as a WITH clause."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, *inputs: str, sql: str | None = None, name: str | None = None, read=load):
        def register(build: Callable[..., DataFrame]):
            key = name or build.__name__
            if key in self.queries:
                raise ValueError(f"query registered twice: {key}")

            def run(spark: SparkSession, folder: str) -> DataFrame:
                return build(*[frame(spark, folder, i, read) for i in inputs])

            self.queries[key] = run
            if sql is not None:
                clause = with_clause(*inputs)
                body = sql.strip()
                if clause and body.upper().startswith("WITH "):
                    recursive = body.upper().startswith("WITH RECURSIVE ")
                    body = "," + body[15 if recursive else 5:]
                    clause = clause.rstrip()
                    if recursive:
                        clause = clause.replace("WITH ", "WITH RECURSIVE ", 1)
                self.oracles[key] = _filtered_counts(clause + body)
            return build

        return register
