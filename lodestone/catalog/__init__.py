"""Named queries of the reference operators over the standard tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


class Derived:
    """Rows that Spark and DuckDB derive from a standard table: columns by name, as expressions that mean the same to both.

    An expression that they write differently is a pair, Spark's first.
    """

    def __init__(self, table: str, where: str = "TRUE", **columns: str | tuple[str, str]) -> None:
        self.table, self.where, self.columns = table, where, columns

    def _expressions(self, which: int) -> list[str]:
        return [f"{e if isinstance(e, str) else e[which]} AS {n}" for n, e in self.columns.items()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(self.where).selectExpr(*self._expressions(0))

    @property
    def sql(self) -> str:
        """A subquery."""
        return f"(SELECT {', '.join(self._expressions(1))} FROM {self.table} WHERE {self.where})"


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


def strip_sql(column: str) -> str:
    return rf"regexp_replace({column}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
