"""Named queries: a Spark plan and, where SQL can express it, the DuckDB text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Catalog:
    def __init__(self) -> None:
        self.items: dict[str, Query] = {}

    def query(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.items[f.__name__] = Query(f.__name__, f, sql)
            return f

        return add


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: DuckDB expressions for words and content words of ``text``.
WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
TOKENS = f"list_filter({WORDS}, lambda w: len(w) > 2 AND NOT list_contains({sql_list(T.STOP_WORDS)}, w))"
