"""The queries of the library: name -> callable, inventory ids, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loamwork.functions import fixed


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    ids: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(run, ids, sql)
        return run

    return add


def duck_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def duck_map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def duck_tokens(x: str) -> str:
    """ranking_tokens in DuckDB."""
    return (
        f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(replace({x}, '_', ' ')), '[a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains({duck_list(fixed.STOP_WORDS)}, t)),"
        f" lambda t: coalesce({duck_map(fixed.TOKEN_ALIASES)}[t], t)))"
    )


def duck_name(x: str) -> str:
    return f"lower(regexp_extract({x}, '([^/]*)$', 1))"


def duck_language(x: str) -> str:
    return f"coalesce({duck_map(fixed.LANGUAGE_BY_NAME)}[{duck_name(x)}], {duck_map(fixed.LANGUAGE_BY_EXTENSION)}[regexp_extract({duck_name(x)}, '^.+(\\.[^.]+)$', 1)])"
