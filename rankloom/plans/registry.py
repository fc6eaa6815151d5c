"""Named queries: a Spark builder plus, where SQL can say it, an oracle query.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame that reads
the whole landed tables. The oracle text is DuckDB SQL over the same tables
(registered as views under their own names); it is used only for checking.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def ts_text(c, micros: bool = False) -> Column:
    """Render a timestamp as ``yyyy-MM-dd HH:mm:ss[.ffffff]`` text for result sets."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS" if micros else "yyyy-MM-dd HH:mm:ss")


def sql_ts_text(expr: str, micros: bool = False) -> str:
    return f"strftime({expr}, '{'%Y-%m-%d %H:%M:%S.%f' if micros else '%Y-%m-%d %H:%M:%S'}')"
