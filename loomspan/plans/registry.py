"""Name -> query and name -> oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Look-ahead free forms of the token grammar, for SQL.
SQL_WORD = r"[\p{L}\p{M}_](?:[\p{L}\p{M}\p{N}_]|[''’‐‑\-][\p{L}\p{M}\p{N}_])*"
SQL_NUMBER = rf"\p{{N}}(?:\p{{N}}|[.,:/\-٫٬]\p{{N}})*(?:[''’]{SQL_WORD})?"
SQL_TOKEN = rf"{SQL_NUMBER}|{SQL_WORD}|[ \t\x0b\f\x{{a0}}]+|[\r\n]+"


def register(sql: str | None = None):
    """Register a query under its function's name."""

    def wrap(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return wrap
