"""Registration of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def flat(df: DataFrame) -> DataFrame:
    """Plain result columns: doubles rounded to 6 places, times and lists as text."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("double", "float"):
            col = F.round(col.cast("double"), 6)
        elif kind.startswith("timestamp"):
            col = F.date_format(col, TIME_FORMAT)
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind.startswith("array"):
            col = F.concat_ws(",", col)
        out.append(col.alias(name))
    return df.select(*out)


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(fn(configure(spark), sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# Pieces of SQL text shared by the checks.
def rounded(expression: str) -> str:
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0.0e0)"


def time_text(expression: str) -> str:
    return f"strftime(CAST({expression} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')"


def day_text(expression: str) -> str:
    return f"strftime(CAST({expression} AS DATE), '%Y-%m-%d')"
