"""The queries by name, with the SQL that each must match where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:  # like rounded(): -0.0 is 0.0
            ORACLE_SQL[key] = re.sub(r", (\d+)\) AS ", r", \1) + 0 AS ", sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, so that the order of sums doesn't show; -0.0 is 0.0."""
    return df.select(*((F.round(F.col(f.name), digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))
