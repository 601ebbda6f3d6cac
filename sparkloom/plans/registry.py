"""Registration of queries together with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widen(df: DataFrame) -> DataFrame:
    """Counts as BIGINT, whatever function they come from."""
    return df.select([F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, IntegerType) else F.col(f.name) for f in df.schema])


def double_literals(sql: str) -> str:
    """Decimal literals as DOUBLE ones: plain ones would be computed with as DECIMALs."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)


class Registry:
    def __init__(self, doubles: bool = False):
        self.doubles = doubles
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function (spark, sf_dir) under its name."""

        def put(f: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return widen(f(spark, sf_dir))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql is not None:
                self.oracles[f.__name__] = double_literals(sql) if self.doubles else sql
            return f

        return put
