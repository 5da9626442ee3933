"""Registry of named queries over the shared test tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy readers for one data folder: ``t.lineitem`` and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def lineitem_nulls(self) -> DataFrame:
        return self.lineitem.withColumns(
            {
                "l_quantity": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")),
                "l_returnflag": F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag")),
            }
        )

    @property
    def orders_dup(self) -> DataFrame:
        orders = self.orders
        return orders.unionByName(orders.where("o_orderkey % 20 = 0"))

    @property
    def orders_daily(self) -> DataFrame:
        day = F.to_date("o_orderdate").alias("d")
        return self.orders.groupBy(day).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"))

    @property
    def events_daily(self) -> DataFrame:
        """One series per event type: number of events and mean value per day."""
        day = F.to_date("ts").alias("d")
        return self.events.groupBy("event_type", day).agg(
            F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("y"), F.count(F.lit(1)).alias("n")
        )


# SQL texts of the derived tables above
LINEITEM_NULLS = (
    "(SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, "
    "CASE WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS l_returnflag) FROM lineitem)"
)
ORDERS_DUP = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 20 = 0)"
ORDERS_DAILY = (
    "(SELECT CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y "
    "FROM orders GROUP BY 1)"
)
EVENTS_DAILY = (
    "(SELECT event_type, CAST(ts AS DATE) AS d, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS y, "
    "count(*) AS n FROM events GROUP BY 1, 2)"
)


def long_sql(table: str, columns: list[str], keys: list[str] | None = None) -> str:
    """``(keys..., column_name, value)`` as SQL, missing values kept."""
    head = "".join(f"{k}, " for k in keys or [])
    parts = [f"SELECT {head}'{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {table} s" for c in columns]
    return "(" + " UNION ALL ".join(parts) + ")"


def tidy(df: DataFrame, approx: tuple[str, ...] | None = None) -> DataFrame:
    """Doubles to nine digits, so that summation order does not show."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    names = [c for c in floats if approx is None or c in approx]

    def short(c):
        # the tiny factor moves exact decimal ties off the rounding edge in both engines
        near = F.when(F.abs(c) < 1e-10, F.lit(0.0)).otherwise(F.col(c).cast("double") * 1.000000000001)
        return F.format_string("%.8e", near).try_cast("double").alias(c)

    return df.select(*[short(c) if c in names else F.col(c) for c in df.columns])


def query(name: str, sql: str | None = None, approx: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame``; ``approx`` columns are compared to nine digits."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return tidy(out, tuple(c.strip(chr(34)) for c in approx)) if approx else out

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            if approx:
                swap = ", ".join(f"CAST(printf('%.8e', CASE WHEN abs({c}) < 1e-10 THEN 0.0 ELSE CAST({c} AS DOUBLE) * CAST(1.000000000001 AS DOUBLE) END) AS DOUBLE) AS {c}" for c in approx)
                SQL[name] = f"SELECT * REPLACE ({swap}) FROM ({sql}) final"
            else:
                SQL[name] = sql
        return fn

    return register
