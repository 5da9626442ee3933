"""User functions on groups, chunks and columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def groupby_apply(df: DataFrame, keys: list[str], fn: Callable, schema: str, salt: int = 1, combine: Callable | None = None) -> DataFrame:
    """``fn(pandas) -> pandas`` per group.

    With ``salt`` above one a group is cut into that many parts by row hash,
    and ``combine(DataFrame) -> DataFrame`` merges the partial rows; use it
    when one key may hold a large share of the rows.
    """
    if salt <= 1:
        return df.groupBy(*keys).applyInPandas(fn, schema)
    part = F.pmod(F.xxhash64(*df.columns), F.lit(salt)).alias("_salt")
    cut = df.withColumn("_salt", part)
    out = cut.groupBy(*keys, "_salt").applyInPandas(lambda pdf: fn(pdf.drop(columns="_salt")), schema)
    return combine(out) if combine else out


def chunk_apply(df: DataFrame, fn: Callable, schema: str, combine: Callable | None = None) -> DataFrame:
    """``fn(pandas) -> pandas`` per Arrow batch, no shuffle; optional final aggregation."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    out = df.mapInPandas(run, schema)
    return combine(out) if combine else out


def column_apply(df: DataFrame, columns: list[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def feature_functions(df: DataFrame, functions: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for f in functions:
        df = df.transform(f)
    return df
