"""Whole-table profiles assembled from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.operators import correlate as R
from lodestat.operators import describe as D
from lodestat.operators import outliers as X
from lodestat.operators import quality as Q
from lodestat.operators import typing as Y


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, metric, value)``: moments, missing counts, quartiles, IQR outliers."""
    columns = columns or C.numeric_columns(df)

    def metrics(d, c):
        x = C.number(d, c)
        return [
            F.count(x).cast("double").alias("n"),
            F.count_if(C.missing(d, c)).cast("double").alias("missing"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.skewness(x).alias("skewness"),
            F.kurtosis(x).alias("kurtosis"),
        ]

    basic = C.per_column(df, columns, metrics)
    ranked = O.value_ranks(O.long_values(df, columns), ["column_name"])
    quarts = O.pick_quantiles(ranked, ["column_name"], O.QUARTILES).drop("n")
    # outliers from the counted values: no second pass over the rows
    edges = D.fences(quarts)
    out = ranked.join(F.broadcast(edges.select("column_name", "lower_fence", "upper_fence")), "column_name")
    far = (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))
    hits = out.groupBy("column_name").agg(F.sum(F.when(far, F.col("cnt")).otherwise(0)).cast("double").alias("outliers"))
    wide = basic.join(quarts, "column_name").join(hits, "column_name")
    return C.to_metric_rows(wide, ["column_name"], [c for c in wide.columns if c != "column_name"])


def data_profile(df: DataFrame, top: int = 3) -> DataFrame:
    """``(column_name, metric, value)`` as text: type, counts, numeric and text profile, top values, correlations."""
    numeric, strings = C.numeric_columns(df), C.string_columns(df)
    num = F.format_string

    def text(c):
        return num("%.6g", c.cast("double"))

    kinds = Y.column_summary(df)
    base = kinds.select(
        "column_name", F.col("base").alias("type"), F.col("n_rows").cast("string").alias("count"),
        F.format_string("%.2f", C.ratio(F.col("n_null"), F.col("n_rows")) * 100).alias("null_pct"), F.col("n_distinct").cast("string").alias("distinct"),
    ).unpivot(["column_name"], ["type", "count", "null_pct", "distinct"], "metric", "value")
    out = base
    if numeric:
        rows = D.numeric_profile(df, numeric)
        names = ["mean", "std", "min", "median", "max"]
        out = out.unionByName(rows.select("column_name", *[text(F.col(c)).alias(c) for c in names]).unpivot(["column_name"], names, "metric", "value"))
    if strings:
        def lengths(d, c):
            n = F.length(F.col(f"`{c}`"))
            return [F.min(n).cast("string").alias("min_length"), F.max(n).cast("string").alias("max_length"), text(F.avg(n)).alias("avg_length")]

        rows = C.per_column(df, strings, lengths)
        out = out.unionByName(rows.unpivot(["column_name"], ["min_length", "max_length", "avg_length"], "metric", "value"))
        best = D.categorical_stats(df, strings, top).where("rank is not null")
        out = out.unionByName(best.select("column_name", F.concat(F.lit("top_"), F.col("rank").cast("string")).alias("metric"), F.concat_ws(":", "value", F.col("cnt").cast("string")).alias("value")))
    if len(numeric) > 1:
        pairs = R.corr_pearson(df, numeric)
        out = out.unionByName(pairs.select(F.col("column_a").alias("column_name"), F.concat(F.lit("corr_"), F.col("column_b")).alias("metric"), text(F.col("r")).alias("value")))
    return out


def dashboard_overview(df: DataFrame) -> DataFrame:
    """``(column_name, metric, value)``: shape, column kinds, missing share, duplicates, IQR outliers per column."""
    numeric = C.numeric_columns(df)
    whole = Q.missing_summary(df).crossJoin(Q.duplicate_count(df)).select(
        F.lit("*").alias("column_name"),
        F.col("n_rows").cast("double").alias("rows"),
        F.lit(float(len(df.columns))).alias("columns"),
        F.lit(float(len(numeric))).alias("numeric_columns"),
        F.lit(float(len(C.string_columns(df)))).alias("text_columns"),
        F.lit(float(len(C.temporal_columns(df)))).alias("datetime_columns"),
        F.col("missing_pct"),
        F.col("n_duplicates").cast("double").alias("duplicates"),
    )
    out = C.to_metric_rows(whole, ["column_name"], [c for c in whole.columns if c != "column_name"])
    if numeric:
        out = out.unionByName(X.outliers_iqr(df, numeric).select("column_name", F.lit("iqr_outliers").alias("metric"), F.col("outliers").cast("double").alias("value")))
    return out


def insights(df: DataFrame) -> DataFrame:
    """Rule rows ``(type, column_name, value, severity)``."""
    numeric = C.numeric_columns(df)
    schema = "type string, column_name string, value double, severity string"

    def rows(frame, kind, value, severity, test):
        return frame.where(test).select(F.lit(kind).alias("type"), "column_name", value.cast("double").alias("value"), severity.alias("severity"))

    miss = Q.missing_by_column(df)
    pct = F.col("missing_pct")
    out = df.sparkSession.createDataFrame([], schema)
    out = out.unionByName(rows(miss, "missing", pct, F.when(pct > 50, "high").otherwise("medium"), pct > 20))
    if numeric:
        shape = D.distribution_shape(df, numeric)
        cv, sk = F.abs("cv"), F.abs("skewness")
        out = out.unionByName(rows(shape, "high variation", cv, F.lit("medium"), cv > 1))
        out = out.unionByName(rows(shape, "skewed", F.col("skewness"), F.when(sk > 2, "high").otherwise("medium"), sk > 1))
        far = X.outliers_iqr(df, numeric)
        share = F.col("outlier_pct")
        out = out.unionByName(rows(far, "outliers", share, F.lit("medium"), share > 10))
    if len(numeric) > 1:
        pairs = R.corr_pearson(df, numeric).withColumn("column_name", F.concat_ws("|", "column_a", "column_b"))
        out = out.unionByName(rows(pairs, "multicollinearity", F.col("r"), F.lit("high"), F.abs("r") > 0.9))
    return out
