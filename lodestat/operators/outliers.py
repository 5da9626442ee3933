"""Outlier rules on quantiles and moments, consensus and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.operators import describe as D


def iqr_fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    return D.fences(O.exact_quantiles(df, columns, {"q25": 0.25, "q75": 0.75}), factor)


def outliers_iqr(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Fences and outlier counts per column."""
    columns = columns or C.numeric_columns(df)
    fence = iqr_fences(df, columns, factor)
    rows = O.long_values(df, columns).join(F.broadcast(fence), "column_name")
    low, high = F.col("value") < F.col("lower_fence"), F.col("value") > F.col("upper_fence")
    counts = rows.groupBy("column_name").agg(
        F.count_if(low).alias("low_outliers"), F.count_if(high).alias("high_outliers"), F.count_if(low | high).alias("outliers")
    )
    return fence.join(counts, "column_name").withColumn("outlier_pct", F.col("outliers") / F.col("n") * 100)


def _any_outside(tests: list[Column]) -> Column:
    return F.coalesce(C.any_of([F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)) if tests else F.lit(False)


def iqr_test(df: DataFrame, fences: dict) -> Column:
    """Outside the fences of any column whose IQR is positive."""
    tests = []
    for c, f in fences.items():
        x = C.number(df, c)
        if f["iqr"] > 0:
            tests.append((x < f["lower_fence"]) | (x > f["upper_fence"]))
    return _any_outside(tests)


def zscore_test(df: DataFrame, basic: dict, threshold: float) -> Column:
    """Largest absolute z over the columns beyond the threshold."""
    return _any_outside(
        [F.abs((C.number(df, c) - b["mean"]) / b["std"]) > threshold for c, b in basic.items() if b["std"]]
    )


def modified_z_test(df: DataFrame, basic: dict, threshold: float) -> Column:
    return _any_outside(
        [F.abs(0.6745 * (C.number(df, c) - b["median"]) / b["mad"]) > threshold for c, b in basic.items() if b["mad"]]
    )


def flag_iqr(df: DataFrame, columns: list[str], flag: str = "is_iqr", factor: float = 1.5) -> DataFrame:
    """Row flag; the fences are one small row per column, so flagging is a narrow map."""
    return df.withColumn(flag, iqr_test(df, C.by_column(iqr_fences(df, columns, factor), columns)))


def flag_zscore(df: DataFrame, columns: list[str], flag: str = "is_zscore", threshold: float = 3.0) -> DataFrame:
    return df.withColumn(flag, zscore_test(df, C.by_column(D.single_pass_stats(df, columns), columns), threshold))


def flag_modified_z(df: DataFrame, columns: list[str], flag: str = "is_modified_z", threshold: float = 3.5) -> DataFrame:
    return df.withColumn(flag, modified_z_test(df, C.by_column(D.median_deviation(df, columns), columns), threshold))


def outliers_zscore(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    columns = columns or C.numeric_columns(df)
    basic = D.single_pass_stats(df, columns).select("column_name", "n", "mean", "std")
    z = F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("std")))
    rows = O.long_values(df, columns).join(F.broadcast(basic), "column_name")
    counts = rows.groupBy("column_name").agg(F.count_if(z > threshold).alias("outliers"), F.max(z).alias("max_z"))
    return basic.join(counts, "column_name").withColumn("outlier_pct", F.col("outliers") / F.col("n") * 100)


def outliers_modified_z(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.5) -> DataFrame:
    columns = columns or C.numeric_columns(df)
    basic = D.median_deviation(df, columns)
    z = F.abs(F.try_divide(0.6745 * (F.col("value") - F.col("median")), F.col("mad")))
    rows = O.long_values(df, columns).join(F.broadcast(basic), "column_name")
    counts = rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(z > threshold).alias("outliers"))
    return basic.join(counts, "column_name").withColumn("outlier_pct", F.col("outliers") / F.col("n") * 100)


def flag_all(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    tests = {
        "is_iqr": iqr_test(df, C.by_column(iqr_fences(df, columns), columns)),
        "is_zscore": zscore_test(df, C.by_column(D.single_pass_stats(df, columns), columns), 3.0),
        "is_modified_z": modified_z_test(df, C.by_column(D.median_deviation(df, columns), columns), 3.5),
    }
    return df.withColumns(tests), list(tests)


def with_votes(flagged: DataFrame, flags: list[str]) -> DataFrame:
    votes = C.total([F.col(f).cast("int") for f in flags])
    return flagged.withColumn("votes", votes).withColumns(
        {"consensus": F.col("votes") >= len(flags) // 2 + 1, "unanimous": F.col("votes") == len(flags)}
    )


def outlier_consensus(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per number of votes, with majority and unanimity marks."""
    flagged, flags = flag_all(df, columns)
    return (
        with_votes(flagged, flags)
        .groupBy("votes", "consensus", "unanimous")
        .agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    )


def intersect_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that every method flags."""
    flagged, flags = flag_all(df, columns)
    return flagged.where(C.total([F.col(f).cast("int") for f in flags]) == len(flags)).drop(*flags)


def outlier_impact(df: DataFrame, columns: list[str]) -> DataFrame:
    """Outlier against normal mean and effect size (normal std) per column and method."""
    flagged, flags = flag_all(df, columns)
    structs = []
    for f in flags:
        for c in columns:
            x = C.number(df, c)
            inside, outside = F.when(~F.col(f), x), F.when(F.col(f), x)
            structs.append(
                F.struct(
                    F.lit(f[3:]).alias("method"),
                    F.lit(c).alias("column_name"),
                    F.count(outside).alias("n_outliers"),
                    F.avg(outside).alias("outlier_mean"),
                    F.avg(inside).alias("normal_mean"),
                    C.ratio(F.abs(F.avg(outside) - F.avg(inside)), F.stddev_samp(inside)).alias("effect_size"),
                )
            )
    return flagged.agg(F.array(*structs).alias("_r")).select(F.inline("_r")).where("n_outliers > 0")


def _is_infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def infinite_and_extreme(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinities and values beyond three std per column."""
    columns = columns or C.numeric_columns(df)

    def metrics(d, c):
        x = C.number(d, c)
        return [F.count_if(_is_infinite(x)).alias("infinite"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")]

    basic = C.per_column(df, columns, metrics)
    rows = O.long_values(df, columns).join(F.broadcast(basic), "column_name")
    far = (F.col("std") > 0) & (F.abs(F.col("value") - F.col("mean")) > 3 * F.col("std"))
    counts = rows.groupBy("column_name").agg(F.count_if(far).alias("extreme"))
    return basic.join(counts, "column_name", "left").select("column_name", "infinite", F.coalesce("extreme", F.lit(0)).alias("extreme"))
