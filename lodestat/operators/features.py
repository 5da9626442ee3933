"""Feature scaling, encoding, generation, selection and reduction."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.functions import tails
from lodestat.operators import correlate as R
from lodestat.operators import describe as D


def scale_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std; the statistics are one small row per column."""

    def metrics(d, c):
        return [F.avg(C.number(d, c)).alias("mean"), F.stddev_pop(C.number(d, c)).alias("std")]

    stats = C.by_column(C.per_column(df, columns, metrics), columns)
    return df.withColumns({c: (C.number(df, c) - s["mean"]) / (s["std"] or 1.0) for c, s in stats.items() if s["mean"] is not None})


def scale_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    def metrics(d, c):
        return [F.min(C.number(d, c)).alias("low"), F.max(C.number(d, c)).alias("high")]

    stats = C.by_column(C.per_column(df, columns, metrics), columns)
    return df.withColumns(
        {c: (C.number(df, c) - s["low"]) / ((s["high"] - s["low"]) or 1.0) for c, s in stats.items() if s["low"] is not None}
    )


def scale_robust(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = C.by_column(O.exact_quantiles(df, columns), columns)
    return df.withColumns({c: (C.number(df, c) - s["median"]) / ((s["q75"] - s["q25"]) or 1.0) for c, s in stats.items()})


SCALERS = {"standard": scale_standard, "minmax": scale_minmax, "robust": scale_robust}


def compare_scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, std, min and max per column before and after each scaling."""
    out = D.single_pass_stats(df, columns).withColumn("scaling", F.lit("none"))
    for name, scale in SCALERS.items():
        out = out.unionByName(D.single_pass_stats(scale(df, columns), columns).withColumn("scaling", F.lit(name)))
    return out


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: index of the sorted distinct value, null as ``missing``."""
    kinds = df.select(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("value")).distinct()
    return O.with_position(kinds, ["value"], None, "code", None)


def encode_label(df: DataFrame, columns: list[str], suffix: str = "_code") -> DataFrame:
    out = df
    for c in columns:
        codes = label_codes(df, c).withColumnRenamed("code", f"{c}{suffix}")
        key = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        out = out.withColumn("_k", key).join(codes.withColumnRenamed("value", "_k"), "_k").drop("_k")
    return out


def encode_onehot(df: DataFrame, column: str, max_columns: int = 2000, null_indicator: bool = False, drop_first: bool = False) -> DataFrame:
    """A 0/1 column per value. More values than a table can have as columns are an error: :func:`encode_onehot_long` takes any number."""
    kinds = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_columns + 1).collect()]
    if len(kinds) > max_columns:
        raise ValueError(f"{column} has more than {max_columns} values; use encode_onehot_long")
    kinds = sorted(kinds)[1 if drop_first else 0 :]
    flags = {f"{column}_{k}": F.coalesce((F.col(column) == k).cast("int"), F.lit(0)) for k in kinds}
    if null_indicator:
        flags[f"{column}_null"] = F.col(column).isNull().cast("int")
    return df.withColumns(flags).drop(column)


def encode_onehot_long(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One-hot vectors as long rows ``(keys..., index, value, flag)``: the places of a row that are 1, whatever the number of values."""
    codes = label_codes(df, column).withColumnRenamed("code", "index")
    value = F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("value")
    return df.select(*keys, value).join(codes, "value").select(*keys, "index", "value", F.lit(1).alias("flag"))


def polynomial(df: DataFrame, columns: list[str]) -> DataFrame:
    """Degree-2 products of the columns."""
    made = {}
    for a, b in combinations_with_replacement(columns, 2):
        made[f"{a}_sq" if a == b else f"{a}_x_{b}"] = C.number(df, a) * C.number(df, b)
    return df.withColumns(made)


def interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": C.number(df, a) * C.number(df, b) for a, b in combinations(columns, 2)})


def score_f_classif(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """ANOVA F per column from one grouped aggregation over the classes."""

    def metrics(d, c):
        x = C.number(d, c)
        return [F.count(x).cast("double").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")]

    g = C.per_column(df.where(F.col(target).isNotNull()), columns, metrics, [target])
    n, m = F.col("n"), F.col("m")
    s = g.groupBy("column_name").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(n * F.col("v")).alias("within"),
        (F.sum(n * m * m) - F.sum(n * m) ** 2 / F.sum(n)).alias("between"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return s.select("column_name", C.ratio(F.col("between") / d1, F.col("within") / d2).alias("score"), d1.alias("d1"), d2.alias("d2"))


def score_f_regression(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    y = C.number(df, target)

    def metrics(d, c):
        x = C.number(d, c)
        return [C.corr(x, y).alias("r"), F.count_if(x.isNotNull() & y.isNotNull()).alias("n")]

    r2 = F.col("r") ** 2
    rows = C.per_column(df, columns, metrics)
    return rows.select(
        "column_name", C.ratio(r2 * (F.col("n") - 2), 1 - r2).alias("score"), F.lit(1).cast("long").alias("d1"), (F.col("n") - 2).alias("d2")
    )


def score_chi2(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Chi-square of class sums against the class shares, for non-negative columns."""

    def metrics(d, c):
        return [F.sum(C.number(d, c)).alias("o"), F.count(F.lit(1)).alias("n")]

    g = C.per_column(df.where(F.col(target).isNotNull()), columns, metrics, [target])
    whole = Window.partitionBy("column_name")  # one row per class and column
    e = F.sum("o").over(whole) * F.col("n") / F.sum("n").over(whole)
    cells = g.withColumn("e", e)
    s = cells.groupBy("column_name").agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("score"), (F.count(F.lit(1)) - 1).alias("d1"))
    return s.withColumn("d2", F.lit(None).cast("long"))


SCORES = {"f_classif": score_f_classif, "f_regression": score_f_regression, "chi2": score_chi2}


def select_k_best(df: DataFrame, columns: list[str], target: str, score: str = "f_classif", k: int | None = None) -> DataFrame:
    """Columns ranked by score with the chosen ones marked; k is min(5, m) unless given."""
    k = k or min(5, len(columns))
    rows = SCORES[score](df, columns, target)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("score"), "column_name")  # one row per column
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("selected", F.col("rank") <= k)


def select_p_values(scores: DataFrame) -> DataFrame:
    return scores.withColumn(
        "p_value", F.when(F.col("d2").isNotNull(), tails.f_above(F.col("score"), F.col("d1"), F.col("d2"))).otherwise(tails.chi2_above(F.col("score"), F.col("d1")))
    )


def select_by_variance(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    def metrics(d, c):
        return [F.var_pop(C.number(d, c)).alias("variance")]

    return C.per_column(df, columns, metrics).withColumn("selected", F.col("variance") > threshold)


def select_by_correlation(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    """The later column of a pair above the threshold is dropped."""
    pairs = R.corr_pearson(df, columns).where(F.abs("r") > threshold)
    gone = pairs.groupBy(F.col("column_b").alias("column_name")).agg(F.max(F.abs("r")).alias("max_r"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(gone, "column_name", "left").withColumn("selected", F.col("max_r").isNull())


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    clean = scale_standard(df.dropna(subset=columns), columns)
    return VectorAssembler(inputCols=columns, outputCol="_features").transform(clean)


def pca_fit(df: DataFrame, columns: list[str], k: int | None = None):
    return PCA(k=k or len(columns), inputCol="_features", outputCol="_scores").fit(_assembled(df, columns))


def pca_variance(df: DataFrame, columns: list[str], k: int | None = None) -> DataFrame:
    """Explained and cumulative variance per component; the model has one row per column."""
    share = pca_fit(df, columns, k).explainedVariance.toArray()
    rows = [(i + 1, float(v), float(v * len(columns)), float(c)) for i, (v, c) in enumerate(zip(share, np.cumsum(share)))]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, eigenvalue double, cumulative double")


def pca_loadings(df: DataFrame, columns: list[str], k: int | None = None) -> DataFrame:
    model = pca_fit(df, columns, k)
    m, share = model.pc.toArray(), model.explainedVariance.toArray()
    rows = [(j + 1, c, float(m[i, j]), float(share[j])) for i, c in enumerate(columns) for j in range(m.shape[1])]
    return df.sparkSession.createDataFrame(rows, "component int, column_name string, loading double, explained double")


def pca(df: DataFrame, columns: list[str], k: int | None = None, variance: float | None = None) -> DataFrame:
    """Rows with their component scores ``pc_1..pc_k``; k given or by the variance share."""
    model = pca_fit(df, columns, k)
    keep = k or len(columns)
    if variance is not None:
        keep = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), variance - 1e-12) + 1)
    out = model.transform(_assembled(df, columns)).withColumn("_a", vector_to_array("_scores"))
    return out.withColumns({f"pc_{i + 1}": F.col("_a")[i] for i in range(min(keep, len(columns)))}).drop("_features", "_scores", "_a")


def pca_components_choice(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of components by 80 % and 90 % variance, Kaiser, elbow, and their median."""
    v = pca_variance(df, columns)
    w = Window.partitionBy(F.lit(0)).orderBy("component")  # one row per column
    v = v.withColumn("drop", F.lag("explained").over(w) - F.col("explained"))
    one = v.agg(
        F.min(F.when(F.col("cumulative") >= 0.8 - 1e-12, F.col("component"))).alias("by_80"),
        F.min(F.when(F.col("cumulative") >= 0.9 - 1e-12, F.col("component"))).alias("by_90"),
        F.greatest(F.count_if(F.col("eigenvalue") > 1), F.lit(1)).cast("int").alias("kaiser"),
        F.coalesce(F.max_by(F.col("component") - 1, "drop"), F.lit(1)).cast("int").alias("elbow"),
    )
    four = F.array_sort(F.array("by_80", "by_90", "kaiser", "elbow"))
    pick = F.floor((F.element_at(four, 2) + F.element_at(four, 3)) / 2).cast("int")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    out = one.crossJoin(n).withColumn("recommended", pick)
    per = F.col("n") / F.lit(len(columns))
    return out.select(
        "by_80",
        "by_90",
        "kaiser",
        "elbow",
        "recommended",
        (1 - F.col("recommended") / F.lit(len(columns))).alias("reduction"),
        per.alias("rows_per_column"),
        F.when(per >= 10, "good").when(per >= 5, "fair").otherwise("poor").alias("suitability"),
    )


def pca_contributions(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Largest loadings per component with the variance-weighted ranking of columns."""
    rows = pca_loadings(df, columns)
    by = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "column_name")
    total = rows.groupBy("column_name").agg(F.sum(F.abs("loading") * F.col("explained")).alias("contribution"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("contribution"), "column_name")
    total = total.withColumn("column_rank", F.row_number().over(order))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).join(total, "column_name")


def feature_chain(df: DataFrame, steps: list, target: str | None = None, key: list[str] | None = None) -> DataFrame:
    """Apply feature steps to everything but the target, then attach the target again by key."""
    if target is None:
        out = df
        for step in steps:
            out = step(out)
        return out
    out = df.drop(target)
    for step in steps:
        out = step(out)
    return out.join(df.select(*key, target), key)


def feature_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shape before and after and the fate of each column."""
    spark = before.sparkSession
    names = [(c, c in before.columns, c in after.columns) for c in dict.fromkeys([*before.columns, *after.columns])]
    rows = spark.createDataFrame(names, "column_name string, was boolean, is_now boolean")
    state = F.when(F.col("was") & F.col("is_now"), "kept").when(F.col("was"), "dropped").otherwise("added")
    n = before.agg(F.count(F.lit(1)).alias("rows_before")).crossJoin(after.agg(F.count(F.lit(1)).alias("rows_after")))
    return rows.crossJoin(F.broadcast(n)).select("column_name", state.alias("state"), "rows_before", "rows_after")
