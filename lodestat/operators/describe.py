"""Aggregation and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.functions import ordering as O


def _std(x: Column) -> Column:
    return F.stddev_samp(x)


def skew_sample(x: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurt_sample(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(x).cast("double")
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(x) + 6))


def describe(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, std (n-1), min, quartiles, max for each numeric column."""
    columns, keys = columns or C.numeric_columns(df), keys or []

    def metrics(d, c):
        x = C.number(d, c)
        return [
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            _std(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ]

    basic = C.per_column(df, columns, metrics, keys)
    quarts = O.exact_quantiles(df, columns, keys=keys).drop("n")
    by = [*keys, "column_name"]
    cond = O.same_keys("a", "b", by)
    return basic.alias("a").join(quarts.alias("b"), cond, "left").select("a.*", "b.q25", "b.median", "b.q75")


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Variance, population and bias-corrected skewness and excess kurtosis."""

    def metrics(d, c):
        x = C.number(d, c)
        return [
            F.count(x).alias("n"),
            F.var_samp(x).alias("variance"),
            F.skewness(x).alias("skewness"),
            F.kurtosis(x).alias("kurtosis"),
            skew_sample(x).alias("skewness_sample"),
            kurt_sample(x).alias("kurtosis_sample"),
        ]

    return C.per_column(df, columns or C.numeric_columns(df), metrics)


def single_pass_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    def metrics(d, c):
        x = C.number(d, c)
        return [
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            _std(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ]

    return C.per_column(df, columns or C.numeric_columns(df), metrics)


def median_deviation(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``(keys..., column_name, median, mad)``: median and median absolute deviation."""
    keys = keys or []
    by = [*keys, "column_name"]
    med = O.exact_quantiles(df, columns, {"median": 0.5}, keys).drop("n")
    long = O.long_values(df, columns, keys)
    if keys:
        away = O.join_small(long, med, by, bounded=False)
        away = away.withColumn("value", F.abs(F.col("value") - F.col("median"))).drop("median")
    else:  # one median per column
        known = C.by_column(med, columns)
        centre = F.lit(None).cast("double")
        for c, r in known.items():
            centre = F.when(F.col("column_name") == c, F.lit(r["median"])).otherwise(centre)
        away = long.withColumn("value", F.abs(F.col("value") - centre))
        med = df.sparkSession.createDataFrame(
            [(c, r["median"]) for c, r in known.items()], "column_name string, median double"
        )
    mad = O.pick_quantiles(O.value_ranks(away, by, bounded_keys=not keys), by, {"mad": 0.5})
    return O.join_small(med, mad.drop("n"), by, bounded=not keys)


def advanced_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Coefficient of variation, range, IQR, MAD, valid and missing counts."""
    columns = columns or C.numeric_columns(df)

    def metrics(d, c):
        x = C.number(d, c)
        return [
            F.count(x).alias("valid"),
            F.count_if(C.missing(d, c)).alias("missing"),
            F.avg(x).alias("mean"),
            _std(x).alias("std"),
            (F.max(x) - F.min(x)).alias("range"),
        ]

    basic = C.per_column(df, columns, metrics)
    quarts = O.exact_quantiles(df, columns).select("column_name", (F.col("q75") - F.col("q25")).alias("iqr"))
    mad = median_deviation(df, columns).select("column_name", "mad")
    return (
        basic.withColumn("cv", C.ratio(F.col("std"), F.col("mean")))
        .join(quarts, "column_name", "left")
        .join(mad, "column_name", "left")
    )


def summary_across_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Spread of the column means and stds, and missing totals; one row."""

    def metrics(d, c):
        x = C.number(d, c)
        return [F.avg(x).alias("mean"), _std(x).alias("std"), F.count_if(C.missing(d, c)).alias("missing")]

    rows = C.per_column(df, columns or C.numeric_columns(df), metrics)
    return rows.agg(
        F.min("mean").alias("mean_min"),
        F.max("mean").alias("mean_max"),
        F.avg("mean").alias("mean_average"),
        F.stddev_samp("mean").alias("mean_std"),
        F.min("std").alias("std_min"),
        F.max("std").alias("std_max"),
        F.avg("std").alias("std_average"),
        (F.max("std") - F.min("std")).alias("std_range"),
        F.sum("missing").alias("total_missing"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.max("missing").alias("max_missing"),
        F.avg("missing").alias("avg_missing"),
    )


def high_variation(df: DataFrame, columns: list[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """Columns whose std exceeds ``threshold`` times the mean."""

    def metrics(d, c):
        x = C.number(d, c)
        return [C.ratio(_std(x), F.avg(x)).alias("cv")]

    return C.per_column(df, columns or C.numeric_columns(df), metrics).where(F.col("cv") > threshold)


def distribution_label(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Tail and peak labels at 0.5 on the population skewness and kurtosis."""
    s, k = F.col("skewness"), F.col("kurtosis")
    tail = F.when(F.abs(s) < 0.5, "symmetric").when(s > 0.5, "right_skewed").otherwise("left_skewed")
    peak = F.when(F.abs(k) < 0.5, "mesokurtic").when(k > 0.5, "leptokurtic").otherwise("platykurtic")
    return moments(df, columns).select(
        "column_name", tail.alias("skew_label"), peak.alias("kurt_label"), F.concat_ws("_", tail, peak).alias("label")
    )


SHAPE_PROBS = {"p1": 0.01, "p5": 0.05, "p95": 0.95, "p99": 0.99}


def distribution_shape(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Tail percentiles, skewness and kurtosis bands, shape category."""
    columns = columns or C.numeric_columns(df)

    def metrics(d, c):
        x = C.number(d, c)
        return [
            F.count(x).alias("n"),
            F.skewness(x).alias("skewness"),
            F.kurtosis(x).alias("kurtosis"),
            (F.max(x) - F.min(x)).alias("range"),
            C.ratio(_std(x), F.avg(x)).alias("cv"),
        ]

    s, k = F.col("skewness"), F.col("kurtosis")
    skew_band = (
        F.when(F.abs(s) < 0.5, "symmetric")
        .when(s >= 1.0, "strong right")
        .when(s >= 0.5, "slight right")
        .when(s > -1.0, "slight left")
        .otherwise("strong left")
    )
    kurt_band = F.when(k > 1, "peaked").when(k < -1, "flat").otherwise("normal-like")
    shape = (
        F.when((F.abs(s) < 0.5) & (F.abs(k) < 1), "Normal-like")
        .when(s > 1, "Right-skewed")
        .when(s < -1, "Left-skewed")
        .when(k > 2, "Heavy-tailed")
        .when(k < -1, "Light-tailed")
        .otherwise("Moderately non-normal")
    )
    basic = C.per_column(df, columns, metrics).where("n >= 3")
    tails = O.exact_quantiles(df, columns, SHAPE_PROBS).drop("n")
    return basic.withColumns({"skew_band": skew_band, "kurt_band": kurt_band, "shape": shape}).join(
        tails, "column_name", "left"
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value as string, cnt)`` with nulls kept, one shuffle for all columns."""
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(rows)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def top_values(counts: DataFrame, keys: list[str], limit: int, order: list[Column]) -> DataFrame:
    """First ``limit`` rows per key with ``rank``; ``keys`` are few, rows many.

    Each salted slice keeps its own best rows first, so no task ranks the
    whole list of one key.
    """
    salt = F.pmod(F.xxhash64(*counts.columns), F.lit(64))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    best = counts.withColumn("_salt", salt).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= limit)
    final = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy(*order)
    return best.drop("_salt", "_r").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit)


def categorical_stats(df: DataFrame, columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """Distinct, null and non-null counts, and the ``top`` most frequent values."""
    counts = value_counts(df, columns or C.string_columns(df))
    known = counts.where(F.col("value").isNotNull())
    totals = counts.groupBy("column_name").agg(
        F.count_if(F.col("value").isNotNull()).alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("cnt"))), F.lit(0)).alias("n_valid"),
    )
    best = top_values(known, ["column_name"], top, [F.desc("cnt"), F.asc("value")])
    return totals.join(best, "column_name", "left")


def frequency(df: DataFrame, column: str, sort_by: str = "frequency", top_n: int | None = None) -> DataFrame:
    """Counts and percentages of one column's values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    out = counts.crossJoin(F.broadcast(counts.agg(F.sum("cnt").alias("_all"))))
    out = out.withColumn("pct", C.ratio(F.col("cnt"), F.col("_all")) * 100).drop("_all")
    order = [F.desc("cnt"), F.asc("value")] if sort_by == "frequency" else [F.asc("value")]
    out = out.orderBy(*order)
    return out.limit(top_n) if top_n else out


def top_categories_with_other(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Top values plus one ``other`` row, entropy in bits and largest share."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    best = top_values(counts, [], top, [F.desc("cnt"), F.asc("category")])
    whole = counts.agg(
        F.sum("cnt").alias("_all"),
        F.sum(F.col("cnt") * F.log2("cnt")).alias("_clog"),
        F.max("cnt").alias("_max"),
        F.count(F.lit(1)).alias("_kinds"),
    )
    entropy = F.log2("_all") - C.ratio(F.col("_clog"), F.col("_all"))
    rest = (
        whole.crossJoin(best.agg(F.sum("cnt").alias("_top")))
        .where(F.col("_kinds") > top)
        .select(F.lit("other").alias("category"), (F.col("_all") - F.col("_top")).alias("cnt"))
    )
    rows = best.select("category", "cnt").unionByName(rest).crossJoin(F.broadcast(whole))
    return rows.select(
        "category",
        "cnt",
        (C.ratio(F.col("cnt"), F.col("_all")) * 100).alias("pct"),
        entropy.alias("entropy"),
        C.ratio(F.col("_max"), F.col("_all")).alias("largest_share"),
    )


def bin_count(n: Column, low: Column, high: Column, q25: Column, q75: Column) -> Column:
    """Median of the Sturges, square-root and Freedman-Diaconis counts inside 5..50."""
    sturges = F.floor(F.log2(n) + 1)
    root = F.floor(F.sqrt(n))
    width = 2 * (q75 - q25) / F.cbrt(n)
    spread = F.coalesce(F.floor(F.try_divide(high - low, width)), sturges)
    fit = F.array_sort(F.filter(F.array(sturges, root, spread), lambda b: (b >= 5) & (b <= 50)))
    k = F.size(fit)
    mid = (F.try_element_at(fit, F.floor((k + 1) / 2).cast("int")) + F.try_element_at(fit, F.floor(k / 2).cast("int") + 1)) / 2
    # with no rule inside the range the reference has no answer; ten bins then
    return F.coalesce(F.when(k > 0, F.floor(mid)), F.lit(10)).cast("int")


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int | None = None) -> DataFrame:
    """``(column_name, bin, left, right, center, width, cnt)`` with empty bins kept."""
    columns = columns or C.numeric_columns(df)
    shape = O.exact_quantiles(
        df, columns, {"low": 0.0, "q25": 0.25, "q75": 0.75, "high": 1.0}
    ).where("n >= 2")
    count = F.lit(bins) if bins else bin_count(*[F.col(c) for c in ("n", "low", "high", "q25", "q75")])
    shape = shape.withColumn("bins", count)
    # a constant column gets one unit around its value
    flat = F.col("low") == F.col("high")
    shape = shape.withColumns(
        {"low": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")), "high": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))}
    ).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    shape = shape.select("column_name", "bins", "low", "high", "width")
    placed = O.long_values(df, columns).join(F.broadcast(shape), "column_name")
    where = F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.col("bins") - 1).cast("int")
    counts = placed.groupBy("column_name", where.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    grid = shape.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    left = F.col("low") + F.col("bin") * F.col("width")
    return grid.join(counts, ["column_name", "bin"], "left").select(
        "column_name",
        "bin",
        left.alias("left"),
        (left + F.col("width")).alias("right"),
        (left + F.col("width") / 2).alias("center"),
        "width",
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
    )


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value with its count and cumulative share."""
    ranked = O.value_ranks(O.long_values(df, [column]), ["column_name"])
    share = (F.col("cnt_before") + F.col("cnt")) / F.col("cnt_total")
    return ranked.select("value", "cnt", share.alias("ecdf"))


def normal_quantile(p: Column) -> Column:
    """Inverse normal by Acklam's rational approximation (relative error below 1.2e-9)."""
    # fixed values of the published approximation
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]

    def poly(coefs, x):
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * x + k
        return out

    def tail(x):
        return poly(c, x) / (poly(d, x) * x + 1)

    q = p - 0.5
    mid = poly(a, q * q) * q / (poly(b, q * q) * q * q + 1)
    low = tail(F.sqrt(-2 * F.log(p)))
    high = -tail(F.sqrt(-2 * F.log(1 - p)))
    core = F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(mid)
    return F.when((p > 0) & (p < 1), core)


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """Distinct sample values against the normal quantile at their mean (i - 0.5) / n."""
    ranked = O.value_ranks(O.long_values(df, [column]), ["column_name"])
    p = (F.col("avg_rank") - 0.5) / F.col("cnt_total")
    return ranked.select("value", "cnt", p.alias("p"), normal_quantile(p).alias("theoretical"))


def qq_grid(df: DataFrame, column: str) -> DataFrame:
    """Sample percentiles 5..95 against mean + std * z."""
    ranked = O.value_ranks(O.long_values(df, [column]), ["column_name"])
    rows = O.long_quantiles(ranked, ["column_name"], [i / 100 for i in range(5, 100, 5)])
    x = C.number(df, column)
    basic = df.agg(F.avg(x).alias("_m"), _std(x).alias("_s"))
    expected = F.col("_m") + F.col("_s") * normal_quantile(F.col("p"))
    return rows.crossJoin(F.broadcast(basic)).select("p", F.col("quantile").alias("sample"), expected.alias("theoretical"))


SIGMA_PROBS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def sigma_intervals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of rows within one and two std of the mean, and tail percentiles."""
    columns = columns or C.numeric_columns(df)

    def metrics(d, c):
        x = C.number(d, c)
        return [F.avg(x).alias("mean"), _std(x).alias("std")]

    basic = C.per_column(df, columns, metrics)
    away = O.long_values(df, columns).join(F.broadcast(basic), "column_name")
    z = F.abs(F.col("value") - F.col("mean"))
    share = away.groupBy("column_name").agg(
        (F.avg((z <= F.col("std")).cast("double")) * 100).alias("within_1"),
        (F.avg((z <= 2 * F.col("std")).cast("double")) * 100).alias("within_2"),
    )
    return basic.join(share, "column_name").join(O.exact_quantiles(df, columns, SIGMA_PROBS).drop("n"), "column_name")


def kde_grid(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Gaussian density estimate (Scott width) on an even grid between min and max.

    Equal values are counted first; each distinct value then adds to the fixed
    number of grid points inside its own task.
    """
    counts = O.long_values(df, [column]).groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))
    basic = df.agg(
        F.count(C.number(df, column)).alias("n"),
        _std(C.number(df, column)).alias("s"),
        F.min(C.number(df, column)).alias("low"),
        F.max(C.number(df, column)).alias("high"),
    ).withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2)))
    grid = counts.crossJoin(F.broadcast(basic)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("g") / (points - 1)
    u = (x - F.col("value")) / F.col("h")
    weight = F.col("cnt") * F.exp(-0.5 * u * u) / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    return grid.groupBy("g").agg(F.max(x).alias("x"), F.sum(weight).alias("density"))


def bootstrap_ci(df: DataFrame, column: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """2.5 / 97.5 percentiles of mean, std and quartiles over Poisson resamples.

    Values are counted first. A value seen ``c`` times draws Poisson(c) copies
    per resample, which is the sum of the per-row Poisson(1) draws; draws are
    seeded by value so they do not depend on the partitioning.
    """
    import numpy as np
    import pandas as pd

    counts = O.long_values(df, [column]).groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))

    def draw(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            w = np.empty((len(pdf), resamples))
            for i, (v, c) in enumerate(zip(pdf["value"].to_numpy(), pdf["cnt"].to_numpy())):
                bits = int(np.float64(v).view(np.uint64))
                w[i] = np.random.default_rng([seed, bits]).poisson(c, resamples)
            yield pd.DataFrame(
                {
                    "b": np.tile(np.arange(resamples), len(pdf)),
                    "value": np.repeat(pdf["value"].to_numpy(), resamples),
                    "cnt": w.ravel().astype("int64"),
                }
            )

    drawn = counts.mapInPandas(draw, "b long, value double, cnt long").where("cnt > 0")
    x, w = F.col("value"), F.col("cnt")
    centre = df.agg(F.avg(C.number(df, column)).alias("_c"))
    moved = drawn.crossJoin(F.broadcast(centre)).withColumn("_d", x - F.col("_c"))
    sums = moved.groupBy("b").agg(
        F.sum(w).alias("n"), F.sum(w * F.col("_d")).alias("s1"), F.sum(w * F.col("_d") ** 2).alias("s2"), F.max("_c").alias("c")
    )
    stats = sums.select(
        "b",
        (F.col("c") + F.col("s1") / F.col("n")).alias("mean"),
        F.sqrt((F.col("s2") - F.col("s1") ** 2 / F.col("n")) / (F.col("n") - 1)).alias("std"),
    )
    ranked = O.cumulate(drawn, "value", ["cnt"], ["b"])
    quarts = O.pick_quantiles(ranked, ["b"], O.QUARTILES).drop("n")
    rows = stats.join(quarts, "b").unpivot(["b"], ["mean", "std", "q25", "median", "q75"], "statistic", "value")
    return rows.groupBy("statistic").agg(  # one value per resample
        F.avg("value").alias("estimate"),
        F.percentile("value", F.lit(0.025)).alias("low"),
        F.percentile("value", F.lit(0.975)).alias("high"),
    )


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Describe plus bias-corrected shape and sign counts."""
    columns = columns or C.numeric_columns(df)

    def metrics(d, c):
        x = C.number(d, c)
        return [
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            _std(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.sum(x).alias("total"),
            skew_sample(x).alias("skewness"),
            kurt_sample(x).alias("kurtosis"),
            F.count_if(x == 0).alias("zeros"),
            F.count_if(x < 0).alias("negatives"),
            F.count_if(x > 0).alias("positives"),
        ]

    basic = C.per_column(df, columns, metrics)
    return basic.join(O.exact_quantiles(df, columns).drop("n"), "column_name", "left")


def text_profile(df: DataFrame, column: str) -> DataFrame:
    """Length and word statistics of one text column; one row."""
    c = F.col(column)
    words = F.size(F.split(c, r"\s+"))
    return df.where(c.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.length(c)).alias("min_length"),
        F.max(F.length(c)).alias("max_length"),
        F.avg(F.length(c)).alias("avg_length"),
        F.sum(F.length(c)).alias("total_characters"),
        F.sum(words).alias("word_count"),
        F.avg(words).alias("avg_words"),
    )


def text_patterns(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """Most frequent length and first-letter patterns."""
    c = F.col(column)
    kinds = F.array_compact(
        F.array(
            F.concat(F.lit("length_"), F.length(c).cast("string")),
            F.when(F.length(c) > 0, F.concat(F.lit("starts_with_"), F.lower(F.substring(c, 1, 1)))),
        )
    )
    base = df.where(c.isNotNull())
    counts = base.select(F.explode(kinds).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    n = base.agg(F.count(F.lit(1)).alias("_n"))
    best = counts.orderBy(F.desc("cnt"), F.asc("pattern")).limit(top)
    return best.crossJoin(F.broadcast(n)).select(
        "pattern", "cnt", (C.ratio(F.col("cnt"), F.col("_n")) * 100).alias("pct")
    )


def datetime_profile(df: DataFrame, column: str) -> DataFrame:
    """Earliest, latest, span, years, and the month and weekday counts as metric rows."""
    c = F.col(column)
    days = F.date_diff(F.max(c).cast("date"), F.min(c).cast("date"))
    whole = df.agg(
        F.date_format(F.min(c), "yyyy-MM-dd").alias("earliest"),
        F.date_format(F.max(c), "yyyy-MM-dd").alias("latest"),
        days.cast("string").alias("span_days"),
        F.min(F.year(c)).cast("string").alias("first_year"),
        F.max(F.year(c)).cast("string").alias("last_year"),
    ).unpivot([], ["earliest", "latest", "span_days", "first_year", "last_year"], "metric", "value")
    parts = F.array(
        F.concat(F.lit("month_"), F.month(c).cast("string")), F.concat(F.lit("weekday_"), F.weekday(c).cast("string"))
    )
    counts = (
        df.where(c.isNotNull())
        .select(F.explode(parts).alias("metric"))
        .groupBy("metric")
        .agg(F.count(F.lit(1)).cast("string").alias("value"))
    )
    return whole.unionByName(counts)


def group_sum(df: DataFrame, category: str, value: str) -> DataFrame:
    """Sum by category with share, rank, top / bottom three flags and concentration."""
    sums = df.groupBy(F.col(category).cast("string").alias("category")).agg(F.sum(C.number(df, value)).alias("total"))
    whole = sums.agg(F.sum("total").alias("_all"), F.max("total").alias("_max"), F.count(F.lit(1)).alias("categories"))
    ranked = sums.crossJoin(F.broadcast(whole))
    top = top_values(sums, [], 3, [F.desc("total"), F.asc("category")]).select("category", F.col("rank").alias("top_rank"))
    low = top_values(sums, [], 3, [F.asc("total"), F.asc("category")]).select("category", F.col("rank").alias("bottom_rank"))
    out = ranked.join(F.broadcast(top), "category", "left").join(F.broadcast(low), "category", "left")
    return out.select(
        "category",
        "total",
        F.when(F.col("_all") > 0, F.col("total") / F.col("_all") * 100).otherwise(0.0).alias("pct"),
        "top_rank",
        "bottom_rank",
        F.when(F.col("_all") > 0, F.col("_max") / F.col("_all")).otherwise(0.0).alias("concentration"),
        "categories",
    )


def group_stats(df: DataFrame, category: str, value: str) -> DataFrame:
    """Count, mean, std and median of ``value`` by category."""
    x = C.number(df, value)
    basic = df.groupBy(category).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), _std(x).alias("std"))
    med = O.exact_quantiles(df, [value], {"median": 0.5}, [category]).select(category, "median")
    return basic.alias("a").join(med.alias("b"), O.same_keys("a", "b", [category]), "left").select("a.*", "b.median")


def fences(quarts: DataFrame, factor: float = 1.5) -> DataFrame:
    iqr = F.col("q75") - F.col("q25")
    return quarts.withColumns(
        {"iqr": iqr, "lower_fence": F.col("q25") - factor * iqr, "upper_fence": F.col("q75") + factor * iqr}
    )


def box_stats(df: DataFrame, value: str, category: str, keep: int = 20) -> DataFrame:
    """Box-plot numbers by group with up to ``keep`` outlier values, largest deviation order by value."""
    x = C.number(df, value)
    rows = df.where(x.isNotNull()).select(F.col(category).alias("grp"), x.alias("x"))
    basic = rows.groupBy("grp").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        _std(F.col("x")).alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        skew_sample(F.col("x")).alias("skewness"),
        kurt_sample(F.col("x")).alias("kurtosis"),
        C.ratio(_std(F.col("x")), F.avg("x")).alias("cv"),
    )
    fence = fences(O.exact_quantiles(rows, ["x"], keys=["grp"]).drop("n", "column_name"))
    edge = fence.select("grp", "lower_fence", "upper_fence")
    out = rows.alias("a").join(edge.alias("b"), O.same_keys("a", "b", ["grp"]))
    out = out.where((F.col("x") < F.col("lower_fence")) | (F.col("x") > F.col("upper_fence"))).select("a.grp", "x")
    kinds = out.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("cnt"))
    counts = kinds.groupBy("grp").agg(F.sum("cnt").alias("outliers"))
    shown = top_values(kinds, ["grp"], keep, [F.asc("x")]).groupBy("grp").agg(
        F.array_sort(F.collect_list("x")).alias("outlier_values")  # at most `keep` values
    )
    joined = basic.alias("a")
    for side in (fence, counts, shown):
        joined = joined.join(side.alias("b"), O.same_keys("a", "b", ["grp"]), "left").select(
            "a.*", *[F.col(f"b.{c}") for c in side.columns if c != "grp"]
        ).alias("a")
    return (
        joined.withColumn("outliers", F.coalesce("outliers", F.lit(0)))
        .withColumn("outlier_pct", F.col("outliers") / F.col("n") * 100)
        .withColumn("range", F.col("max") - F.col("min"))
        .withColumnRenamed("grp", category)
    )


def compare_groups(df: DataFrame, value: str, category: str) -> DataFrame:
    """Extremes of median, variance and outlier rate over groups; one row."""
    g = box_stats(df, value, category).withColumn("variance", F.col("std") ** 2)
    name = F.col(category).cast("string")
    return g.agg(
        F.count(F.lit(1)).alias("groups"),
        (F.max("median") - F.min("median")).alias("median_range"),
        F.max_by(name, F.struct("median", name)).alias("highest_median"),
        F.min_by(name, F.struct("median", name)).alias("lowest_median"),
        F.max_by(name, F.struct("variance", name)).alias("most_variable"),
        F.min_by(name, F.struct("variance", name)).alias("least_variable"),
        F.max_by(name, F.struct("outlier_pct", name)).alias("highest_outlier"),
        C.ratio(F.max("variance"), F.min("variance")).alias("variance_ratio"),
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long crosstab with row shares; absent pairs are absent rows."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("cnt"))
    rows = cells.groupBy(a).agg(F.sum("cnt").alias("_row"))
    return cells.join(rows, a).withColumn("row_share", F.col("cnt") / F.col("_row")).drop("_row")


def target_analysis(df: DataFrame, target: str) -> DataFrame:
    """Type of a target column and the learning problem it suggests; one row."""
    known = df.where(~C.missing(df, target))
    if target in C.numeric_columns(df):
        x = C.number(df, target)
        counts = known.groupBy(target).agg(F.count(F.lit(1)).alias("cnt")).agg(F.count(F.lit(1)).alias("n_distinct"))
        stats = df.agg(F.avg(x).alias("mean"), _std(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
        hint = F.when(F.col("n_distinct") < 10, "classification").otherwise("regression")
        return stats.crossJoin(counts).withColumns({"type": F.lit("numeric"), "hint": hint})
    counts = known.groupBy(target).agg(F.count(F.lit(1)).alias("cnt"))
    one = counts.agg(
        F.count(F.lit(1)).alias("n_distinct"), F.max("cnt").alias("largest"), F.min("cnt").alias("smallest")
    )
    imbalance = C.ratio(F.col("largest"), F.col("smallest"))
    return one.withColumns(
        {
            "type": F.lit("categorical"),
            "hint": F.when(F.col("n_distinct") == 2, "binary").otherwise("multiclass"),
            "imbalance_ratio": imbalance,
            "imbalanced": (F.col("n_distinct") > 1) & (imbalance > 5),
        }
    )
