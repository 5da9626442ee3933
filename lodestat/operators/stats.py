"""Hypothesis tests and Bayesian updates.

The data-sized part (sums, ranks, ordered counts) is always an aggregation;
p-values are computed on the one-row result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.functions import tails


def _two_groups(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    x = C.number(df, value)
    g = F.when(F.col(group) == a, "a").when(F.col(group) == b, "b")
    return df.select(g.alias("g"), x.alias("value")).where(F.col("g").isNotNull() & F.col("value").isNotNull())


def _side(expr: Column, g: str) -> Column:
    return F.when(F.col("g") == g, expr)


def verdict(p: Column, alpha: float = 0.05) -> Column:
    return p < alpha


def t_test_ind(df: DataFrame, group: str, value: str, a, b, equal_var: bool = True) -> DataFrame:
    rows = _two_groups(df, group, value, a, b)
    s = rows.agg(
        *[f(_side(F.col("value"), g)).alias(f"{n}_{g}") for g in "ab" for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    if equal_var:
        dof = (na + nb - 2).cast("double")
        se = F.sqrt(C.ratio((na - 1) * va + (nb - 1) * vb, dof) * (1 / na + 1 / nb))
    else:
        qa, qb = va / na, vb / nb
        dof = C.ratio((qa + qb) ** 2, qa**2 / (na - 1) + qb**2 / (nb - 1))
        se = F.sqrt(qa + qb)
    out = s.withColumns({"statistic": C.ratio(F.col("mean_a") - F.col("mean_b"), se), "dof": dof})
    return out.select("n_a", "n_b", "mean_a", "mean_b", "statistic", "dof").withColumn(
        "p_value", tails.t_two_sided(F.col("statistic"), F.col("dof"))
    )


def _t_from(df: DataFrame, x: Column, centre: float) -> DataFrame:
    s = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    t = C.ratio(F.col("mean") - centre, F.col("std") / F.sqrt("n"))
    out = s.withColumns({"statistic": t, "dof": (F.col("n") - 1).cast("double")})
    return out.withColumn("p_value", tails.t_two_sided(F.col("statistic"), F.col("dof")))


def t_test_paired(df: DataFrame, before: str, after: str) -> DataFrame:
    return _t_from(df, C.number(df, before) - C.number(df, after), 0.0)


def t_test_one_sample(df: DataFrame, value: str, population_mean: float) -> DataFrame:
    return _t_from(df, C.number(df, value), population_mean)


def _counts_by_side(rows: DataFrame) -> DataFrame:
    """``(value, n_a, n_b, cnt)``: one row per distinct value."""
    return rows.groupBy("value").agg(
        F.count(_side(F.lit(1), "a")).alias("n_a"), F.count(_side(F.lit(1), "b")).alias("n_b"), F.count(F.lit(1)).alias("cnt")
    )


def mann_whitney(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """U of group a, two-sided normal p with tie and continuity correction."""
    ranked = O.cumulate(_counts_by_side(_two_groups(df, group, value, a, b)), "value", ["cnt"])
    rank = F.col("cnt_before") + (F.col("cnt") + 1) / 2.0
    t = F.col("cnt").cast("double")
    s = ranked.agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum(F.col("n_a") * rank).alias("ra"), F.sum(t**3 - t).alias("ties")
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - C.ratio(F.col("ties"), n * (n - 1))))
    gap = F.greatest(F.abs(u - na * nb / 2) - 0.5, F.lit(0.0))
    return s.select("n_a", "n_b", u.alias("statistic"), C.ratio(gap, sd).alias("z")).withColumn("p_value", C.normal_two_sided(F.col("z")))


def wilcoxon_signed_rank(df: DataFrame, before: str, after: str) -> DataFrame:
    """W, the smaller signed rank sum over non-zero differences, normal p with tie correction."""
    d = C.number(df, before) - C.number(df, after)
    rows = df.select(d.alias("d")).where("d <> 0").select(F.abs("d").alias("value"), F.when(F.col("d") > 0, "a").otherwise("b").alias("g"))
    ranked = O.cumulate(_counts_by_side(rows), "value", ["cnt"])
    rank = F.col("cnt_before") + (F.col("cnt") + 1) / 2.0
    t = F.col("cnt").cast("double")
    s = ranked.agg(
        F.sum("cnt").alias("n"), F.sum(F.col("n_a") * rank).alias("up"), F.sum(F.col("n_b") * rank).alias("down"), F.sum(t**3 - t).alias("ties")
    )
    n = F.col("n").cast("double")
    w = F.least("up", "down")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("n", w.alias("statistic"), C.ratio(w - n * (n + 1) / 4, sd).alias("z")).withColumn(
        "p_value", C.normal_two_sided(F.col("z"))
    )


def chi_square_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected count for every cell that occurs."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).alias("observed")
    )
    ra = cells.groupBy("a").agg(F.sum("observed").alias("row_n"))
    cb = cells.groupBy("b").agg(F.sum("observed").alias("col_n"))
    n = cells.agg(F.sum("observed").alias("n"))
    full = cells.join(ra, "a").join(cb, "b").crossJoin(F.broadcast(n))
    return full.select("a", "b", "observed", (F.col("row_n") * F.col("col_n") / F.col("n")).alias("expected"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence test; Yates correction on a 2x2 table.

    Only non-empty cells are formed: empty cells add their expected counts,
    which sum to n minus the expected counts of the others.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).alias("o")
    )
    ra = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cb = cells.groupBy("b").agg(F.sum("o").alias("c"))
    size = ra.agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("rows")).crossJoin(cb.agg(F.count(F.lit(1)).alias("cols")))
    full = cells.join(ra, "a").join(cb, "b").crossJoin(F.broadcast(size))
    dof = ((F.col("rows") - 1) * (F.col("cols") - 1)).cast("double")
    e, o = F.col("r") * F.col("c") / F.col("n").cast("double"), F.col("o").cast("double")
    yates = F.least(F.lit(0.5), F.abs(o - e))
    s = full.withColumn("dof", dof).agg(
        F.max("n").alias("n"),
        F.max("dof").alias("dof"),
        F.sum((o - e) ** 2 / e).alias("plain"),
        F.sum((F.abs(o - e) - yates) ** 2 / e).alias("corrected"),
        F.sum(e).alias("e_seen"),
        F.count(F.lit(1)).alias("seen"),
    )
    rest = F.col("n") - F.col("e_seen")
    stat = F.when((F.col("dof") == 1) & (F.col("seen") == 4), F.col("corrected")).otherwise(F.col("plain") + rest)
    return s.select("n", stat.alias("statistic"), "dof").withColumn("p_value", tails.chi2_above(F.col("statistic"), F.col("dof")))


def fisher_exact(df: DataFrame, a: str, b: str) -> DataFrame:
    """2x2 odds ratio and two-sided p from boolean columns ``a`` and ``b``."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    s = df.agg(
        F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00")
    )

    def two_sided(n11, n10, n01, n00):
        n11, n10, n01, n00 = (int(v) for v in (n11, n10, n01, n00))
        r, c, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
        k = np.arange(max(0, r + c - n), min(r, c) + 1)
        lg = np.vectorize(math.lgamma, otypes=[float])

        def log_choose(m, j):
            return math.lgamma(m + 1) - lg(j + 1.0) - lg(m - j + 1.0)

        logp = log_choose(c, k) + log_choose(n - c, r - k) - float(log_choose(n, np.array([r]))[0])
        here = logp[k == n11][0]
        return float(min(1.0, np.exp(logp[logp <= here + 1e-7]).sum()))

    odds = C.ratio(F.col("n11") * F.col("n00"), F.col("n10") * F.col("n01"))
    p = tails._lift(two_sided, *[F.col(c) for c in ("n11", "n10", "n01", "n00")])
    return s.withColumns({"odds_ratio": odds, "p_value": p})


def anova_one_way(df: DataFrame, group: str, value: str) -> DataFrame:
    x = C.number(df, value)
    g = df.where(x.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")
    )
    return _f_from_groups(g)


def _f_from_groups(g: DataFrame) -> DataFrame:
    n, m = F.col("n").cast("double"), F.col("m")
    s = g.agg(
        F.sum(n).alias("n"),
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum(n * F.col("v")).alias("within"),
        # centred between-group sum from the weighted variance of the means
        (F.sum(n * m * m) - F.sum(n * m) ** 2 / F.sum(n)).alias("between"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = C.ratio(F.col("between") / d1, F.col("within") / d2)
    return s.select(F.col("n").cast("long").alias("n"), f.alias("statistic"), d1.alias("dof_between"), d2.alias("dof_within")).withColumn(
        "p_value", tails.f_above(F.col("statistic"), F.col("dof_between"), F.col("dof_within"))
    )


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    rows = df.select(F.col(group).alias("g"), C.number(df, value).alias("value")).dropna()
    both = rows.groupBy("value", "g").agg(F.count(F.lit(1)).alias("w"))
    counts = both.groupBy("value").agg(F.sum("w").alias("cnt"))
    ranked = O.cumulate(counts, "value", ["cnt"])
    rank = F.col("cnt_before") + (F.col("cnt") + 1) / 2.0
    sums = both.join(ranked.select("value", rank.alias("rank")), "value").groupBy("g").agg(
        F.sum(F.col("w") * F.col("rank")).alias("r"), F.sum("w").cast("double").alias("n")
    )
    top = sums.agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("q"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    t = F.col("cnt").cast("double")
    ties = counts.agg(F.sum(t**3 - t).alias("ties"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return top.crossJoin(ties).select(n.cast("long").alias("n"), h.alias("statistic"), (F.col("k") - 1).cast("double").alias("dof")).withColumn(
        "p_value", tails.chi2_above(F.col("statistic"), F.col("dof"))
    )


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """Largest gap between the sample and the normal with its mean and std (n-1); one row."""
    x = C.number(df, value)
    m = df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    ranked = O.value_ranks(O.long_values(df, [value]), ["column_name"]).crossJoin(F.broadcast(m))
    cdf = C.normal_cdf((F.col("value") - F.col("_m")) / F.col("_s"))
    low = F.col("cnt_before") / F.col("cnt_total")
    high = (F.col("cnt_before") + F.col("cnt")) / F.col("cnt_total")
    s = ranked.agg(F.max("cnt_total").alias("n"), F.max(F.greatest(high - cdf, cdf - low)).alias("statistic"))
    return s.withColumn("p_value", C.kolmogorov_p(F.sqrt("n") * F.col("statistic")))


def anderson_darling(df: DataFrame, value: str) -> DataFrame:
    """A-squared against the fitted normal, with the 5 % critical value for unknown mean and std."""
    x = C.number(df, value)
    m = df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    ranked = O.value_ranks(O.long_values(df, [value]), ["column_name"]).crossJoin(F.broadcast(m))
    z = (F.col("value") - F.col("_m")) / F.col("_s")
    below, above = C.normal_cdf(z), C.normal_cdf(-z)
    lo, hi, n = F.col("cnt_before").cast("double"), (F.col("cnt_before") + F.col("cnt")).cast("double"), F.col("cnt_total").cast("double")
    # ranks of equal values together: sums of (2i - 1) over the tie block
    term = (hi**2 - lo**2) * F.log(below) + ((n - lo) ** 2 - (n - hi) ** 2) * F.log(above)
    s = ranked.agg(F.max("cnt_total").alias("n"), F.sum(term).alias("t"))
    a2 = -F.col("n") - F.col("t") / F.col("n")
    limit = 0.752 / (1 + 0.75 / F.col("n") + 2.25 / F.col("n") ** 2)  # fixed value: 5 % point
    return s.select("n", a2.alias("statistic"), limit.alias("critical_5"), (a2 < limit).alias("normal"))


def dagostino_pearson(df: DataFrame, value: str) -> DataFrame:
    """K-squared from the skewness and kurtosis tests, n >= 20."""
    x = C.number(df, value)
    s = df.agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt((y / alpha) ** 2 + 1))
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    k = (F.col("g2") + 3 - e) / F.sqrt(var)
    b = 6 * (n**2 - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / b**2))
    inner = (1 - 2 / a) / (1 + k * F.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - F.signum(inner) * F.cbrt(F.abs(inner))) / F.sqrt(2 / (9 * a))
    k2 = z1**2 + z2**2
    return s.where("n >= 20").select(n.cast("long").alias("n"), k2.alias("statistic"), F.exp(-k2 / 2).alias("p_value"))


def _shapiro(x: np.ndarray) -> tuple[float, float]:
    """Royston's approximation, 3 <= n <= 5000."""
    x = np.sort(x)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([tails.normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    # fixed values: Royston (1995) polynomials
    c1 = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0], u)
    c2 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
    a = np.empty(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = c1 + m[-1] / math.sqrt(mm)
        if n <= 5:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        else:
            second = c2 + m[-2] / math.sqrt(mm)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = second, -second
        a[-1], a[0] = last, -last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(min(w, 1.0))) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    y = math.log(1 - w)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 0.0
        y = -math.log(g - y)
        mu = 0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        ln = math.log(n)
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sd = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return w, 1 - tails.normal_cdf((y - mu) / sd)


def shapiro_wilk(df: DataFrame, value: str, limit: int = 5000) -> DataFrame:
    """``(n, statistic, p_value)``; W and p are missing above ``limit`` rows, where the published weights end."""
    rows = O.long_values(df, [value]).select("value")
    large = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("n", F.lit(None).cast("double").alias("statistic"), F.lit(None).cast("double").alias("p_value"))
    n = rows.limit(limit + 1).agg(F.count(F.lit(1)).alias("_n"))
    small = rows.limit(limit + 1).crossJoin(F.broadcast(n)).where(F.col("_n") <= limit)

    def test(pdf):
        w, p = _shapiro(pdf["value"].to_numpy())
        return pd.DataFrame({"n": [len(pdf)], "statistic": [w], "p_value": [p]})

    return small.groupBy(F.lit(1).alias("k")).applyInPandas(test, "n long, statistic double, p_value double").unionByName(large)


def normality(df: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """``(test, n, statistic, p_value, normal)`` and the majority verdict on every row.

    The same three tests at every size; Shapiro-Wilk, which ends at 5000 rows, has no vote.
    """
    parts = []
    for name, frame in (("dagostino_pearson", dagostino_pearson(df, value)), ("kolmogorov_smirnov", ks_normal(df, value))):
        parts.append(frame.select(F.lit(name).alias("test"), "n", "statistic", "p_value", (F.col("p_value") > alpha).alias("normal")))
    big = anderson_darling(df, value)
    parts.append(big.select(F.lit("anderson_darling").alias("test"), "n", "statistic", F.lit(None).cast("double").alias("p_value"), "normal"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    share = F.avg(F.col("normal").cast("double")).over(Window.partitionBy(F.lit(0)))  # three rows
    return rows.withColumn("verdict", F.when(share > 0.5, "normal").otherwise("not normal"))


def variance_equality(df: DataFrame, group: str, value: str) -> DataFrame:
    """Levene (median-centred) and Bartlett rows."""
    x = C.number(df, value)
    rows = df.select(F.col(group).alias("g"), x.alias("x")).dropna()
    med = O.exact_quantiles(rows, ["x"], {"med": 0.5}, ["g"]).select("g", "med")
    away = O.join_small(rows, med, ["g"], bounded=False).withColumn("d", F.abs(F.col("x") - F.col("med")))
    levene = anova_one_way(away, "g", "d").select(
        F.lit("levene").alias("test"), "statistic", F.col("dof_between").alias("dof"), "p_value"
    )
    g = rows.groupBy("g").agg(F.count("x").cast("double").alias("n"), F.var_samp("x").alias("v"))
    s = g.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("pooled"),
        F.sum((F.col("n") - 1) * F.log("v")).alias("logs"),
        F.sum(1 / (F.col("n") - 1)).alias("inv"),
    )
    n, k = F.col("n"), F.col("k")
    top = (n - k) * F.log(F.col("pooled") / (n - k)) - F.col("logs")
    stat = top / (1 + (F.col("inv") - 1 / (n - k)) / (3 * (k - 1)))
    bartlett = s.select(F.lit("bartlett").alias("test"), stat.alias("statistic"), (k - 1).alias("dof")).withColumn(
        "p_value", tails.chi2_above(F.col("statistic"), F.col("dof"))
    )
    return levene.unionByName(bartlett)


def bonferroni(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    n = df.agg(F.count(p).alias("_n"))
    out = df.crossJoin(F.broadcast(n)).withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")
    return out.withColumn("significant", F.col("p_adjusted") < alpha)


def fdr_bh(df: DataFrame, p: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: running minimum of p * n / rank from the largest p down."""
    pos = O.with_position(df, [p, *keys], None, "_pos", "_n")
    scaled = pos.withColumn("_q", F.col(p) * F.col("_n") / (F.col("_pos") + 1)).withColumn("_chunk", F.floor(F.col("_pos") / O.CHUNK))
    edge = scaled.groupBy("_chunk").agg(F.min("_q").alias("_m"))
    # from the end, so that frames grow: one that shrinks is read anew for each row
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select("_chunk", F.min("_m").over(later).alias("_later"))
    inside = Window.partitionBy("_chunk").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = scaled.join(carry, "_chunk").withColumn("_in", F.min("_q").over(inside))
    adj = F.least(F.lit(1.0), F.col("_in"), F.coalesce("_later", F.col("_in")))
    return joined.withColumn("p_adjusted", adj).select(*df.columns, "p_adjusted", (F.col("p_adjusted") < alpha).alias("significant"))


def ks_two_sample(rows: DataFrame, side: str = "g", value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Largest gap of two sample distributions; ``side`` is 'a' or 'b'; one row per key."""
    keys = keys or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(
        F.count(F.when(F.col(side) == "a", 1)).alias("n_a"), F.count(F.when(F.col(side) == "b", 1)).alias("n_b")
    )
    cum = O.cumulate(counts, "value", ["n_a", "n_b"], keys)
    fa = C.ratio(F.col("n_a_before") + F.col("n_a"), F.col("n_a_total"))
    fb = C.ratio(F.col("n_b_before") + F.col("n_b"), F.col("n_b_total"))
    grouped = cum.groupBy(*keys) if keys else cum
    s = grouped.agg(F.max(F.abs(fa - fb)).alias("statistic"), F.max("n_a_total").alias("n_a"), F.max("n_b_total").alias("n_b"))
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    return s.withColumn("p_value", C.kolmogorov_p(en * F.col("statistic")))


def ks_test(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    return ks_two_sample(_two_groups(df, group, value, a, b))


def beta_binomial(df: DataFrame, group: str, success: Column, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Posterior of a success rate per group with the central 95 % interval."""
    s = df.groupBy(group).agg(F.count_if(success).alias("successes"), F.count(success).alias("trials"))
    a, b = alpha + F.col("successes"), beta + F.col("trials") - F.col("successes")
    out = s.withColumns({"alpha": a.cast("double"), "beta": b.cast("double")})
    pa, pb = F.col("alpha"), F.col("beta")
    out = out.withColumns({"mean": pa / (pa + pb), "variance": pa * pb / ((pa + pb) ** 2 * (pa + pb + 1))})
    return out.withColumns(
        {"low": tails.beta_quantile(F.lit(0.025), pa, pb), "high": tails.beta_quantile(F.lit(0.975), pa, pb)}
    )


def normal_normal(
    df: DataFrame, group: str, value: str, prior_mean: float = 0.0, prior_std: float = 1.0, known_std: float | None = None
) -> DataFrame:
    """Precision-weighted posterior mean and std per group."""
    x = C.number(df, value)
    s = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("sample_mean"), F.stddev_samp(x).alias("sample_std"))
    sd = F.lit(float(known_std)) if known_std is not None else F.col("sample_std")
    data, prior = F.col("n") / sd**2, F.lit(1.0 / prior_std**2)
    mean = (prior * prior_mean + data * F.col("sample_mean")) / (prior + data)
    return s.withColumns({"posterior_mean": mean, "posterior_std": F.sqrt(1 / (prior + data))}).withColumns(
        {"low": F.col("posterior_mean") - 1.96 * F.col("posterior_std"), "high": F.col("posterior_mean") + 1.96 * F.col("posterior_std")}
    )


def ab_test_bayes(
    df: DataFrame, group: str, success: Column, a, b, draws: int = 100_000, seed: int = 42, slices: int = 50
) -> DataFrame:
    """P(B > A), expected losses and verdict from posterior draws; one row."""
    one = df.where(F.col(group).isin([a, b])).agg(
        *[F.count_if(success & (F.col(group) == g)).alias(f"s_{k}") for k, g in (("a", a), ("b", b))],
        *[F.count(F.when(F.col(group) == g, success)).alias(f"n_{k}") for k, g in (("a", a), ("b", b))],
    )
    work = one.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(slices, "slice")
    per = draws // slices

    def simulate(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rng = np.random.default_rng([seed, int(r.slice)])
                pa = rng.beta(1 + r.s_a, 1 + r.n_a - r.s_a, per)
                pb = rng.beta(1 + r.s_b, 1 + r.n_b - r.s_b, per)
                out.append((int((pb > pa).sum()), float(np.maximum(pa - pb, 0).sum()), float(np.maximum(pb - pa, 0).sum()), per))
            yield pd.DataFrame(out, columns=["wins", "loss_b", "loss_a", "k"])

    s = work.mapInPandas(simulate, "wins long, loss_b double, loss_a double, k long").agg(
        (F.sum("wins") / F.sum("k")).alias("p_b_better"), (F.sum("loss_b") / F.sum("k")).alias("loss_b"), (F.sum("loss_a") / F.sum("k")).alias("loss_a")
    )
    p = F.col("p_b_better")
    text = F.when(p > 0.95, "B is better").when(p < 0.05, "A is better").otherwise("inconclusive")
    return one.crossJoin(s).withColumn("verdict", text)
