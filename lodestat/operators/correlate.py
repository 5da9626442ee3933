"""Correlation."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.functions import tails


def corr_pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_a, column_b, r, n)`` for each pair, undefined as 0; one scan for all pairs."""
    columns = columns or C.numeric_columns(df)
    structs = []
    for a, b in combinations(columns, 2):
        x, y = C.number(df, a), C.number(df, b)
        structs.append(
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                C.or_zero(C.corr(x, y)).alias("r"),
                F.count_if(x.isNotNull() & y.isNotNull()).alias("n"),
            )
        )
    return df.agg(F.array(*structs).alias("_r")).select(F.inline("_r"))


def _pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct value pairs with their counts, per column pair."""
    wide = df.select(*[C.number(df, c).alias(f"_v{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"_v{i}").alias("x"), F.col(f"_v{j}").alias("y"))
            for (i, a), (j, b) in combinations(enumerate(columns), 2)
        ]
    )
    long = wide.select(F.inline(rows)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return long.groupBy("column_a", "column_b", "x", "y").agg(F.count(F.lit(1)).alias("w"))


PAIR = ["column_a", "column_b"]


def corr_spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson of average ranks over each pair's complete rows."""
    pairs = _pair_counts(df, columns or C.numeric_columns(df))

    def ranks(axis):
        counts = pairs.groupBy(*PAIR, axis).agg(F.sum("w").alias("cnt"))
        out = O.cumulate(counts, axis, ["cnt"], PAIR)
        centred = F.col("cnt_before") + (F.col("cnt") + 1) / 2.0 - (F.col("cnt_total") + 1) / 2.0
        return out.select(*PAIR, axis, centred.alias(f"r{axis}"))

    joined = pairs.join(ranks("x"), [*PAIR, "x"]).join(ranks("y"), [*PAIR, "y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = joined.groupBy(*PAIR).agg(
        F.sum(w * rx * ry).alias("xy"), F.sum(w * rx * rx).alias("xx"), F.sum(w * ry * ry).alias("yy"), F.sum(w).alias("n")
    )
    r = F.coalesce(C.ratio(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))), F.lit(0.0))
    return sums.select(*PAIR, r.alias("r"), "n")


def _signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i w_j sign((x_i - x_j)(y_i - y_j)) over pairs, by sorted merging."""
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order].astype("float64")
    total, width, n = 0.0, 64, len(x)
    # pairs inside blocks of 64 directly, then merge sorted blocks
    pad = -n % width
    by = np.append(y, np.full(pad, y[-1])).reshape(-1, width)
    bw = np.append(w, np.zeros(pad)).reshape(-1, width)
    upper = np.triu(np.ones((width, width)), 1)
    for i in range(0, len(by), 256):
        cy, cw = by[i : i + 256], bw[i : i + 256]
        signs = np.sign(cy[:, None, :] - cy[:, :, None]) * upper
        total += float(np.einsum("bi,bij,bj->", cw, signs, cw))
    s = np.argsort(by, axis=1, kind="stable")
    runs_y, runs_w = np.take_along_axis(by, s, 1).ravel(), np.take_along_axis(bw, s, 1).ravel()
    n = len(runs_y)
    while width < n:
        for lo in range(0, n, 2 * width):
            mid, hi = min(lo + width, n), min(lo + 2 * width, n)
            if mid < hi:
                ly, lw, ry, rw = runs_y[lo:mid], runs_w[lo:mid], runs_y[mid:hi], runs_w[mid:hi]
                cum = np.concatenate(([0.0], np.cumsum(lw)))
                below, upto = cum[np.searchsorted(ly, ry, "left")], cum[np.searchsorted(ly, ry, "right")]
                total += float(np.dot(rw, below - (cum[-1] - upto)))
            s = np.argsort(runs_y[lo:hi], kind="stable")
            runs_y[lo:hi], runs_w[lo:hi] = runs_y[lo:hi][s], runs_w[lo:hi][s]
        width *= 2
    # equal x counted as growing y above: take those pairs out
    groups = pd.DataFrame({"x": x, "w": w, "w2": w * w}).groupby("x").sum()
    total -= float(((groups["w"] ** 2 - groups["w2"]) / 2).sum())
    same = pd.DataFrame({"x": x, "y": y, "w": w, "w2": w * w}).groupby(["x", "y"]).sum()
    return total + float(((same["w"] ** 2 - same["w2"]) / 2).sum())


def corr_kendall(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Tau-b without comparing all pairs.

    Values are cut into ranges on both axes. Pairs that differ in both ranges
    are counted from the range-by-range table; only pairs inside one range
    need the values, and a frequent value has a range of its own, whose pairs
    are ties and count nothing.
    """
    pairs = _pair_counts(df, columns or C.numeric_columns(df))
    k = O.range_count(df)
    bounds = pairs.groupBy(*PAIR).agg(O.cuts(F.col("x"), k).alias("_cx"), O.cuts(F.col("y"), k).alias("_cy"))
    cut = pairs.join(F.broadcast(bounds), PAIR)
    for a in ("x", "y"):
        cut = cut.withColumn("_r", O.range_of(F.col(a), F.col(f"_c{a}"), k))
        on_cut = O.is_cut(F.col(a), F.col(f"_c{a}"), F.col("_r"))
        cut = cut.withColumn(f"b{a}", 2 * F.col("_r") + on_cut.cast("int")).drop("_r")
    cut = cut.drop("_cx", "_cy")

    cells = cut.groupBy(*PAIR, "bx", "by").agg(F.sum("w").alias("w"))
    spec = "column_a string, column_b string, s double"

    def grid(pdf):  # at most (2k)^2 cells per column pair
        table = pdf.pivot_table(index="bx", columns="by", values="w", aggfunc="sum", fill_value=0).to_numpy(dtype="float64")
        below = np.zeros_like(table)
        above = np.zeros_like(table)
        rows = np.cumsum(table, axis=0)
        prev = np.vstack([np.zeros((1, table.shape[1])), rows[:-1]])
        run = np.cumsum(prev, axis=1)
        below[:, 1:] = run[:, :-1]
        above[:, :-1] = run[:, -1:] - run[:, :-1]
        s = float((table * (below - above)).sum())
        return pd.DataFrame({"column_a": [pdf["column_a"].iloc[0]], "column_b": [pdf["column_b"].iloc[0]], "s": [s]})

    def inside(pdf):
        s = _signed_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({"column_a": [pdf["column_a"].iloc[0]], "column_b": [pdf["column_b"].iloc[0]], "s": [s]})

    def across(pdf):
        # pairs of one y range whose x ranges differ: all pairs less those inside a cell
        s = _signed_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        for _, cell in pdf.groupby("bx"):
            if len(cell) > 1:
                s -= _signed_pairs(cell["x"].to_numpy(), cell["y"].to_numpy(), cell["w"].to_numpy())
        return pd.DataFrame({"column_a": [pdf["column_a"].iloc[0]], "column_b": [pdf["column_b"].iloc[0]], "s": [s]})

    # odd ranges hold one value, hence only ties on that axis
    parts = cells.groupBy(*PAIR).applyInPandas(grid, spec)
    parts = parts.unionByName(cut.where("bx % 2 = 0").groupBy(*PAIR, "bx").applyInPandas(inside, spec))
    parts = parts.unionByName(cut.where("by % 2 = 0").groupBy(*PAIR, "by").applyInPandas(across, spec))
    score = parts.groupBy(*PAIR).agg(F.sum("s").alias("s"))

    def ties(axis):
        c = pairs.groupBy(*PAIR, axis).agg(F.sum("w").cast("double").alias("c"))
        return c.groupBy(*PAIR).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(f"t{axis}"))

    both = score.join(ties("x"), PAIR).join(ties("y").drop("n"), PAIR)
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    r = C.ratio(F.col("s"), F.sqrt(all_pairs - F.col("tx")) * F.sqrt(all_pairs - F.col("ty")))
    return both.select(*PAIR, F.coalesce(r, F.lit(0.0)).alias("r"), F.col("n").cast("long").alias("n"))


METHODS = {"pearson": corr_pearson, "spearman": corr_spearman, "kendall": corr_kendall}


def strength(r):
    return C.bands(F.abs(r), [(0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak")], "very weak")


def strong_pairs(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.7, method: str = "pearson") -> DataFrame:
    r = F.col("r")
    rows = METHODS[method](df, columns).where(F.abs(r) >= threshold)
    rows = rows.withColumns({"strength": strength(r), "direction": F.when(r > 0, "positive").otherwise("negative")})
    return rows.orderBy(F.desc(F.abs(r)))


def corr_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Statistics of the pair correlations; the pairs are as many as columns squared, not rows."""
    rows = corr_pearson(df, columns)
    r = F.col("r")
    pair = F.concat_ws("|", "column_a", "column_b")
    return rows.agg(
        F.avg("r").alias("mean"),
        F.percentile("r", F.lit(0.5)).alias("median"),
        F.stddev_samp("r").alias("std"),
        F.min("r").alias("min"),
        F.max("r").alias("max"),
        F.avg(F.abs("r")).alias("abs_mean"),
        *[F.count_if(strength(r) == s).alias(s.replace(" ", "_")) for s in ("very strong", "strong", "moderate", "weak", "very weak")],
        F.max_by(pair, F.abs("r")).alias("max_pair"),
    )


def corr_network(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    r = F.col("r")
    return corr_pearson(df, columns).where(F.abs(r) >= threshold).select(
        F.col("column_a").alias("source"),
        F.col("column_b").alias("target"),
        "r",
        (5 * F.abs(r)).alias("weight"),
        F.when(r > 0, "positive").otherwise("negative").alias("sign"),
    )


def top_pair_fits(df: DataFrame, columns: list[str] | None = None, top: int = 4) -> DataFrame:
    """Strongest pairs with their least-squares line, from the same scan as the correlations."""
    columns = columns or C.numeric_columns(df)
    structs = []
    for a, b in combinations(columns, 2):
        x, y = C.number(df, a), C.number(df, b)
        structs.append(
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                C.or_zero(C.corr(x, y)).alias("r"),
                F.regr_slope(y, x).alias("slope"),
                F.regr_intercept(y, x).alias("intercept"),
            )
        )
    rows = df.agg(F.array(*structs).alias("_r")).select(F.inline("_r"))
    return rows.orderBy(F.desc(F.abs("r")), "column_a", "column_b").limit(top)


def feature_interactions(df: DataFrame, important: list[str], top_n: int = 10) -> DataFrame:
    """Correlated pairs among the most important columns."""
    r = F.col("r")
    return corr_pearson(df, important[:top_n]).where(F.abs(r) > 0.5).withColumn(
        "kind", F.when(F.abs(r) > 0.7, "strong").otherwise("moderate")
    )


def corr_test(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """r and two-sided p: t for pearson and spearman, normal for tau."""
    rows = METHODS[method](df, [a, b]).withColumn("method", F.lit(method))
    if method == "kendall":
        n = F.col("n").cast("double")
        z = F.col("r") / F.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1)))
        return rows.withColumn("p_value", tails.normal_two_sided(z))
    dof = F.col("n") - 2
    t = F.col("r") * F.sqrt(C.ratio(dof, 1 - F.col("r") ** 2))
    return rows.withColumn("p_value", tails.t_two_sided(t, dof))


def residual_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x with residual statistics; one row."""
    rows = df.select(C.number(df, x).alias("x"), C.number(df, y).alias("y")).dropna()
    fit = rows.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2")
    )
    e = F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")
    res = rows.crossJoin(F.broadcast(fit)).agg(
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.max("r2").alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("residual_mean"),
        F.stddev_pop(e).alias("residual_std"),
    )
    return res
