"""Forecast models that fit parameters: lag regression, with ARIMA and Holt-Winters from their modules; and stationarity tests.

Fits are sums over chunks of a series (squared errors, cross products), so a
long series is fitted by many tasks; only parameters and last rows meet.
Estimates follow the published methods and differ in digits from other tools.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import ordering as O
from lodestat.operators import series as S
from lodestat.operators.arima import forecast_arima  # noqa: F401
from lodestat.operators.smoothing import forecast_holt_winters, keyed, spec  # noqa: F401
from lodestat.session import stored


# ---- cross products ----------------------------------------------------------


def gram(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``(keys..., i, j, s)``: sums of products of the vector's entries, partial sums per batch first."""

    def part(batches):
        for pdf in batches:
            for values, g in pdf.groupby(keys, dropna=False):
                v = np.stack(g[vector].to_numpy())
                m = v.T @ v
                i, j = np.indices(m.shape)
                out = pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": m.ravel()})
                for k, x in zip(keys, values):
                    out[k] = x
                yield out[[*keys, "i", "j", "s"]]

    return rows.select(*keys, vector).mapInPandas(part, spec(rows, keys, "i int, j int, s double")).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    n = int(pdf["i"].max()) + 1
    m = np.zeros((n, n))
    m[pdf["i"], pdf["j"]] = pdf["s"]
    return m


def _solve(m: np.ndarray, xs: list[int], y: int):
    a, b = m[np.ix_(xs, xs)], m[xs, y]
    coef = np.linalg.lstsq(a, b, rcond=None)[0]
    return coef, float(max(m[y, y] - coef @ b, 1e-12)), a


# ---- lag regression ----------------------------------------------------------


def forecast_lag_model(s: DataFrame, keys: list[str], periods: int = 10, lookback: int = 7) -> DataFrame:
    """``keys..., step, forecast``: a linear model of each series on its ``lookback`` earlier values, rolled forward on its own forecasts.

    A model is solved from the series' cross-products, centred so that large levels lose no digits; a constant series goes on as it is.
    A series of at most ``lookback`` + 1 rows has no forecast.
    """
    s, by, single = keyed(s, keys)
    stats = s.groupBy(*by).agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))
    z = O.join_small(s, stats, by, bounded=single).withColumn("y", F.when(F.col("_s") > 0, (F.col("y") - F.col("_m")) / F.col("_s")).otherwise(0.0))
    rows = stored(S.lag_array(z, by, lookback).where(F.col("pos") >= lookback).select(*by, "pos", "lags", "y", "_m", "_s"))
    g = gram(rows.withColumn("v", F.concat(F.array(F.lit(1.0)), F.col("lags"), F.array("y"))), by, "v")
    # the last row tells the window to start from
    last = rows.groupBy(*by).agg(F.max_by(F.struct(F.concat(F.array("y"), F.slice("lags", 1, lookback - 1)).alias("window"), "_m", "_s"), "pos").alias("t"), F.count(F.lit(1)).alias("n"))
    joined = O.join_small(g, last.where("n > 1").select(*by, "t.*"), by, bounded=single)

    def roll(pdf: pd.DataFrame) -> pd.DataFrame:
        m, window = _matrix(pdf), list(pdf["window"].iloc[0])
        coef, _, _ = _solve(m, list(range(lookback + 1)), lookback + 1)
        out = []
        for _ in range(periods):
            window = [float(coef[0] + np.dot(coef[1:], window)), *window[:-1]]
            out.append(window[0] * pdf["_s"].iloc[0] + pdf["_m"].iloc[0])
        res = pd.DataFrame({"step": np.arange(1, periods + 1), "forecast": out})
        for k in by:
            res[k] = pdf[k].iloc[0]
        return res[[*by, "step", "forecast"]]

    out = joined.groupBy(*by).applyInPandas(roll, spec(s, by, "step int, forecast double"))
    return out.drop("_series") if single else out


# ---- rolling origins ---------------------------------------------------------


def backtest(s: DataFrame, keys: list[str], model, initial: int, period: int, horizon: int) -> DataFrame:
    """Any forecast scored from rolling origins: ``keys..., cutoff, n, mae, rmse, mape, coverage``.

    ``model(series, keys, periods)`` gives ``keys..., step, forecast`` and may give ``lower`` and ``upper``. Cutoffs are positions
    ``initial`` - 1 and every ``period`` rows on; each one's rows up to there are a series of their own, so all are fitted side by side. The
    ``horizon`` rows after a cutoff score it, as far as the series goes; ``coverage`` is missing for a model without bounds.
    """
    last = F.floor((F.col("n_rows") - 2 - (initial - 1)) / period)
    first = F.greatest(F.ceil((F.col("pos") - (initial - 1)) / period), F.lit(0))
    rows = s.where(last >= first).withColumn("_c", F.explode(F.sequence(first, last))).withColumn("cutoff", F.col("_c") * period + initial - 1).drop("_c")
    rows = stored(rows.withColumn("n_rows", F.col("cutoff") + 1))
    by = [*keys, "cutoff"]
    ahead = model(rows, by, horizon)
    ahead = ahead.select(*by, (F.col("cutoff") + F.col("step")).alias("pos"), "forecast", *[c for c in ("lower", "upper") if c in ahead.columns])
    joined = O.join_small(ahead, s.select(*keys, "pos", "y"), [*keys, "pos"], bounded=False)
    e = F.col("y") - F.col("forecast")
    inside = F.avg(((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("double")) if "lower" in ahead.columns else F.lit(None).cast("double")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(1e-8))) * 100).alias("mape"), inside.alias("coverage"),
    )


# ---- stationarity ------------------------------------------------------------

ADF_CRITICAL = {"critical_1": -3.43, "critical_5": -2.86, "critical_10": -2.57}  # fixed values: constant, large samples
KPSS_CRITICAL = {"critical_1": 0.739, "critical_5": 0.463, "critical_10": 0.347}  # fixed values
ADF_LAGS = 12


def adf(s: DataFrame, keys: list[str], max_lag: int = ADF_LAGS) -> DataFrame:
    """Augmented Dickey-Fuller statistic with the lag number by AIC."""
    s, by, single = keyed(s, keys)
    stats = s.groupBy(*by).agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))
    z = O.join_small(s, stats, by, bounded=single).where("_s > 0").withColumn("y", (F.col("y") - F.col("_m")) / F.col("_s"))
    rows = S.lag_array(z, by, max_lag + 1).where(F.col("pos") >= max_lag + 1)
    d = F.transform(F.sequence(F.lit(1), F.lit(max_lag)), lambda i: F.element_at("lags", i) - F.element_at("lags", i + 1))
    vec = F.concat(F.array(F.lit(1.0), F.element_at("lags", 1)), d, F.array(F.col("y") - F.element_at("lags", 1)))
    g = gram(rows.withColumn("v", vec), by, "v")

    def test(pdf):
        m = _matrix(pdf)
        n, y, best = m[0, 0], m.shape[0] - 1, None
        for k in range(max_lag + 1):
            xs = list(range(2 + k))
            if n <= len(xs) + 1:
                break
            coef, sse, a = _solve(m, xs, y)
            aic = n * np.log(sse / n) + 2 * len(xs)
            if best is None or aic < best[0]:
                se = np.sqrt(sse / (n - len(xs)) * np.linalg.pinv(a)[1, 1])
                best = (aic, k, coef[1] / se)
        row = (np.nan, 0) if best is None else (best[2], best[1])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "statistic": [float(row[0])], "lags": [row[1]], "n": [int(n)]})

    out = g.groupBy(*by).applyInPandas(test, spec(s, by, "statistic double, lags int, n long"))
    out = out.withColumns({k: F.lit(v) for k, v in ADF_CRITICAL.items()}).withColumn("stationary", F.col("statistic") < ADF_CRITICAL["critical_5"])
    return out.drop("_series") if single else out


def kpss(s: DataFrame, keys: list[str], lags: int = 5) -> DataFrame:
    """KPSS level statistic with Bartlett weights over ``lags`` autocovariances."""
    s, by, single = keyed(s, keys)
    mean = s.groupBy(*by).agg(F.avg("y").alias("_m"))
    e = O.join_small(s, mean, by, bounded=single).withColumn("y", F.col("y") - F.col("_m"))
    part = O.running_sum(e, {"_run": F.col("y")}, by).groupBy(*by).agg(F.sum(F.col("_run") ** 2).alias("eta"), F.count(F.lit(1)).alias("n"), F.sum(F.col("y") ** 2).alias("g0"))
    long = S.lag_array(e, by, lags)
    weighted = F.aggregate(
        F.zip_with("lags", F.array(*[F.lit(1 - k / (lags + 1)) for k in range(1, lags + 1)]), lambda x, w: F.coalesce(x, F.lit(0.0)) * w), F.lit(0.0), lambda a, x: a + x
    )
    cov = long.groupBy(*by).agg(F.sum(F.col("y") * weighted).alias("gl"))
    rows = O.join_small(part, cov, by, bounded=single)
    n = F.col("n")
    s2 = (F.col("g0") + 2 * F.col("gl")) / n
    out = rows.select(*by, F.try_divide(F.col("eta") / (n * n), s2).alias("statistic"), "n")
    out = out.withColumns({k: F.lit(v) for k, v in KPSS_CRITICAL.items()}).withColumn("stationary", F.col("statistic") < KPSS_CRITICAL["critical_5"])
    return out.drop("_series") if single else out


def stationarity(s: DataFrame, keys: list[str]) -> DataFrame:
    """ADF and KPSS side by side with the joint verdict."""
    a = adf(s, keys).select(*keys, F.col("statistic").alias("adf"), F.col("stationary").alias("_a"))
    k = kpss(s, keys).select(*keys, F.col("statistic").alias("kpss"), F.col("stationary").alias("_k"))
    both = O.join_small(a, k, keys, bounded=not keys)
    text = (
        F.when(F.col("_a") & F.col("_k"), "stationary").when(~F.col("_a") & ~F.col("_k"), "not stationary").when(F.col("_a"), "difference stationary").otherwise("trend stationary")
    )
    return both.withColumn("verdict", text).drop("_a", "_k")
