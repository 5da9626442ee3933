"""Time series: order-based windows, trend, season, forecasts and checks.

A series is ``(keys..., time, y)``. :func:`prepare_series` adds the position
``pos`` (0-based) and the length ``n_rows``. Operators work on that frame, so
many series run at once and one long series is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.functions import tails
from lodestat.operators.smoothing import smooth



def prepare_series(df: DataFrame, time: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Parsed ``(keys..., time, y, pos, n_rows)`` without rows that do not parse."""
    keys = keys or []
    t = F.col(time)
    if dict(df.dtypes)[time] == "string":
        t = F.coalesce(t.try_cast("timestamp_ntz"), F.to_timestamp_ntz(t))
    rows = df.select(*keys, t.alias("time"), F.col(value).try_cast("double").alias("y")).dropna(subset=["time", "y"])
    rows = rows.where(~F.isnan("y"))
    return O.with_position(rows, ["time", "y"], keys)


def _by(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df


def _back(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-series results to the rows; a single series has a single result row."""
    return O.join_small(df, small, keys, bounded=not keys)


def row_ordinal(df: DataFrame, order_by: list[str], keys: list[str] | None = None) -> DataFrame:
    return O.with_position(df, order_by, keys, "ordinal", None)


def halo(s: DataFrame, keys: list[str], before: int, after: int = 0, chunk: int = O.CHUNK):
    return O.with_halo(s, keys, before, after, chunk=chunk)


def lag_diff(s: DataFrame, keys: list[str], chunk: int = O.CHUNK) -> DataFrame:
    """First difference of value and of time in seconds; null on the first row."""
    h, w = halo(s, keys, 1, chunk=chunk)
    sec = F.unix_micros(F.col("time").cast("timestamp")) / 1e6
    out = h.withColumns({"diff": F.col("y") - F.lag("y").over(w), "step_seconds": sec - F.lag(sec).over(w)})
    return O.drop_halo(out)


def rolling_band(s: DataFrame, keys: list[str], window: int, width: float = 2.0, chunk: int = O.CHUNK) -> DataFrame:
    """Trailing mean and std over ``window`` rows, null before it is full, and the band around the mean."""
    h, w = halo(s, keys, window, chunk=chunk)
    frame = w.rowsBetween(-(window - 1), 0)
    full = F.col("pos") >= window - 1
    out = h.withColumns(
        {
            "rolling_mean": F.when(full, F.avg("y").over(frame)),
            "rolling_std": F.when(full, F.stddev_samp("y").over(frame)),
        }
    )
    out = out.withColumn("_prev", F.lag("rolling_mean").over(w))
    m, d = F.col("rolling_mean"), F.col("rolling_std")
    step = m - F.col("_prev")
    out = out.withColumns(
        {
            "upper": m + width * d,
            "lower": m - width * d,
            "direction": F.when(step > 0, "up").when(step < 0, "down").when(step == 0, "flat"),
        }
    )
    return O.drop_halo(out.drop("_prev"))


def window_mean(s: DataFrame, keys: list[str], window: Column, name: str = "trend", filled: bool = True) -> DataFrame:
    """Centred mean over ``window`` rows (may depend on the series length).

    Running sums make wide windows cheap: two equality joins by position and
    no frame to hold. Ends without a full window take the nearest full one.
    """
    right = F.floor((window - 1) / 2)
    left = window - 1 - right
    centre = F.least(F.greatest(F.col("pos"), left), F.col("n_rows") - 1 - right)
    # deviations from the series mean keep the running sums small
    mean = _by(s, keys).agg(F.avg("y").alias("_mean"))
    base = _back(s, mean, keys)
    sums = O.running_sum(base, {"_run": F.col("y") - F.col("_mean")}, keys)
    cum = sums.select(*keys, F.col("pos").alias("_p"), F.col("_run").alias("_s"))
    want = sums.withColumns({"_w": window, "_hi": centre + right, "_lo": centre - left - 1, "_mid": centre}).drop("_run")
    hi, lo = cum.withColumnRenamed("_s", "_sh"), cum.withColumnRenamed("_s", "_sl")

    def at(frame, side, column, value, how):
        cond = O.same_keys("l", "r", keys) & (F.col(f"l.{column}") == F.col("r._p"))
        return frame.alias("l").join(side.alias("r"), cond, how).select("l.*", F.col(f"r.{value}"))

    out = at(at(want, hi, "_hi", "_sh", "left"), lo, "_lo", "_sl", "left")
    m = F.col("_mean") + (F.col("_sh") - F.coalesce("_sl", F.lit(0.0))) / F.col("_w")
    fits = (F.col("_w") <= F.col("n_rows")) & (F.lit(True) if filled else (F.col("pos") == F.col("_mid")))
    out = out.withColumn(name, F.when(fits, m).otherwise(F.col("y") if filled else F.lit(None)))
    return out.drop("_w", "_hi", "_lo", "_mid", "_mean", "_sh", "_sl")


def rolling_mean_centered(s: DataFrame, keys: list[str], window: int) -> DataFrame:
    return window_mean(s, keys, F.lit(window), "rolling_mean")


def lag_array(s: DataFrame, keys: list[str], lags: int, chunk: int = O.CHUNK, y: str = "y") -> DataFrame:
    """``lags``: the earlier values, nearest first; null before the start."""
    h, w = halo(s, keys, lags, chunk=chunk)
    out = h.withColumn("lags", F.array(*[F.lag(y, k).over(w) for k in range(1, lags + 1)]))
    return O.drop_halo(out)


def lag_matrix(s: DataFrame, keys: list[str], lookback: int, chunk: int = O.CHUNK) -> DataFrame:
    """Full rows of ``lookback`` earlier values (oldest first) with the target."""
    out = lag_array(s, keys, lookback, chunk).where(F.col("pos") >= lookback)
    return out.withColumn("features", F.reverse("lags")).withColumnRenamed("y", "target").drop("lags")


def share_of_row(df: DataFrame, columns: list[str]) -> DataFrame:
    whole = C.total([F.coalesce(C.number(df, c), F.lit(0.0)) for c in columns])
    return df.withColumns({f"{c}_share": C.ratio(C.number(df, c), whole) for c in columns})


def cumulative_share(df: DataFrame, value: str, keys: list[str], ties: list[str]) -> DataFrame:
    """Rank by falling absolute value and running share of the total."""
    size = F.abs(C.number(df, value))
    pos = O.with_position(df.withColumn("_neg", -size), ["_neg", *ties], keys)
    out = O.running_sum(pos, {"_run": -F.col("_neg")}, keys)
    whole = _by(df, keys).agg(F.sum(size).alias("_all"))
    out = _back(out, whole, keys)
    return out.select(
        *df.columns, (F.col("pos") + 1).alias("rank"), C.ratio(F.col("_run"), F.col("_all")).alias("cumulative_share")
    )


def _median_steps(s: DataFrame, keys: list[str]) -> DataFrame:
    d = lag_diff(s, keys).where("step_seconds is not null")
    return O.exact_quantiles(d, ["step_seconds"], {"step": 0.5}, keys, bounded_keys=not keys).select(*keys, "step")


def time_analysis(s: DataFrame, keys: list[str]) -> DataFrame:
    """Mean interval, constancy, span and a frequency guess per series."""
    d = lag_diff(s, keys)
    days = F.col("step_seconds") / 86400
    out = _by(d, keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(days).alias("mean_interval_days"),
        (F.min(days) == F.max(days)).alias("is_constant"),
        ((F.max(F.unix_micros(F.col("time").cast("timestamp"))) - F.min(F.unix_micros(F.col("time").cast("timestamp")))) / 86400e6).alias("_span"),
    )
    m = F.col("mean_interval_days")
    guess = (
        F.when(m < 0.9, "sub-daily").when(m < 1.5, "daily").when(m < 10, "weekly").when(m < 45, "monthly").when(m < 120, "quarterly").otherwise("yearly")
    )
    return out.withColumns({"span_days": F.floor("_span"), "frequency": guess}).drop("_span")


def series_stats(s: DataFrame, keys: list[str]) -> DataFrame:
    first, last = F.min_by("y", "pos"), F.max_by("y", "pos")
    return _by(s, keys).agg(
        F.count("y").alias("n"),
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("std"),
        F.min("y").alias("min"),
        F.max("y").alias("max"),
        (F.max("y") - F.min("y")).alias("range"),
        C.ratio(F.stddev_pop("y"), F.avg("y")).alias("cv"),
        F.when(last > first, "increasing").otherwise("decreasing").alias("direction"),
    )


def linear_fit(s: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares line on the position: slope, intercept, r2, n, mse and last position."""
    r2 = F.coalesce(F.regr_r2("y", "pos"), F.lit(0.0))
    return _by(s, keys).agg(
        F.count("y").alias("n"),
        F.regr_slope("y", "pos").alias("slope"),
        F.regr_intercept("y", "pos").alias("intercept"),
        r2.alias("r2"),
        ((1 - r2) * F.var_pop("y")).alias("mse"),
        F.var_pop("pos").alias("_vx"),
    )


def trend_linear(s: DataFrame, keys: list[str]) -> DataFrame:
    fit = linear_fit(s, keys)
    n = F.col("n").cast("double")
    se = F.sqrt(C.ratio(F.col("mse") * n, (n - 2) * n * F.col("_vx")))
    direction = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat")
    out = fit.withColumns({"std_err": se, "direction": direction})
    p = tails.t_two_sided(C.ratio(F.col("slope"), F.col("std_err")), F.col("n") - 2)
    return out.select(*keys, "n", "slope", "intercept", "r2", "std_err", "direction", p.alias("p_value"))


def trend_line(s: DataFrame, keys: list[str]) -> DataFrame:
    fit = linear_fit(s, keys).select(*keys, "slope", "intercept")
    return _back(s, fit, keys).withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("pos")).drop("slope", "intercept")


def trend_polynomial(s: DataFrame, keys: list[str]) -> DataFrame:
    """Degree-2 least squares on the position.

    Positions are complete, so about their centre the odd power sums vanish
    and the normal equations have a closed form.
    """
    u = F.col("pos") - (F.col("n_rows") - 1) / 2.0
    sums = _by(s, keys).agg(
        F.count("y").alias("n"),
        F.sum(u * u).alias("u2"),
        F.sum(u**4).alias("u4"),
        F.sum("y").alias("y"),
        F.sum(u * F.col("y")).alias("uy"),
        F.sum(u * u * F.col("y")).alias("u2y"),
        F.max((F.col("n_rows") - 1) / 2.0).alias("c"),
        F.var_pop("y").alias("vy"),
    )
    n, u2, u4, y = F.col("n"), F.col("u2"), F.col("u4"), F.col("y")
    fit = sums.withColumns(
        {"a": C.ratio(n * F.col("u2y") - u2 * y, n * u4 - u2 * u2), "b": C.ratio(F.col("uy"), u2)}
    ).withColumn("m", (y - F.col("a") * u2) / n)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    # explained sum of squares about the mean
    ess = a * a * (u4 - u2 * u2 / n) + b * b * u2
    turn = c - C.ratio(b, 2 * a)
    return fit.select(
        *keys,
        "n",
        a.alias("quadratic"),
        (b - 2 * a * c).alias("linear"),
        (F.col("m") - b * c + a * c * c).alias("constant"),
        C.ratio(ess, n * F.col("vy")).alias("r2"),
        F.when(a > 0, "convex").when(a < 0, "concave").otherwise("linear").alias("curvature"),
        F.when((turn >= 0) & (turn < n), turn).alias("turning_point"),
    )


def auto_window() -> Column:
    return F.greatest(F.lit(3), F.floor(F.col("n_rows") / 10))


def moving_trend(s: DataFrame, keys: list[str], window: int | None = None) -> DataFrame:
    return window_mean(s, keys, F.lit(window) if window else auto_window())


def trend_moving_average(s: DataFrame, keys: list[str], window: int | None = None, chunk: int = O.CHUNK) -> DataFrame:
    """Direction counts and smoothness of the centred moving average."""
    trend = moving_trend(s, keys, window)
    h, w = halo(trend, keys, 1, chunk=chunk)
    d = O.drop_halo(h.withColumns({"_dt": F.col("trend") - F.lag("trend").over(w), "_dy": F.col("y") - F.lag("y").over(w)}))
    # ends repeat the nearest window, so equal neighbours differ by rounding only
    calm = F.abs("_dt") <= 1e-9 * F.greatest(F.abs("trend"), F.lit(1e-300))
    up, down = F.count_if((F.col("_dt") > 0) & ~calm), F.count_if((F.col("_dt") < 0) & ~calm)
    sy = F.stddev_pop("_dy")
    return _by(d, keys).agg(
        F.max(F.lit(window) if window else auto_window()).alias("window"),
        up.alias("increasing"),
        down.alias("decreasing"),
        (F.count("_dt") - up - down).alias("stable"),
        F.when(up > down, "increasing").when(down > up, "decreasing").otherwise("mixed").alias("direction"),
        F.when(sy > 0, 1 - F.stddev_pop("_dt") / sy).otherwise(1.0).alias("smoothness"),
    )


FRAME_ROWS = 4096


def _change_points_framed(s: DataFrame, keys: list[str], window: int, chunk: int = O.CHUNK) -> DataFrame:
    stats = _by(s, keys).agg(F.stddev_pop("y").alias("_std"))
    h, w = halo(_back(s, stats, keys), keys, window, window, chunk)
    before = F.regr_slope("y", "pos").over(w.rowsBetween(-window, -1))
    after = F.regr_slope("y", "pos").over(w.rowsBetween(0, window - 1))
    out = O.drop_halo(h.withColumns({"before_slope": before, "after_slope": after}))
    inside = (F.col("n_rows") >= 6) & (F.col("pos") >= window) & (F.col("pos") < F.col("n_rows") - window)
    change = F.abs(F.col("after_slope") - F.col("before_slope"))
    out = out.where(inside).withColumn("slope_change", change).where(F.col("slope_change") > F.col("_std") / 2)
    return out.select(*keys, "pos", "time", "before_slope", "after_slope", "slope_change")


def change_points(s: DataFrame, keys: list[str], window: int | None = None) -> DataFrame:
    """Positions where the slopes of the rows before and after differ by more than std / 2.

    Narrow windows use row frames; wide ones running sums of y and pos * y.
    """
    if window is not None and window <= FRAME_ROWS:
        return _change_points_framed(s, keys, window)
    stats = _by(s, keys).agg(F.avg("y").alias("_mean"), F.stddev_pop("y").alias("_std"))
    base = _back(s, stats, keys).withColumn("_w", (F.lit(window) if window else auto_window()).cast("long"))
    dev = F.col("y") - F.col("_mean")
    sums = O.running_sum(base, {"_a": dev, "_b": dev * (F.col("pos") - F.col("n_rows") / 2)}, keys)
    cum = sums.select(*keys, F.col("pos").alias("_p"), "_a", "_b")
    want = sums.where((F.col("n_rows") >= 6) & (F.col("pos") >= F.col("_w")) & (F.col("pos") < F.col("n_rows") - F.col("_w"))).drop("_a", "_b")
    for name, at in (("lo", F.col("pos") - F.col("_w") - 1), ("mid", F.col("pos") - 1), ("hi", F.col("pos") + F.col("_w") - 1)):
        side = cum.select(*keys, "_p", F.col("_a").alias(f"_a_{name}"), F.col("_b").alias(f"_b_{name}"))
        cond = O.same_keys("l", "r", keys) & (F.col("l._at") == F.col("r._p"))
        want = want.withColumn("_at", at).alias("l").join(side.alias("r"), cond, "left")
        want = want.select("l.*", f"r._a_{name}", f"r._b_{name}").drop("_at")
    w = F.col("_w").cast("double")
    zero = F.lit(0.0)

    def slope(lo, hi, first):
        a = F.col(f"_a_{hi}") - F.coalesce(F.col(f"_a_{lo}"), zero)
        b = F.col(f"_b_{hi}") - F.coalesce(F.col(f"_b_{lo}"), zero)
        centre = first + (w - 1) / 2 - F.col("n_rows") / 2
        return 12 * (b - centre * a) / (w * (w * w - 1))

    before, after = slope("lo", "mid", F.col("pos") - w), slope("mid", "hi", F.col("pos"))
    out = want.select(*keys, "pos", "time", before.alias("before_slope"), after.alias("after_slope"), "_std")
    change = F.abs(F.col("after_slope") - F.col("before_slope"))
    return out.withColumn("slope_change", change).where(F.col("slope_change") > F.col("_std") / 2).drop("_std")


def trend_strength(s: DataFrame, keys: list[str], method: str = "linear") -> DataFrame:
    """Variance ratios of trend and residual, with strength and quality classes."""
    if method == "linear":
        rows = trend_line(s, keys).withColumnRenamed("fitted", "trend")
        fit = linear_fit(s, keys).select(*keys, "r2")
    else:
        rows = moving_trend(s, keys)
        fit = _by(s, keys).agg(F.lit(0.0).alias("r2"))
    out = _by(rows, keys).agg(
        F.var_pop("trend").alias("_t"), F.var_pop(F.col("y") - F.col("trend")).alias("_r"), F.var_pop("y").alias("_v")
    )
    out = _back(out, fit, keys)
    strength = C.or_zero(C.ratio(F.col("_t"), F.col("_v")))
    steps = [(0.7, "very_strong"), (0.5, "strong"), (0.3, "moderate"), (0.1, "weak")]
    return out.select(
        *keys,
        strength.alias("strength"),
        F.coalesce(1 - C.ratio(F.col("_r"), F.col("_v")), F.lit(1.0)).alias("consistency"),
        C.or_zero(C.ratio(F.col("_r"), F.col("_v"))).alias("residual_ratio"),
        C.ratio(F.col("_t"), F.col("_r")).alias("signal_to_noise"),
        C.bands(strength, steps, "very_weak").alias("strength_class"),
        C.bands(F.col("r2"), [(0.8, "excellent"), (0.6, "good"), (0.4, "fair")], "poor").alias("quality"),
    )


def autocorrelation(s: DataFrame, keys: list[str], max_lag: int = 50, chunk: int = O.CHUNK) -> DataFrame:
    """Correlation of y with its lag, for lags up to half the length and ``max_lag``."""
    rows = lag_array(s, keys, max_lag, chunk).select(*keys, "y", "n_rows", F.posexplode("lags").alias("k", "x"))
    rows = rows.where(F.col("x").isNotNull()).withColumn("lag", F.col("k") + 1).where(F.col("lag") <= F.floor(F.col("n_rows") / 2))
    out = rows.groupBy(*keys, "lag").agg(C.corr(F.col("x"), F.col("y")).alias("r"), F.max("n_rows").alias("n"))
    out = out.where(F.col("r").isNotNull() & ~F.isnan("r"))
    return out.withColumn("significant", F.abs("r") > 2 / F.sqrt("n"))


def autocorrelation_diff(s: DataFrame, keys: list[str], max_lag: int = 50, chunk: int = O.CHUNK) -> DataFrame:
    d = lag_diff(s, keys, chunk).where("diff is not null")
    d = d.select(*keys, "time", F.col("diff").alias("y"), (F.col("pos") - 1).alias("pos"), (F.col("n_rows") - 1).alias("n_rows"))
    return autocorrelation(d, keys, max_lag, chunk)


def acf(s: DataFrame, keys: list[str], max_lag: int = 20, chunk: int = O.CHUNK) -> DataFrame:
    """Mean-centred autocorrelation with the full-series denominator."""
    mean = _by(s, keys).agg(F.avg("y").alias("_m"), (F.var_pop("y") * F.count("y")).alias("_ss"))
    rows = _back(s, mean, keys).withColumn("y", F.col("y") - F.col("_m"))
    long = lag_array(rows, keys, max_lag, chunk).select(*keys, "y", "_ss", "n_rows", F.posexplode("lags").alias("k", "x"))
    long = long.where(F.col("x").isNotNull() & (F.col("k") + 1 <= F.floor(F.col("n_rows") / 4))).withColumn("lag", F.col("k") + 1)
    out = long.groupBy(*keys, "lag").agg(C.ratio(F.sum(F.col("x") * F.col("y")), F.max("_ss")).alias("acf"))
    return out.withColumn("beyond", F.abs("acf") > 0.2)


def acf_pacf(s: DataFrame, keys: list[str], max_lag: int = 20, chunk: int = O.CHUNK) -> DataFrame:
    """ACF with the partial values by the Levinson-Durbin recursion on the few ACF rows of each series."""
    import numpy as np
    import pandas as pd

    a = acf(s, keys, max_lag, chunk)
    spec = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema.fields if f.name in keys])
    spec = (spec + ", " if spec else "") + "lag int, acf double, pacf double, beyond boolean"

    def recur(pdf):
        pdf = pdf.sort_values("lag").reset_index(drop=True)
        r = np.concatenate(([1.0], pdf["acf"].to_numpy()))
        phi, var, out = np.zeros(0), 1.0, []
        for k in range(1, len(r)):
            top = r[k] - (phi @ r[1:k][::-1] if k > 1 else 0.0)
            p = top / var if var > 0 else np.nan
            phi = np.concatenate((phi - p * phi[::-1], [p]))
            var *= 1 - p * p
            out.append(p)
        return pdf.assign(pacf=out, lag=pdf["lag"].astype("int32"))[[*keys, "lag", "acf", "pacf", "beyond"]]

    return a.groupBy(*(keys or [F.lit(0).alias("_one")])).applyInPandas(recur, spec)


def decompose(s: DataFrame, keys: list[str], period: int | None = None) -> DataFrame:
    """Centred-mean trend, mean detrended value per phase, residual."""
    auto = F.when(F.col("n_rows") >= 12, 12).when(F.col("n_rows") >= 7, 7).otherwise(F.least(F.lit(4), F.floor(F.col("n_rows") / 2)))
    p = F.lit(period) if period else auto
    rows = window_mean(s, keys, p.cast("long")).withColumn("phase", (F.col("pos") % p).cast("int"))
    season = rows.groupBy(*keys, "phase").agg(F.avg(F.col("y") - F.col("trend")).alias("seasonal"))
    out = O.join_small(rows, season, [*keys, "phase"], bounded=not keys)
    return out.withColumn("residual", F.col("y") - F.col("trend") - F.col("seasonal"))


def calendar_patterns(s: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, std and count by month and by weekday (Monday 0)."""
    unit = F.array(
        F.struct(F.lit("month").alias("pattern"), F.month("time").alias("unit")),
        F.struct(F.lit("weekday").alias("pattern"), F.weekday("time").alias("unit")),
    )
    rows = s.select(*keys, "y", F.inline(unit))
    return rows.groupBy(*keys, "pattern", "unit").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.count("y").alias("n"))


def calendar_strength(s: DataFrame, keys: list[str]) -> DataFrame:
    rows = calendar_patterns(s, keys).groupBy(*keys, "pattern").agg(
        F.count(F.lit(1)).alias("units"), C.or_zero(C.ratio(F.stddev_pop("mean"), F.avg("mean"))).alias("strength")
    )
    rows = rows.where("units > 1")
    best = _by(rows, keys).agg(F.max_by("pattern", "strength").alias("strongest"))
    return _back(rows, best, keys).withColumn("is_strongest", F.col("pattern") == F.col("strongest")).drop("strongest")


def _future(base: DataFrame, keys: list[str], periods: int) -> DataFrame:
    """``step`` 1..periods per series with ``time`` moved on by the median interval."""
    return base.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn(
        "time", F.timestamp_micros((F.col("_last") + F.col("step") * F.col("_gap") * 1e6).cast("long")).cast("timestamp_ntz")
    )


def _tail_info(s: DataFrame, keys: list[str]) -> DataFrame:
    last = _by(s, keys).agg(
        F.max(F.unix_micros(F.col("time").cast("timestamp"))).alias("_last"),
        F.max_by("y", "pos").alias("_y_last"),
        F.min_by("y", "pos").alias("_y_first"),
        F.count("y").alias("_len"),
    )
    gap = _median_steps(s, keys).withColumnRenamed("step", "_gap")
    return O.join_small(last, gap, keys, bounded=not keys)


def forecast_linear(s: DataFrame, keys: list[str], periods: int = 10) -> DataFrame:
    fit = linear_fit(s, keys).select(*keys, "slope", "intercept", "mse")
    rows = _future(O.join_small(_tail_info(s, keys), fit, keys, bounded=not keys), keys, periods)
    y = F.col("intercept") + F.col("slope") * (F.col("_len") + F.col("step") - 1)
    edge = 1.96 * F.sqrt("mse")
    return rows.select(*keys, "step", "time", y.alias("forecast"), (y - edge).alias("lower"), (y + edge).alias("upper"))


def forecast_ses(s: DataFrame, keys: list[str], periods: int = 10, alpha: float = 0.3) -> DataFrame:
    level = _by(smooth(s, keys, alpha), keys).agg(F.max_by("smoothed", "pos").alias("_level"))
    rows = _future(O.join_small(_tail_info(s, keys), level, keys, bounded=not keys), keys, periods)
    return rows.select(*keys, "step", "time", F.col("_level").alias("forecast"))


def forecast_drift(s: DataFrame, keys: list[str], periods: int = 10) -> DataFrame:
    """Last value plus the mean difference per step."""
    rows = _future(_tail_info(s, keys), keys, periods)
    mean_diff = C.ratio(F.col("_y_last") - F.col("_y_first"), F.col("_len") - 1)
    return rows.select(*keys, "step", "time", (F.col("_y_last") + F.col("step") * mean_diff).alias("forecast"))


def forecast_ensemble(rows: DataFrame, keys: list[str], mse: DataFrame | None = None) -> DataFrame:
    """Mean, median and 1/(1+mse)-weighted forecast over ``(keys..., model, step, forecast)`` rows."""
    weight = F.lit(1.0)
    if mse is not None:
        rows = rows.join(mse, [*keys, "model"])
        weight = 1 / (1 + F.col("mse"))
    return rows.groupBy(*keys, "step").agg(  # a handful of models per step
        F.avg("forecast").alias("mean"),
        F.percentile("forecast", F.lit(0.5)).alias("median"),
        C.ratio(F.sum(weight * F.col("forecast")), F.sum(weight)).alias("weighted"),
        F.count(F.lit(1)).alias("models"),
    )


def forecast_accuracy(actual: DataFrame, predicted: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    rows = actual.join(predicted, [*keys, *on])
    e = F.col("y") - F.col("forecast")
    out = _by(rows, keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(1e-8))) * 100).alias("mape"),
        (1 - C.ratio(F.avg(e * e), F.var_pop("y"))).alias("r2"),
    )
    return out


def split_by_time(s: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """Chronological split: the first ``train_ratio`` of positions train."""
    return s.withColumn("split", F.when(F.col("pos") < F.floor(F.col("n_rows") * train_ratio), "train").otherwise("test"))


def backtest_linear(s: DataFrame, keys: list[str], initial: int, period: int, horizon: int) -> DataFrame:
    """Line fitted up to each cutoff, scored on the next ``horizon`` rows; one row per cutoff.

    A cutoff needs only running sums at its position, and each row is scored
    by the cutoffs whose horizon covers it.
    """
    base = O.running_sum(
        s,
        {
            "_n": F.lit(1.0),
            "_x": F.col("pos").cast("double"),
            "_y": F.col("y"),
            "_xx": F.col("pos").cast("double") ** 2,
            "_xy": F.col("pos") * F.col("y"),
            "_yy": F.col("y") ** 2,
        },
        keys,
    )
    cut = base.where((F.col("pos") >= initial - 1) & ((F.col("pos") - (initial - 1)) % period == 0) & (F.col("pos") < F.col("n_rows") - 1))
    n, x, y, xx, xy, yy = (F.col(c) for c in ("_n", "_x", "_y", "_xx", "_xy", "_yy"))
    slope = C.ratio(n * xy - x * y, n * xx - x * x)
    icept = (y - slope * x) / n
    sse = yy - icept * y - slope * xy
    fits = cut.select(*keys, F.col("pos").alias("cutoff"), slope.alias("_slope"), icept.alias("_icept"), (1.96 * F.sqrt(F.greatest(sse / n, F.lit(0.0)))).alias("_edge"))
    # cutoffs whose horizon holds the row: the last one before it and earlier ones in reach
    last = F.floor((F.col("pos") - 1 - (initial - 1)) / period)
    first = F.greatest(F.ceil((F.col("pos") - horizon - (initial - 1)) / period), F.lit(0))
    rows = s.where((F.col("pos") >= initial) & (last >= first)).withColumn("_c", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("cutoff", F.col("_c") * period + initial - 1)
    joined = O.join_small(rows, fits, [*keys, "cutoff"], bounded=False)
    f = F.col("_icept") + F.col("_slope") * F.col("pos")
    e = F.col("y") - f
    return joined.groupBy(*keys, "cutoff").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(1e-8))) * 100).alias("mape"),
        F.avg((F.abs(e) <= F.col("_edge")).cast("double")).alias("coverage"),
    )


def forecast_anomalies(actual: DataFrame, band: DataFrame, keys: list[str], on: list[str], y: str = "y") -> DataFrame:
    """Actual values outside their forecast band with the deviation."""
    rows = actual.join(band, [*keys, *on])
    out = (F.col(y) < F.col("lower")) | (F.col(y) > F.col("upper"))
    return rows.where(out).withColumns(
        {
            "deviation": F.col(y) - F.col("forecast"),
            "side": F.when(F.col(y) > F.col("upper"), "above").otherwise("below"),
        }
    )


def anomaly_rate(actual: DataFrame, band: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    rows = actual.join(band, [*keys, *on])
    out = (F.col("y") < F.col("lower")) | (F.col("y") > F.col("upper"))
    return _by(rows, keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(out).alias("anomalies"), (F.avg(out.cast("double")) * 100).alias("rate")
    )
