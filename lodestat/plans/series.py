"""Queries over the time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import series as S
from lodestat.operators import spectrum as P
from lodestat.plans.registry import EVENTS_DAILY, ORDERS_DAILY, query

K = ["event_type"]
EV = f"(SELECT event_type, CAST(d AS TIMESTAMP) AS time, y, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n_rows FROM {EVENTS_DAILY} e)"
OD = f"(SELECT CAST(d AS TIMESTAMP) AS time, y, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS n_rows FROM {ORDERS_DAILY} e)"


def ev(t):
    return S.prepare_series(t.events_daily, "d", "y", K)


def od(t):
    return S.prepare_series(t.orders_daily, "d", "y")


def day(df):
    """Dates as text, so that both engines print them alike."""
    return df.withColumn("time", F.date_format("time", "yyyy-MM-dd"))


DAY = "strftime(time, '%Y-%m-%d') AS time"
WK = "PARTITION BY event_type ORDER BY pos"


@query("prepare_series", f"SELECT event_type, {DAY}, y, pos, n_rows FROM {EV} x")
def _(t):
    return day(ev(t))


@query("row_ordinal", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders")
def _(t):
    return S.row_ordinal(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "lag_diff",
    f"SELECT event_type, pos, y - lag(y) OVER ({WK}) AS diff, date_diff('second', lag(time) OVER ({WK}), time) AS step_seconds FROM {EV} x",
    approx=("diff", "step_seconds"),
)
def _(t):
    return S.lag_diff(ev(t), K).select("event_type", "pos", "diff", "step_seconds")


@query(
    "rolling_band",
    f"""WITH r AS (SELECT pos, y, CASE WHEN pos >= 6 THEN avg(y) OVER w END AS rolling_mean, CASE WHEN pos >= 6 THEN stddev_samp(y) OVER w END AS rolling_std
          FROM {OD} x WINDOW w AS (ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
        d AS (SELECT *, rolling_mean - lag(rolling_mean) OVER (ORDER BY pos) AS step FROM r)
        SELECT pos, rolling_mean, rolling_std, rolling_mean + 2 * rolling_std AS upper, rolling_mean - 2 * rolling_std AS lower,
          CASE WHEN step > 0 THEN 'up' WHEN step < 0 THEN 'down' WHEN step = 0 THEN 'flat' END AS direction FROM d""",
    approx=("rolling_mean", "rolling_std", "upper", "lower"),
)
def _(t):
    return S.rolling_band(od(t), [], 7).drop("time", "y", "n_rows")


def centred_sql(src, left, right, keys=""):
    """Full windows only, ends filled from the nearest full window."""
    part = f"PARTITION BY {keys}" if keys else ""
    pre = f"{keys}, " if keys else ""
    return f"""(SELECT {pre}time, pos, n_rows, y, coalesce(m, first_value(m IGNORE NULLS) OVER ({part} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        last_value(m IGNORE NULLS) OVER ({part} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS trend FROM (
        SELECT *, CASE WHEN pos >= {left} AND pos + {right} < n_rows THEN
          avg(y) OVER ({part} ORDER BY pos ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) END AS m FROM {src} q1) q2)"""


@query(
    "rolling_mean_centered",
    f"SELECT event_type, pos, trend AS rolling_mean FROM {centred_sql(EV, 2, 2, 'event_type')} x",
    approx=("rolling_mean",),
)
def _(t):
    return S.rolling_mean_centered(ev(t), K, 5).select("event_type", "pos", "rolling_mean")


@query(
    "lag_matrix",
    f"""SELECT event_type, pos, y AS target, lag(y, 3) OVER w AS x1, lag(y, 2) OVER w AS x2, lag(y, 1) OVER w AS x3
        FROM {EV} x WINDOW w AS ({WK}) QUALIFY pos >= 3""",
)
def _(t):
    m = S.lag_matrix(ev(t), K, 3)
    return m.select("event_type", "pos", "target", *[F.col("features")[i].alias(f"x{i + 1}") for i in range(3)])


@query(
    "share_of_row",
    """WITH p AS (SELECT CAST(ts AS DATE) AS d, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS click,
         sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS view FROM events GROUP BY 1)
       SELECT strftime(d, '%Y-%m-%d') AS d, click / (click + view) AS click_share, view / (click + view) AS view_share FROM p""",
    approx=("click_share", "view_share"),
)
def _(t):
    def total(kind):
        return F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)).alias(kind)

    days = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(total("click"), total("view"))
    return S.share_of_row(days, ["click", "view"]).drop("click", "view")


PARTS = "(SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1)"


def parts(t):
    return t.lineitem.groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v"))


@query(
    "cumulative_share",
    f"""SELECT l_partkey, v, row_number() OVER w AS rank, sum(v) OVER w / sum(v) OVER () AS cumulative_share FROM {PARTS} x
        WINDOW w AS (ORDER BY abs(v) DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    approx=("cumulative_share",),
)
def _(t):
    return S.cumulative_share(parts(t), "v", [], ["l_partkey"])


@query("importance_rank", f"SELECT l_partkey, row_number() OVER (ORDER BY abs(v) DESC, l_partkey) AS rank FROM {PARTS} x")
def _(t):
    return S.cumulative_share(parts(t), "v", [], ["l_partkey"]).select("l_partkey", "rank")


@query(
    "time_analysis",
    f"""WITH d AS (SELECT event_type, time, date_diff('second', lag(time) OVER ({WK}), time) / 86400 AS s FROM {EV} x)
        SELECT event_type, count(*) AS n, avg(s) AS mean_interval_days, min(s) = max(s) AS is_constant,
          date_diff('day', min(time), max(time)) AS span_days, CASE WHEN avg(s) < 0.9 THEN 'sub-daily' WHEN avg(s) < 1.5 THEN 'daily'
          WHEN avg(s) < 10 THEN 'weekly' WHEN avg(s) < 45 THEN 'monthly' WHEN avg(s) < 120 THEN 'quarterly' ELSE 'yearly' END AS frequency
        FROM d GROUP BY 1""",
    approx=("mean_interval_days",),
)
def _(t):
    return S.time_analysis(ev(t), K)


@query(
    "series_stats",
    f"""SELECT event_type, count(y) AS n, avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max, max(y) - min(y) AS range,
        stddev_pop(y) / avg(y) AS cv, CASE WHEN arg_max(y, pos) > arg_min(y, pos) THEN 'increasing' ELSE 'decreasing' END AS direction
        FROM {EV} x GROUP BY 1""",
    approx=("mean", "std", "range", "cv"),
)
def _(t):
    return S.series_stats(ev(t), K)


@query(
    "trend_linear",
    f"""SELECT event_type, count(y) AS n, regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS intercept, regr_r2(y, pos) AS r2,
        sqrt((1 - regr_r2(y, pos)) * var_pop(y) / ((count(y) - 2) * var_pop(pos))) AS std_err,
        CASE WHEN regr_slope(y, pos) > 0 THEN 'increasing' WHEN regr_slope(y, pos) < 0 THEN 'decreasing' ELSE 'flat' END AS direction
        FROM {EV} x GROUP BY 1""",
    approx=("slope", "intercept", "r2", "std_err"),
)
def _(t):
    return S.trend_linear(ev(t), K).drop("p_value")


@query("trend_linear_p")
def _(t):
    return S.trend_linear(ev(t), K)


@query(
    "trend_polynomial",
    f"""WITH u AS (SELECT event_type, y, pos - (n_rows - 1) / 2.0 AS u, n_rows AS n, (n_rows - 1) / 2.0 AS c FROM {EV} x),
        s AS (SELECT event_type, any_value(n) AS n, any_value(c) AS c, sum(u * u) AS u2, sum(u * u * u * u) AS u4, sum(y) AS sy, sum(u * y) AS uy,
              sum(u * u * y) AS u2y, var_pop(y) AS vy FROM u GROUP BY 1),
        f AS (SELECT *, (n * u2y - u2 * sy) / (n * u4 - u2 * u2) AS a, uy / u2 AS b FROM s),
        g AS (SELECT *, (sy - a * u2) / n AS m, c - b / (2 * a) AS turn FROM f)
        SELECT event_type, n, a AS quadratic, b - 2 * a * c AS linear, m - b * c + a * c * c AS constant,
          (a * a * (u4 - u2 * u2 / n) + b * b * u2) / (n * vy) AS r2,
          CASE WHEN a > 0 THEN 'convex' WHEN a < 0 THEN 'concave' ELSE 'linear' END AS curvature,
          CASE WHEN turn >= 0 AND turn < n THEN turn END AS turning_point FROM g""",
    approx=("quadratic", "linear", "constant", "r2", "turning_point"),
)
def _(t):
    return S.trend_polynomial(ev(t), K)


@query(
    "trend_moving_average",
    f"""WITH m AS (SELECT * FROM {centred_sql(OD, 3, 3)} x),
        d AS (SELECT trend - lag(trend) OVER (ORDER BY pos) AS dt, y - lag(y) OVER (ORDER BY pos) AS dy, trend FROM m),
        s AS (SELECT count(*) FILTER (dt > 0 AND abs(dt) > 1e-9 * abs(trend)) AS increasing, count(*) FILTER (dt < 0 AND abs(dt) > 1e-9 * abs(trend)) AS decreasing,
              count(dt) AS n, stddev_pop(dt) AS st, stddev_pop(dy) AS sy FROM d)
        SELECT 7 AS window, increasing, decreasing, n - increasing - decreasing AS stable,
          CASE WHEN increasing > decreasing THEN 'increasing' WHEN decreasing > increasing THEN 'decreasing' ELSE 'mixed' END AS direction,
          1 - st / sy AS smoothness FROM s""",
    approx=("smoothness",),
)
def _(t):
    return S.trend_moving_average(od(t), [], 7)


@query(
    "change_points",
    f"""WITH s AS (SELECT stddev_pop(y) AS sd FROM {OD} x),
        w AS (SELECT pos, time, n_rows, regr_slope(y, pos) OVER (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before_slope,
              regr_slope(y, pos) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS after_slope FROM {OD} x)
        SELECT pos, {DAY}, before_slope, after_slope, abs(after_slope - before_slope) AS slope_change FROM w, s
        WHERE pos >= 3 AND pos < n_rows - 3 AND abs(after_slope - before_slope) > sd / 2""",
    approx=("before_slope", "after_slope", "slope_change"),
)
def _(t):
    return day(S.change_points(od(t), [], 3))


@query(
    "trend_strength",
    f"""WITH f AS (SELECT event_type, regr_slope(y, pos) AS b, regr_intercept(y, pos) AS a, regr_r2(y, pos) AS r2 FROM {EV} x GROUP BY 1),
        v AS (SELECT event_type, var_pop(a + b * pos) AS t, var_pop(y - a - b * pos) AS r, var_pop(y) AS v, any_value(r2) AS r2
              FROM {EV} x JOIN f USING (event_type) GROUP BY 1)
        SELECT event_type, t / v AS strength, 1 - r / v AS consistency, r / v AS residual_ratio, t / r AS signal_to_noise,
          CASE WHEN t / v >= 0.7 THEN 'very_strong' WHEN t / v >= 0.5 THEN 'strong' WHEN t / v >= 0.3 THEN 'moderate' WHEN t / v >= 0.1 THEN 'weak' ELSE 'very_weak' END AS strength_class,
          CASE WHEN r2 >= 0.8 THEN 'excellent' WHEN r2 >= 0.6 THEN 'good' WHEN r2 >= 0.4 THEN 'fair' ELSE 'poor' END AS quality FROM v""",
    approx=("strength", "consistency", "residual_ratio", "signal_to_noise"),
)
def _(t):
    return S.trend_strength(ev(t), K)


def acorr_sql(src):
    return f"""WITH s AS (SELECT * FROM {src} x), l AS (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS lag)
      SELECT a.event_type, lag, corr(a.y, b.y) AS r, any_value(a.n_rows) AS n, abs(corr(a.y, b.y)) > 2 / sqrt(any_value(a.n_rows)) AS significant
      FROM s a JOIN l ON lag <= a.n_rows // 2 JOIN s b ON b.event_type = a.event_type AND b.pos = a.pos - lag GROUP BY 1, 2
      HAVING corr(a.y, b.y) IS NOT NULL AND NOT isnan(corr(a.y, b.y))"""


@query("autocorrelation", acorr_sql(EV), approx=("r",))
def _(t):
    return S.autocorrelation(ev(t), K)


@query(
    "autocorrelation_diff",
    acorr_sql(f"(SELECT event_type, pos - 1 AS pos, n_rows - 1 AS n_rows, y - lag(y) OVER ({WK}) AS y FROM {EV} z QUALIFY pos > 0)"),
    approx=("r",),
)
def _(t):
    return S.autocorrelation_diff(ev(t), K)


@query(
    "acf",
    f"""WITH m AS (SELECT event_type, avg(y) AS m, var_pop(y) * count(*) AS ss FROM {EV} x GROUP BY 1),
        s AS (SELECT event_type, pos, n_rows, y - m AS y, ss FROM {EV} x JOIN m USING (event_type)), l AS (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS lag)
        SELECT a.event_type, lag, sum(a.y * b.y) / any_value(a.ss) AS acf, abs(sum(a.y * b.y) / any_value(a.ss)) > 0.2 AS beyond
        FROM s a JOIN l ON lag <= a.n_rows // 4 JOIN s b ON b.event_type = a.event_type AND b.pos = a.pos - lag GROUP BY 1, 2""",
    approx=("acf",),
)
def _(t):
    return S.acf(ev(t), K)


@query("acf_pacf")
def _(t):
    return S.acf_pacf(od(t), [])


SPEC = f"""WITH s AS (SELECT event_type, pos, n_rows AS n, y - avg(y) OVER (PARTITION BY event_type) AS y FROM {EV} x),
    f AS (SELECT DISTINCT event_type, n, unnest(range(1, (n + 1) // 2)) AS k FROM s),
    p AS (SELECT f.event_type, k, any_value(f.n) AS n, pow(sum(y * cos(2 * pi() * ((k * pos) % f.n) / f.n)), 2) + pow(sum(y * sin(2 * pi() * ((k * pos) % f.n) / f.n)), 2) AS power
      FROM f JOIN s USING (event_type) GROUP BY 1, 2)"""


@query("periodogram", SPEC + " SELECT event_type, k, n, k / n AS frequency, n / k AS period, power FROM p", approx=("frequency", "period", "power"))
def _(t):
    return P.power_spectrum(ev(t), K)


PEAKS = """, q AS (SELECT *, lag(power) OVER (PARTITION BY event_type ORDER BY k) AS b, lead(power) OVER (PARTITION BY event_type ORDER BY k) AS a,
      max(power) OVER (PARTITION BY event_type) AS m FROM p),
    r AS (SELECT event_type, k, k / n AS frequency, n / k AS period, power, power / m AS relative_power,
      CAST(row_number() OVER (PARTITION BY event_type ORDER BY power DESC, k) AS INTEGER) AS rank FROM q WHERE power > a AND power > b AND power >= 0.1 * m)"""


@query("periodogram_peaks", SPEC + PEAKS + " SELECT * FROM r WHERE rank <= 5", approx=("frequency", "period", "power", "relative_power"))
def _(t):
    return P.periodogram_peaks(ev(t), K)


DEC = f"""d AS (SELECT *, CAST(pos % 7 AS INTEGER) AS phase FROM {centred_sql(EV, 3, 3, 'event_type')} x),
    z AS (SELECT event_type, phase, avg(y - trend) AS seasonal FROM d GROUP BY 1, 2),
    dec AS (SELECT d.event_type, pos, y, trend, phase, seasonal, y - trend - seasonal AS residual FROM d JOIN z USING (event_type, phase))"""


@query("decompose", f"WITH {DEC} SELECT event_type, pos, trend, phase, seasonal, residual FROM dec", approx=("trend", "seasonal", "residual"))
def _(t):
    return S.decompose(ev(t), K, 7).drop("time", "y", "n_rows")


@query(
    "seasonality_strength",
    SPEC
    + PEAKS
    + f""", {DEC}, v AS (SELECT event_type, var_pop(seasonal) / var_pop(y) AS variance_ratio FROM dec GROUP BY 1),
      b AS (SELECT event_type, relative_power, period FROM r WHERE rank = 1),
      o AS (SELECT event_type, variance_ratio, coalesce(relative_power, 0) AS frequency_strength, period AS dominant_period,
        greatest(variance_ratio, coalesce(relative_power, 0)) AS overall FROM v LEFT JOIN b USING (event_type))
      SELECT *, CASE WHEN overall >= 0.6 THEN 'very_strong' WHEN overall >= 0.4 THEN 'strong' WHEN overall >= 0.2 THEN 'moderate'
        WHEN overall >= 0.1 THEN 'weak' ELSE 'very_weak' END AS level, CASE WHEN dominant_period IS NULL THEN 'none'
        WHEN dominant_period BETWEEN 11 AND 13 THEN 'yearly' WHEN dominant_period BETWEEN 6 AND 8 THEN 'weekly'
        WHEN dominant_period BETWEEN 3 AND 5 THEN 'short_cycle' ELSE 'custom' END AS type FROM o""",
    approx=("variance_ratio", "frequency_strength", "dominant_period", "overall"),
)
def _(t):
    return P.seasonality_strength(ev(t), K, 7)


CAL = f"""c AS (SELECT 'month' AS pattern, CAST(month(time) AS INTEGER) AS unit, y FROM {OD} x UNION ALL
    SELECT 'weekday', CAST(isodow(time) - 1 AS INTEGER), y FROM {OD} x),
  cp AS (SELECT pattern, unit, avg(y) AS mean, stddev_samp(y) AS std, count(y) AS n FROM c GROUP BY 1, 2)"""


@query("calendar_patterns", f"WITH {CAL} SELECT * FROM cp", approx=("mean", "std"))
def _(t):
    return S.calendar_patterns(od(t), [])


@query(
    "calendar_strength",
    f"""WITH {CAL}, s AS (SELECT pattern, count(*) AS units, stddev_pop(mean) / avg(mean) AS strength FROM cp GROUP BY 1 HAVING count(*) > 1)
        SELECT *, strength = max(strength) OVER () AS is_strongest FROM s""",
    approx=("strength",),
)
def _(t):
    return S.calendar_strength(od(t), [])


INFO = f"""i AS (SELECT event_type, max(time) AS last, arg_max(y, pos) AS yl, arg_min(y, pos) AS yf, count(*) AS n, regr_slope(y, pos) AS b,
    regr_intercept(y, pos) AS a, (1 - regr_r2(y, pos)) * var_pop(y) AS mse FROM {EV} x GROUP BY 1),
  g AS (SELECT event_type, median(s) AS gap FROM (SELECT event_type, date_diff('second', lag(time) OVER ({WK}), time) AS s FROM {EV} x) GROUP BY 1),
  k AS (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS step),
  fut AS (SELECT event_type, step, strftime(last + to_seconds(CAST(step * gap AS BIGINT)), '%Y-%m-%d') AS time, yl, yf, n, a, b, mse FROM i JOIN g USING (event_type), k)"""


@query(
    "forecast_linear",
    f"""WITH {INFO} SELECT event_type, step, time, a + b * (n + step - 1) AS forecast, a + b * (n + step - 1) - 1.96 * sqrt(mse) AS lower,
        a + b * (n + step - 1) + 1.96 * sqrt(mse) AS upper FROM fut""",
    approx=("forecast", "lower", "upper"),
)
def _(t):
    return day(S.forecast_linear(ev(t), K))


@query(
    "forecast_drift",
    f"WITH {INFO} SELECT event_type, step, time, yl + step * (yl - yf) / (n - 1) AS forecast FROM fut",
    approx=("forecast",),
)
def _(t):
    return day(S.forecast_drift(ev(t), K))


SES = f"(SELECT event_type, pos, list_reduce(list(y) OVER ({WK}), lambda a, v: 0.3 * v + 0.7 * a) AS smoothed FROM {EV} x)"


@query("smooth", f"SELECT * FROM {SES} x", approx=("smoothed",))
def _(t):
    return S.smooth(ev(t), K).select("event_type", "pos", "smoothed")


@query(
    "forecast_ses",
    f"WITH {INFO}, l AS (SELECT event_type, arg_max(smoothed, pos) AS forecast FROM {SES} x GROUP BY 1) SELECT event_type, step, time, forecast FROM fut JOIN l USING (event_type)",
    approx=("forecast",),
)
def _(t):
    return day(S.forecast_ses(ev(t), K))


MODELS = f"""{INFO}, l AS (SELECT event_type, arg_max(smoothed, pos) AS sm FROM {SES} x GROUP BY 1),
  m AS (SELECT event_type, 'linear' AS model, step, a + b * (n + step - 1) AS forecast FROM fut
    UNION ALL SELECT event_type, 'drift', step, yl + step * (yl - yf) / (n - 1) FROM fut
    UNION ALL SELECT event_type, 'ses', step, sm FROM fut JOIN l USING (event_type)),
  e AS (SELECT event_type, 'linear' AS model, any_value(mse) / 1e6 AS mse FROM fut GROUP BY 1 UNION ALL
    SELECT event_type, unnest(['drift', 'ses']), any_value(mse) / 5e5 FROM fut GROUP BY 1)"""


def model_rows(t):
    s = ev(t)
    rows = S.forecast_linear(s, K).select("event_type", F.lit("linear").alias("model"), "step", "forecast")
    for name, f in (("drift", S.forecast_drift), ("ses", S.forecast_ses)):
        rows = rows.unionByName(f(s, K).select("event_type", F.lit(name).alias("model"), "step", "forecast"))
    fit = S.linear_fit(s, K)
    mse = fit.select("event_type", F.lit("linear").alias("model"), (F.col("mse") / 1e6).alias("mse"))
    for name in ("drift", "ses"):
        mse = mse.unionByName(fit.select("event_type", F.lit(name).alias("model"), (F.col("mse") / 5e5).alias("mse")))
    return rows, mse


@query(
    "forecast_ensemble",
    f"""WITH {MODELS} SELECT event_type, step, avg(forecast) AS mean, median(forecast) AS median,
        sum(forecast / (1 + mse)) / sum(1 / (1 + mse)) AS weighted, count(*) AS models FROM m JOIN e USING (event_type, model) GROUP BY 1, 2""",
    approx=("mean", "median", "weighted"),
)
def _(t):
    rows, mse = model_rows(t)
    return S.forecast_ensemble(rows, K, mse)


SPLIT = f"sp AS (SELECT *, CASE WHEN pos < floor(n_rows * 0.8) THEN 'train' ELSE 'test' END AS split FROM {EV} x)"


@query("split_by_time", f"WITH {SPLIT} SELECT event_type, pos, split FROM sp")
def _(t):
    return S.split_by_time(ev(t)).select("event_type", "pos", "split")


FC = f"""{SPLIT}, f AS (SELECT event_type, regr_slope(y, pos) AS b, regr_intercept(y, pos) AS a, (1 - regr_r2(y, pos)) * var_pop(y) AS mse FROM sp WHERE split = 'train' GROUP BY 1),
  t AS (SELECT sp.event_type, pos, y, a + b * pos AS fc, 1.96 * sqrt(mse) AS edge FROM sp JOIN f USING (event_type) WHERE split = 'test')"""


def held_out(t):
    split = S.split_by_time(ev(t))
    fit = S.linear_fit(split.where("split = 'train'"), K).select("event_type", "slope", "intercept", "mse")
    test = split.where("split = 'test'").select("event_type", "pos", "y")
    f = F.col("intercept") + F.col("slope") * F.col("pos")
    edge = 1.96 * F.sqrt("mse")
    band = test.join(fit, "event_type").select("event_type", "pos", f.alias("forecast"), (f - edge).alias("lower"), (f + edge).alias("upper"))
    return test, band


@query(
    "forecast_accuracy",
    f"""WITH {FC} SELECT event_type, count(*) AS n, avg(abs(y - fc)) AS mae, avg(pow(y - fc, 2)) AS mse, sqrt(avg(pow(y - fc, 2))) AS rmse,
        avg(abs(y - fc) / greatest(abs(y), 1e-8)) * 100 AS mape, 1 - avg(pow(y - fc, 2)) / var_pop(y) AS r2 FROM t GROUP BY 1""",
    approx=("mae", "mse", "rmse", "mape", "r2"),
)
def _(t):
    test, band = held_out(t)
    return S.forecast_accuracy(test, band, K, ["pos"])


@query(
    "forecast_anomalies",
    f"""WITH {FC} SELECT event_type, pos, y, fc AS forecast, fc - edge AS lower, fc + edge AS upper, y - fc AS deviation,
        CASE WHEN y > fc + edge THEN 'above' ELSE 'below' END AS side FROM t WHERE y < fc - edge OR y > fc + edge""",
    approx=("forecast", "lower", "upper", "deviation"),
)
def _(t):
    test, band = held_out(t)
    return S.forecast_anomalies(test, band, K, ["pos"])


@query(
    "anomaly_rate",
    f"""WITH {FC} SELECT event_type, count(*) AS n, count(*) FILTER (y < fc - edge OR y > fc + edge) AS anomalies,
        100.0 * count(*) FILTER (y < fc - edge OR y > fc + edge) / count(*) AS rate FROM t GROUP BY 1""",
    approx=("rate",),
)
def _(t):
    test, band = held_out(t)
    return S.anomaly_rate(test, band, K, ["pos"])


@query(
    "backtest",
    f"""WITH s AS (SELECT * FROM {OD} x), c AS (SELECT pos AS cutoff FROM s WHERE pos >= 364 AND (pos - 364) % 90 = 0 AND pos < n_rows - 1),
        f AS (SELECT cutoff, regr_slope(y, pos) AS b, regr_intercept(y, pos) AS a, 1.96 * sqrt((1 - regr_r2(y, pos)) * var_pop(y)) AS edge
              FROM c JOIN s ON pos <= cutoff GROUP BY 1)
        SELECT cutoff, count(*) AS n, avg(abs(y - a - b * pos)) AS mae, sqrt(avg(pow(y - a - b * pos, 2))) AS rmse,
          avg(abs(y - a - b * pos) / greatest(abs(y), 1e-8)) * 100 AS mape, avg(CASE WHEN abs(y - a - b * pos) <= edge THEN 1 ELSE 0 END) AS coverage
        FROM f JOIN s ON pos > cutoff AND pos <= cutoff + 120 GROUP BY 1""",
    approx=("mae", "rmse", "mape", "coverage"),
)
def _(t):
    return S.backtest_linear(od(t), [], 365, 90, 120)
