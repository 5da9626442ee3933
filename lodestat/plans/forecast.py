"""Queries over fitted forecasts, stationarity and the isolation forest."""

from __future__ import annotations

from lodestat.operators import forecast as M
from lodestat.operators import forest as T
from lodestat.operators import series as S
from lodestat.plans.registry import query
from lodestat.plans.series import EV, OD, day, ev, od


@query("outliers_isolation_forest")
def _(t):
    return T.isolation_forest(t.events, "event_id", ["value", "user_id"], contamination=0.05)


# every grid point as a recursion over the rows of a series, the state's season in a list
HOLT_WINTERS = f"""WITH RECURSIVE s AS (SELECT * FROM {EV} x),
  m AS (SELECT event_type, any_value(n_rows) AS n, n >= 24 AS seasonal, CASE WHEN n >= 24 THEN least(7, n // 2) ELSE least(2, greatest(1, n // 2)) END AS m FROM s GROUP BY 1),
  i AS (SELECT event_type, n, seasonal, m, avg(y) FILTER (pos < m) AS level, avg(y) FILTER (pos >= m AND pos < 2 * m) AS later,
    list(y ORDER BY pos) FILTER (pos < m) AS head FROM s JOIN m USING (event_type) GROUP BY ALL),
  g AS (SELECT 9 * i + 3 * j + k AS g, [0.1, 0.3, 0.5, 0.8][i + 1]::DOUBLE AS a, [0.01, 0.1, 0.3][j + 1]::DOUBLE AS b, [0.05, 0.2, 0.5][k + 1]::DOUBLE AS c
    FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(3)) AS j), (SELECT unnest(range(3)) AS k)),
  r AS (SELECT event_type, g, a, b, c, n, seasonal, m, m - 1 AS pos, level, CASE WHEN n >= 2 * m THEN (later - level) / m ELSE 0 END AS trend,
      list_transform(head, lambda v: CASE WHEN seasonal THEN v - level ELSE 0 END) AS season, 0::DOUBLE AS sse FROM i, g WHERE n > m
    UNION ALL
    SELECT event_type, g, a, b, c, n, seasonal, m, pos, up, b * (up - level) + (1 - b) * trend,
      CASE WHEN seasonal THEN list_transform(season, lambda v, j: CASE WHEN j = k THEN c * (y - up) + (1 - c) * v ELSE v END) ELSE season END, sse + pow(y - level - trend - season[k], 2)
    FROM (SELECT r.*  EXCLUDE (pos), s.pos, s.y, s.pos % m + 1 AS k, a * (s.y - season[s.pos % m + 1]) + (1 - a) * (level + trend) AS up FROM r JOIN s ON s.event_type = r.event_type AND s.pos = r.pos + 1)),
  e AS (SELECT event_type, m, n, z.l AS l, z.t AS t, z.s AS s, z.sse AS sse FROM (SELECT event_type, m, n, arg_min({{l: level, t: trend, s: season, sse: sse}}, (sse, g)) AS z FROM r WHERE pos = n - 1 GROUP BY ALL)),
  w AS (SELECT event_type, max(time) AS last FROM s GROUP BY 1), q AS (SELECT event_type, median(d) AS gap FROM (SELECT event_type, date_diff('second', lag(time) OVER (PARTITION BY event_type ORDER BY pos), time) AS d FROM s) GROUP BY 1),
  f AS (SELECT event_type, step, strftime(last + to_seconds(CAST(step * gap AS BIGINT)), '%Y-%m-%d') AS time, l + step * t + s[(n + step - 1) % m + 1] AS forecast, 1.96 * sqrt(sse / (n - m)) AS edge
    FROM e JOIN w USING (event_type) JOIN q USING (event_type), (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS step))
  SELECT event_type, step, time, forecast, forecast - edge AS lower, forecast + edge AS upper FROM f"""


@query("forecast_holt_winters", HOLT_WINTERS, approx=("forecast", "lower", "upper"))
def _(t):
    return day(M.forecast_holt_winters(ev(t), ["event_type"], 7, 7))


@query("forecast_arima")
def _(t):
    return M.forecast_arima(od(t), [], 10, 7)


@query("forecast_lag_model")
def _(t):
    return M.forecast_lag_model(od(t), [], 10, 7)


@query("forecast_lag_model_series")
def _(t):
    return M.forecast_lag_model(ev(t), ["event_type"], 5, 3)


# simple smoothing up to each cutoff, its level held for the horizon
@query(
    "backtest_ses",
    f"""WITH s AS (SELECT * FROM {EV} x), l AS (SELECT event_type, pos, n_rows, list_reduce(list(y) OVER (PARTITION BY event_type ORDER BY pos), lambda a, v: 0.3 * v + 0.7 * a) AS f FROM s),
        c AS (SELECT event_type, pos AS cutoff, f FROM l WHERE pos >= 9 AND (pos - 9) % 4 = 0 AND pos < n_rows - 1)
        SELECT event_type, cutoff, count(*) AS n, avg(abs(y - f)) AS mae, sqrt(avg(pow(y - f, 2))) AS rmse, avg(abs(y - f) / greatest(abs(y), 1e-8)) * 100 AS mape,
          CAST(NULL AS DOUBLE) AS coverage FROM c JOIN s USING (event_type) WHERE pos > cutoff AND pos <= cutoff + 5 GROUP BY 1, 2""",
    approx=("mae", "rmse", "mape"),
)
def _(t):
    return M.backtest(ev(t), ["event_type"], S.forecast_ses, 10, 4, 5)


@query(
    "backtest_drift",
    f"""WITH s AS (SELECT * FROM {EV} x), l AS (SELECT event_type, pos AS cutoff, y AS last, first_value(y) OVER (PARTITION BY event_type ORDER BY pos) AS first, n_rows FROM s),
        c AS (SELECT * FROM l WHERE cutoff >= 9 AND (cutoff - 9) % 4 = 0 AND cutoff < n_rows - 1),
        e AS (SELECT event_type, cutoff, y, last + (pos - cutoff) * (last - first) / cutoff AS f FROM c JOIN s USING (event_type) WHERE pos > cutoff AND pos <= cutoff + 5)
        SELECT event_type, cutoff, count(*) AS n, avg(abs(y - f)) AS mae, sqrt(avg(pow(y - f, 2))) AS rmse, avg(abs(y - f) / greatest(abs(y), 1e-8)) * 100 AS mape,
          CAST(NULL AS DOUBLE) AS coverage FROM e GROUP BY 1, 2""",
    approx=("mae", "rmse", "mape"),
)
def _(t):
    return M.backtest(ev(t), ["event_type"], S.forecast_drift, 10, 4, 5)


@query("backtest_holt_winters")
def _(t):
    return M.backtest(ev(t), ["event_type"], lambda s, keys, periods: M.forecast_holt_winters(s, keys, periods, 7), 14, 4, 5)


@query("backtest_arima")
def _(t):
    return M.backtest(ev(t), ["event_type"], M.forecast_arima, 14, 4, 5)


@query("stationarity")
def _(t):
    return M.stationarity(od(t), [])


@query(
    "kpss",
    f"""WITH e AS (SELECT pos, n_rows, y - avg(y) OVER () AS e FROM {OD} x), r AS (SELECT *, sum(e) OVER (ORDER BY pos) AS s FROM e),
        b AS (SELECT sum(s * s) AS eta, count(*) AS n, sum(e * e) AS g0 FROM r),
        l AS (SELECT sum((1 - lag / 6.0) * a.e * c.e) AS gl FROM (SELECT unnest(range(1, 6)) AS lag) k, e a JOIN e c ON c.pos = a.pos - lag),
        k AS (SELECT eta / (CAST(n AS DOUBLE) * n) / ((g0 + 2 * gl) / n) AS statistic, n FROM b, l)
        SELECT *, CAST(0.739 AS DOUBLE) AS critical_1, CAST(0.463 AS DOUBLE) AS critical_5, CAST(0.347 AS DOUBLE) AS critical_10, statistic < 0.463 AS stationary FROM k""",
    approx=("statistic",),
)
def _(t):
    return M.kpss(od(t), [])
