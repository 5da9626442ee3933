"""Fitted models, neighbours and streams on small synthetic inputs."""

import datetime

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from lodestat.operators import correlate as R
from lodestat.operators import forecast as M
from lodestat.operators import forest as T
from lodestat.operators import neighbors as N
from lodestat.operators import series as S
from lodestat.streaming import streams as W


def series(spark, y):
    pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=len(y)), "y": y})
    return S.prepare_series(spark.createDataFrame(pdf), "t", "y")


def test_holt_winters_follows_trend_and_season(spark):
    i = np.arange(140)
    y = 100 + 0.5 * i + 10 * np.sin(2 * np.pi * i / 7)
    for chunk in (65536, 60):
        got = M.forecast_holt_winters(series(spark, y), [], 7, 7, chunk=chunk).orderBy("step").toPandas()["forecast"]
        j = np.arange(140, 147)
        assert np.abs(got - (100 + 0.5 * j + 10 * np.sin(2 * np.pi * j / 7))).max() < 1.5


def test_arima_recovers_autoregression(spark):
    rng = np.random.default_rng(42)
    y = np.zeros(1500)
    for i in range(1, 1500):
        y[i] = 0.8 * y[i - 1] + rng.normal()
    got = M.forecast_arima(series(spark, y + 50), [], 5).orderBy("step").toPandas()
    assert got["difference"].iloc[0] == 0
    assert got["forecast"].iloc[0] - 50 == pytest.approx(0.8 * y[-1], abs=0.35)
    assert got["upper"].iloc[0] - got["forecast"].iloc[0] == pytest.approx(1.96, rel=0.1)


def test_adf_statistic_equals_least_squares(spark):
    y = np.cumsum(np.random.default_rng(5).normal(size=300))
    got = M.adf(series(spark, y), [], 4).first()
    k, d = got["lags"], np.diff(y)
    t = np.arange(5, 300)
    x = np.column_stack([np.ones(len(t)), y[t - 1], *[d[t - 1 - i] for i in range(1, k + 1)]])
    coef, *_ = np.linalg.lstsq(x, d[t - 1], rcond=None)
    e = d[t - 1] - x @ coef
    se = np.sqrt(e @ e / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert got["statistic"] == pytest.approx(coef[1] / se, rel=1e-6)
    assert not got["stationary"]
    assert M.adf(series(spark, np.random.default_rng(6).normal(size=300)), [], 4).first()["stationary"]


def test_lag_model_extends_a_line(spark):
    got = M.forecast_lag_model(series(spark, 3.0 + 2.0 * np.arange(60)), [], 5, 4).orderBy("step").toPandas()["forecast"]
    assert np.allclose(got, 3.0 + 2.0 * np.arange(60, 65), rtol=0.01)


def test_isolation_forest_finds_the_far_point_on_any_partitioning(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(600), "x": rng.normal(size=600), "y": rng.normal(size=600)})
    pdf.loc[17, ["x", "y"]] = [9.0, -9.0]
    a, b = (T.isolation_forest(spark.createDataFrame(pdf).repartition(n), "id", ["x", "y"], 30, 0.01).toPandas().set_index("id").sort_index() for n in (1, 7))
    assert a["score"].idxmax() == 17 and bool(a.loc[17, "is_outlier"])
    assert np.allclose(a["score"], b["score"])


@pytest.mark.parametrize("block", [16, 2048])
def test_knn_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((300, 1)) < 0.34, 0.5, rng.normal(size=(300, 3)))  # a third of the points coincide
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    v = N.vectors(df, "id", ["a", "b", "c"])
    got = N.knn_join(v, v, 4, exclude_same=True, block=block).toPandas().sort_values(["query", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = [i for q in range(300) for i in np.lexsort((np.arange(300), np.round(d[q], 12)))[:4]]
    assert got["id"].tolist() == want


def test_dbscan_equals_brute_force_in_small_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.2, (80, 2)), rng.normal(3, 0.2, (80, 2)), rng.uniform(-2, 5, (30, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(190), "a": x[:, 0], "b": x[:, 1]}))
    got = N.dbscan(df, "id", ["a", "b"], 0.3, 5, standardize=False, block=20).toPandas().set_index("id").sort_index()
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.3
    core = near.sum(axis=1) >= 5
    label = np.where(core, np.arange(190), -1)
    while True:
        new = np.array([min([label[j] for j in np.nonzero(near[i] & core)[0]]) if core[i] else -1 for i in range(190)])
        if (new == label).all():
            break
        label = new
    for i in np.nonzero(~core)[0]:
        hit = np.nonzero(near[i] & core)[0]
        label[i] = label[hit].min() if len(hit) else -1
    assert got["cluster"].tolist() == label.tolist() and got["is_core"].tolist() == core.tolist()


def test_drift_gap_matches_ks_of_two_samples():
    a, b = np.array([1.0, 2, 3, 4]), np.array([3.0, 4, 5, 6])
    assert W.ks_gap(a, b)[0] == 0.5


def test_online_model_improves(spark):
    rng = np.random.default_rng(7)
    model = W.OnlineLinear(["x"], "y")
    for i in range(6):
        x = rng.normal(size=200)
        model.partial_fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": (x > 0).astype(int)})), i)
    assert model.scores[-1] > 0.95
    assert model.predict(spark.createDataFrame([(2.0,)], "x double")).first()["prediction"] == 1


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.integers(0, 20, 500), "b": rng.integers(0, 20, 500)}))
    one, many = (R.corr_kendall(d, ["a", "b"]).first()["r"] for d in (df.coalesce(1), df.repartition(7)))
    assert one == pytest.approx(many)


def test_text_classifier_entry_has_the_operators_defaults(spark, monkeypatch):
    from lodestat import plans
    from lodestat.operators import similarity

    seen = []
    monkeypatch.setattr(similarity, "text_classifier", lambda *args, **kwargs: seen.append((len(args), kwargs)))
    plans.QUERIES["text_classifier"](spark, "/root/testdata/sf0.001")
    assert seen == [(5, {})]


def brute_holt_winters(y, period, periods):
    from itertools import product

    n = len(y)
    seasonal = n >= 24
    m = min(period, n // 2) if seasonal else min(2, max(1, n // 2))
    best = None
    for g, (a, b, c) in enumerate(product([0.1, 0.3, 0.5, 0.8], [0.01, 0.1, 0.3], [0.05, 0.2, 0.5])):
        level, trend = y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m if n >= 2 * m else 0.0
        season, sse = (list(y[:m] - level) if seasonal else [0.0] * m), 0.0
        for i in range(m, n):
            k = i % m
            sse += (y[i] - level - trend - season[k]) ** 2
            old, level = level, a * (y[i] - season[k]) + (1 - a) * (level + trend)
            trend = b * (level - old) + (1 - b) * trend
            season[k] = c * (y[i] - level) + (1 - c) * season[k] if seasonal else 0.0
        if best is None or sse < best[0]:
            best = (sse, level, trend, season)
    sse, level, trend, season = best
    f = np.array([level + h * trend + season[(n + h - 1) % m] for h in range(1, periods + 1)])
    return f, 1.96 * np.sqrt(sse / (n - m))


@pytest.mark.parametrize("chunk", [100, 1000, 65536])
def test_holt_winters_does_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(8)
    i = np.arange(2357)
    y = 50 + 0.01 * i + 9 * np.sin(2 * np.pi * i / 12) + np.cumsum(rng.normal(size=len(i))) * 0.3
    got = M.forecast_holt_winters(series(spark, y), [], 6, 12, chunk=chunk).orderBy("step").toPandas()
    f, edge = brute_holt_winters(y, 12, 6)
    assert np.allclose(got["forecast"], f, rtol=1e-9) and np.allclose(got["upper"] - got["forecast"], edge, rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 23, 24])
def test_holt_winters_of_short_series(spark, n):
    y = np.random.default_rng(n).normal(size=n) + 5
    got = M.forecast_holt_winters(series(spark, y), [], 3, 12).orderBy("step").toPandas()
    if n == 1:
        assert got.empty
    else:
        assert np.allclose(got["forecast"], brute_holt_winters(y, 12, 3)[0])


@pytest.mark.parametrize("alpha, chunk", [(0.3, 100), (0.3, 65536), (0.001, 100), (0.95, 65536), (1.0, 10)])
def test_smooth_does_not_depend_on_chunks(spark, alpha, chunk):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 5000), "y": rng.normal(size=5000) * 1e3})
    pdf["k"] = pdf["k"].where(pdf["k"] < 2)
    pdf["t"] = pd.date_range("2024-01-01", periods=5000, freq="h")
    s = S.prepare_series(spark.createDataFrame(pdf.astype({"k": object}).where(pdf.notna(), None), "k double, y double, t timestamp_ntz"), "t", "y", ["k"])
    got = S.smooth(s, ["k"], alpha, chunk=chunk).toPandas()
    assert set(got.columns) == {"k", "time", "y", "pos", "n_rows", "smoothed"}
    for k, g in got.groupby("k", dropna=False):
        level, want = None, []
        for v in g.sort_values("pos")["y"]:
            level = v if level is None else alpha * v + (1 - alpha) * level
            want.append(level)
        assert np.allclose(g.sort_values("pos")["smoothed"], want, rtol=1e-9, atol=1e-9)


def seasonal_walk(n, seed=11, ar=0.5, ma=0.4, sma=-0.6, m=12):
    """(1, 1, 1)(0, 1, 1)m with unit innovations; the differenced part, the series and the innovations."""
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 200)
    w = np.zeros(n + 200)
    for i in range(m + 1, n + 200):
        w[i] = ar * w[i - 1] + e[i] + ma * e[i - 1] + sma * e[i - m] + ma * sma * e[i - m - 1]
    y = np.zeros(n + 200)
    for i in range(m + 1, n + 200):
        y[i] = w[i] + y[i - 1] + y[i - m] - y[i - m - 1]
    return y[200:], w[200:], e[200:]


@pytest.mark.parametrize("chunk", [400, 65536])
def test_arima_recovers_a_seasonal_model(spark, chunk):
    y, w, e = seasonal_walk(3000)
    got = M.forecast_arima(series(spark, y), [], 24, 12, chunk=chunk).orderBy("step").toPandas()
    r = got.iloc[0]
    assert (r["difference"], r["seasonal_difference"]) == (1, 1)
    assert r["seasonal_ma"] >= 1 and r["ar_order"] + r["ma_order"] >= 1
    nxt = 0.5 * w[-1] + 0.4 * e[-1] - 0.6 * e[-12] - 0.24 * e[-13] + y[-1] + y[-12] - y[-13]
    assert r["forecast"] == pytest.approx(nxt, abs=0.35)
    assert r["upper"] - r["forecast"] == pytest.approx(1.96, rel=0.08)
    assert (np.diff(got["upper"] - got["lower"]) > 0).all()
    again = M.forecast_arima(series(spark, y), [], 24, 12).orderBy("step").toPandas()
    assert np.allclose(got["forecast"], again["forecast"], rtol=1e-6)


def test_arima_of_short_constant_and_many_series(spark):
    rng = np.random.default_rng(12)
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), float(v)) for k, y in (("flat", np.full(30, 7.0)), ("one", [3.0]), ("few", [1.0, 2.0, 4.0]), ("line", np.arange(60.0) + rng.normal(size=60) * 0.1), (None, rng.normal(size=80))) for i, v in enumerate(y)]
    s = S.prepare_series(spark.createDataFrame(rows, "k string, t timestamp_ntz, y double"), "t", "y", ["k"])
    got = M.forecast_arima(s, ["k"], 3, 7).toPandas()
    assert got.groupby("k", dropna=False).size().tolist() == [3] * 5
    by = {k: g.sort_values("step")["forecast"].to_numpy() for k, g in got.fillna({"k": "none"}).groupby("k")}
    assert np.allclose(by["flat"], 7) and np.allclose(by["one"], 3) and np.allclose(by["few"], 7 / 3)
    assert np.allclose(by["line"], [60, 61, 62], atol=0.6)
    assert np.abs(by["none"]).max() < 1.5
    assert M.forecast_arima(s.limit(0), ["k"], 3, 7).count() == 0


def test_arima_takes_a_second_difference(spark):
    y = np.cumsum(np.cumsum(np.random.default_rng(13).normal(size=800)))
    got = M.forecast_arima(series(spark, y), [], 3).orderBy("step").toPandas()
    assert got["difference"].iloc[0] == 2
    assert got["forecast"].iloc[0] == pytest.approx(2 * y[-1] - y[-2], abs=1.0)


@pytest.mark.parametrize("block", [2048, 40])
def test_nearest_neighbours_over_a_tree_equal_brute_force(spark, block):
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=(500, 3)), np.zeros((150, 3)), rng.normal(size=(100, 3)) * 0.01 + 5])  # clusters and equal points
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": list(x)}))
    got = N.knn_join(df, df, 5, exclude_same=True, block=block).toPandas().sort_values(["query", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), np.round(d, 12)), axis=1)[:, :5]
    assert (got["id"].to_numpy().reshape(-1, 5) == want).all()
    if block < 100:
        tree = N.Tree(df, block)
        assert len(tree.levels) > 1 and tree.points.count() == len(x)
        sent = tree.route(df.withColumn("bound", F.lit(0.2)), None)
        assert sent.count() < 0.5 * len(x) * tree.points.select("cell").distinct().count()


def brute_ward(x, k):
    """Merges the two clusters that raise the squared error least, until k are left."""
    groups = [[i] for i in range(len(x))]

    def cost(a, b):
        return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()

    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def test_ward_equals_brute_force_and_scales_by_leaves(spark):
    from lodestat.operators import ward

    rng = np.random.default_rng(31)
    x = np.concatenate([rng.normal(size=(12, 2)) + c for c in ((0, 0), (4, 0), (0, 5), (9, 9))])
    x[1] = x[0]  # equal points
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    for k in (1, 3, 4, 7):
        got = ward.hierarchical(df, ["a", "b"], k, standardize=False).toPandas()
        assert {frozenset(g) for g in got.groupby("cluster")["id"].apply(list)} == brute_ward(x, k)
    assert ward.hierarchical(df.limit(0), ["a", "b"], 3).count() == 0
    big = np.concatenate([rng.normal(size=(1500, 2)) * 0.5 + c for c in ((0, 0), (8, 0), (0, 8))])
    pdf = pd.DataFrame({"a": big[:, 0], "b": big[:, 1], "true": np.repeat([0, 1, 2], 1500)})
    got = ward.hierarchical(spark.createDataFrame(pdf), ["a", "b"], 3, leaves=200).toPandas()
    assert len(got) == 4500 and got.groupby("cluster")["true"].nunique().tolist() == [1, 1, 1]


def test_lag_model_is_one_per_series(spark):
    rng = np.random.default_rng(41)
    a, b = np.zeros(400), np.full(50, 3.0)
    for i in range(2, 400):
        a[i] = 0.5 * a[i - 1] - 0.7 * a[i - 2] + rng.normal()
    a += 1e4
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), float(v)) for k, y in (("a", a), ("b", b), (None, [1.0, 2.0])) for i, v in enumerate(y)]
    s = S.prepare_series(spark.createDataFrame(rows, "k string, t timestamp_ntz, y double"), "t", "y", ["k"])
    got = M.forecast_lag_model(s, ["k"], 4, 3).toPandas().sort_values(["k", "step"])
    x = np.column_stack([np.ones(397), a[2:-1], a[1:-2], a[:-3]])
    coef = np.linalg.lstsq(x, a[3:], rcond=None)[0]
    w, want = list(a[-1:-4:-1]), []
    for _ in range(4):
        w = [coef[0] + np.dot(coef[1:], w), *w[:-1]]
        want.append(w[0])
    assert np.allclose(got[got["k"] == "a"]["forecast"], want, rtol=1e-7)
    assert np.allclose(got[got["k"] == "b"]["forecast"], 3.0) and len(got) == 8


def test_backtest_refits_at_every_cutoff(spark):
    y = np.cumsum(np.random.default_rng(42).normal(size=60)) + 20
    s = series(spark, y)
    got = M.backtest(s, [], lambda s_, k, p: M.forecast_holt_winters(s_, k, p, 6), 30, 10, 8).orderBy("cutoff").collect()
    assert [(r["cutoff"], r["n"]) for r in got] == [(29, 8), (39, 8), (49, 8)]
    for r in got:
        f, edge = brute_holt_winters(y[: r["cutoff"] + 1], 6, 8)
        e = y[r["cutoff"] + 1 : r["cutoff"] + 9] - f
        assert r["mae"] == pytest.approx(np.abs(e).mean()) and r["coverage"] == pytest.approx((np.abs(e) <= edge).mean())
    line = M.backtest(s, [], S.forecast_linear, 30, 10, 8).orderBy("cutoff").collect()
    known = S.backtest_linear(s, [], 30, 10, 8).orderBy("cutoff").collect()
    assert [r["rmse"] for r in line] == pytest.approx([r["rmse"] for r in known])
