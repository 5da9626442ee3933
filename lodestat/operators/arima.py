"""Seasonal ARIMA from lagged cross-products.

A series is differenced as its autocorrelations ask, a long autoregression gives the innovations, and every order is then fitted from one
matrix of cross-products of lagged values and lagged innovations (Hannan and Rissanen). The seasonal and the plain lag polynomials
are multiplied, so coefficients of the product are products of parameters: least squares by Gauss-Newton steps on the matrix alone. Long
series are many chunks whose cross-products add up; only the matrix and the last rows of a series meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import ordering as O
from lodestat.operators.smoothing import chunk_arrays, keyed, spec
from lodestat.session import stored

MAX_P, MAX_D, MAX_Q, MAX_SEASONAL = 5, 2, 5, 2  # fixed values: largest orders
ADF_5 = -2.86  # fixed value: critical value of the unit-root test with a constant, 5 per cent
LONG_SEASONS, LONG_NEAR = 5, 8  # the long autoregression looks back so many seasons and so many rows around each


def lag_set(n: int, m: int, seasons: int, near: int) -> list[int]:
    """Lags 1..near and km..km + near for a season of m > 1 rows, as a series of n rows allows."""
    lags = {j for j in range(1, near + 1)} | ({k * m + j for k in range(1, seasons + 1) for j in range(near + 1)} if m > 1 else set())
    lags = sorted(x for x in lags if 0 < x <= n // 4)
    return lags[: max(1, n // 5)]


def season_for(n: int, period: int) -> int:
    """The season of a series, 1 if it is too short to show three of them."""
    return period if period > 1 and n >= 3 * period + 12 else 1


def difference(y: np.ndarray, d: int, seasonal: int, m: int) -> np.ndarray:
    """``d`` plain and ``seasonal`` seasonal differences, shorter by d + seasonal * m."""
    for _ in range(seasonal):
        y = y[m:] - y[:-m] if len(y) > m else y[:0]
    for _ in range(d):
        y = np.diff(y)
    return y


def lagged(w: np.ndarray, at: np.ndarray, lags: list[int]) -> np.ndarray:
    return w[at[:, None] - np.array(lags, dtype=int)[None, :]]


def reach(period: int) -> int:
    """Rows before a chunk that its cross-products may look at."""
    m = max(period, 1)
    return LONG_SEASONS * m + LONG_NEAR + MAX_SEASONAL * m + MAX_P + MAX_D + m


CHOICES = [(d, s) for s in (0, 1) for d in range(MAX_D + 1)]


def chunk_grams(y: np.ndarray, own_from: int, n: int, mean: float, scale: float, m: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Cross-products of (1, lags, value) for each way of differencing; rows before ``own_from`` belong to the chunk before."""
    lags = lag_set(n, m, LONG_SEASONS, LONG_NEAR)
    z = (y - mean) / scale
    for d, s in CHOICES:
        if s and m == 1:
            continue
        lost = d + s * m
        w = difference(z, d, s, m)
        at = np.arange(max(max(lags), own_from - lost), len(w))
        if len(at):
            v = np.column_stack([np.ones(len(at)), lagged(w, at, lags), w[at]])
            yield d, s, v.T @ v


def solve(g: np.ndarray, xs: list[int]) -> tuple[np.ndarray, float]:
    coef = np.linalg.lstsq(g[np.ix_(xs, xs)], g[xs, -1], rcond=None)[0]
    return coef, float(max(g[-1, -1] - coef @ g[xs, -1], 1e-300))


def autocorrelation(g: np.ndarray, lags: list[int], lag: int) -> float:
    n, i = g[0, 0], 1 + lags.index(lag)
    covariance = g[i, -1] / n - g[0, i] * g[0, -1] / n**2
    spread = (g[-1, -1] / n - (g[0, -1] / n) ** 2) * (g[i, i] / n - (g[0, i] / n) ** 2)
    return float(covariance / np.sqrt(spread)) if spread > 0 else 0.0


def unit_root(g: np.ndarray, lags: list[int]) -> bool:
    """Whether a Dickey-Fuller regression with all differences that the lags hold, seasonal ones too, leaves a unit root possible."""
    place = {lag: 1 + i for i, lag in enumerate(lags)}
    pairs = [j for j in lags if j + 1 in place]
    size, k = len(lags) + 2, len(pairs)
    # difference on (1, value before, differences before) is a linear change of the same columns
    t = np.zeros((size, k + 3))
    t[0, 0] = t[place[1], 1] = t[-1, -1] = 1
    t[place[1], -1] = -1
    for i, j in enumerate(pairs):
        t[place[j], 2 + i], t[place[j + 1], 2 + i] = 1, -1
    h = t.T @ g @ t
    xs = list(range(k + 2))
    coef, sse = solve(h, xs)
    free = h[0, 0] - len(xs)
    if free < 2:
        return False
    se = np.sqrt(sse / free * max(np.linalg.pinv(h[np.ix_(xs, xs)])[1, 1], 0.0))
    return bool(se > 0 and coef[1] / se > ADF_5)


def choose_differences(grams: dict[tuple[int, int], np.ndarray], n: int, m: int) -> tuple[int, int]:
    """Seasonal difference if the autocorrelations at the season's lags don't die out, then plain ones until no unit root is left."""
    lags = lag_set(n, m, LONG_SEASONS, LONG_NEAR)
    s = 0
    if m > 1 and 3 * m in lags and (1, 0) in grams:
        first, third = (autocorrelation(grams[1, 0], lags, k * m) for k in (1, 3))
        s = int(first > 3 / np.sqrt(n) and third > 0.5 * first)
    for d in range(MAX_D + 1):
        if (d, s) in grams and (d == MAX_D or not unit_root(grams[d, s], lags)):
            return d, s
    return min(grams)


# ---- orders ------------------------------------------------------------------


class Orders:
    """Places of lagged values and innovations in a vector (1, values, innovations, value), and products of lag polynomials there."""

    def __init__(self, n: int, m: int):
        self.m = m
        self.lags = lag_set(n, m, MAX_SEASONAL, MAX_P)
        self.size = 2 * len(self.lags) + 2
        self.place = {lag: i for i, lag in enumerate(self.lags)}

    def fits(self, p: int, q: int, sp: int, sq: int) -> bool:
        return all(self._needs(a, b) for a, b in ((p, sp), (q, sq)))

    def _needs(self, a: int, b: int) -> bool:
        return all(k * self.m + i in self.place for k in range(b + 1) for i in range(a + 1) if k or i)

    def polynomial(self, plain: np.ndarray, seasonal: np.ndarray, sign: float) -> dict[int, float]:
        """Coefficients of (1 + sign * plain)(1 + sign * seasonal) by lag, without the leading one."""
        out: dict[int, float] = {}
        for k, b in enumerate([1.0, *(sign * seasonal)]):
            for i, a in enumerate([1.0, *(sign * plain)]):
                if i or k:
                    out[k * self.m + i] = out.get(k * self.m + i, 0.0) + a * b
        return out

    def residual(self, x: np.ndarray, order: tuple[int, int, int, int], constant: bool) -> tuple[np.ndarray, np.ndarray]:
        """The innovation as a vector over the matrix' columns, and its derivative by the parameters ``(c, ar, seasonal ar, ma, seasonal ma)``."""
        p, q, sp, sq = order
        c, rest = x[0], x[1:]
        ar, sar, ma, sma = np.split(rest, np.cumsum([p, sp, q]))
        v, jac = np.zeros(self.size), np.zeros((self.size, len(x)))
        v[-1], v[0], jac[0, 0] = 1.0, -c, -float(constant)
        half = len(self.lags)
        for offset, plain, seasonal, sign, lead, first in ((1, ar, sar, -1.0, 1.0, 1), (1 + half, ma, sma, 1.0, -1.0, 1 + p + sp)):
            for lag, value in self.polynomial(plain, seasonal, sign).items():
                v[offset + self.place[lag]] += lead * value
            for i in range(len(plain)):
                for k, b in enumerate([1.0, *(sign * seasonal)]):
                    jac[offset + self.place[k * self.m + i + 1], first + i] += lead * sign * b
            for k in range(len(seasonal)):
                for i, a in enumerate([1.0, *(sign * plain)]):
                    jac[offset + self.place[(k + 1) * self.m + i], first + len(plain) + k] += lead * sign * a
        return v, jac

    def fit(self, g: np.ndarray, order: tuple[int, int, int, int], constant: bool) -> tuple[np.ndarray, float]:
        """Parameters and squared error by damped Gauss-Newton steps on the cross-products."""
        x, damping = np.zeros(1 + sum(order)), 1e-3
        v, jac = self.residual(x, order, constant)
        sse = float(v @ g @ v)
        for _ in range(60):
            h, slope = jac.T @ g @ jac, jac.T @ g @ v
            step = np.linalg.lstsq(h + damping * np.diag(np.diag(h)) + 1e-12 * np.eye(len(x)), -slope, rcond=None)[0]
            tried = x + step
            v2, jac2 = self.residual(tried, order, constant)
            sse2 = float(v2 @ g @ v2)
            if sse2 < sse:
                done = sse - sse2 < 1e-10 * sse
                x, v, jac, sse, damping = tried, v2, jac2, sse2, damping / 5
                if done:
                    break
            else:
                damping *= 10
                if damping > 1e8:
                    break
        return x, max(sse, 1e-300)


def stable(coefficients: dict[int, float]) -> bool:
    """Whether the roots of 1 + sum of coefficients lie outside the unit circle."""
    if not coefficients:
        return True
    poly = np.zeros(max(coefficients) + 1)
    poly[0] = 1.0
    for lag, value in coefficients.items():
        poly[lag] = value
    poly = np.trim_zeros(poly, "b")
    return len(poly) < 2 or bool(np.abs(np.roots(poly[::-1])).min() > 1.001)


def search_orders(g: np.ndarray, places: Orders, d: int, s: int) -> tuple[tuple[int, int, int, int], np.ndarray, float, float]:
    """Stepwise search by AICc from four starts, one order up or down at a time."""
    n, constant = g[0, 0], d + s < 2

    @cache
    def rate(order: tuple[int, int, int, int]):
        k = sum(order) + 1 + constant
        if not places.fits(*order) or n - k - 1 <= 0:
            return None
        x, sse = places.fit(g, order, constant)
        ar, sar, ma, sma = np.split(x[1:], np.cumsum([order[0], order[2], order[1]]))
        if not (stable(places.polynomial(ar, sar, -1.0)) and stable(places.polynomial(ma, sma, 1.0))):
            return None
        return n * np.log(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1), x, sse

    many = places.m > 1
    starts = [(2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)] if many else [(2, 2, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0)]
    most = (MAX_P, MAX_Q, MAX_SEASONAL * many, MAX_SEASONAL * many)
    best = min((o for o in starts if rate(o)), key=lambda o: rate(o)[0], default=(0, 0, 0, 0))
    while rate(best):
        moves = [tuple(b + (a == i) * e for a, b in enumerate(best)) for i in range(4) for e in (1, -1)]
        moves += [tuple(b + (a in pair) * e for a, b in enumerate(best)) for pair in ((0, 1), (2, 3)) for e in (1, -1)]
        moves = [o for o in moves if all(0 <= x <= t for x, t in zip(o, most)) and rate(o)]
        better = min(moves, key=lambda o: rate(o)[0], default=best)
        if rate(better)[0] >= rate(best)[0] - 1e-9:
            break
        best = better
    score = rate(best)
    if score is None:  # a handful of rows: the mean alone
        return best, np.array([g[0, -1] / n if constant else 0.0]), float(max(g[-1, -1], 1e-300)), float("nan")
    return best, score[1], score[2], score[0]


def forecast(y: np.ndarray, e: np.ndarray, places: Orders, order: tuple[int, int, int, int], x: np.ndarray, d: int, s: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Values ahead from the last values and innovations, and the summed squared weights of the innovations."""
    p, q, sp, sq = order
    ar, sar, ma, sma = np.split(x[1:], np.cumsum([p, sp, q]))
    poly = np.array([1.0])
    for plus in [*[{1: -1.0}] * d, *[{places.m: -1.0}] * s, places.polynomial(ar, sar, -1.0)]:
        other = np.zeros(max(plus, default=0) + 1)
        other[0] = 1.0
        for lag, value in plus.items():
            other[lag] = value
        poly = np.convolve(poly, other)
    theta = places.polynomial(ma, sma, 1.0)
    values, shocks = list(y), list(e)
    psi = np.zeros(periods)
    for h in range(periods):
        back = min(len(poly) - 1, len(values))
        nxt = x[0] - sum(poly[j] * values[-j] for j in range(1, back + 1)) + sum(v * shocks[-lag] for lag, v in theta.items() if lag <= len(shocks))
        values.append(nxt)
        shocks.append(0.0)
        psi[h] = 1.0 if h == 0 else theta.get(h, 0.0) - sum(poly[j] * psi[h - j] for j in range(1, min(h, len(poly) - 1) + 1))
    return np.array(values[-periods:]), np.cumsum(psi**2)


# ---- Spark -------------------------------------------------------------------


def _rows(made: list[tuple], by: list[str], head: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Records ``(row number in head, values...)`` with the keys of that row."""
    out = pd.DataFrame([m[1:] for m in made], columns=names)
    for k in by:
        out[k] = head[k].take([m[0] for m in made]).to_numpy()
    return out[[*by, *names]]


def forecast_arima(s: DataFrame, keys: list[str], periods: int = 10, period: int = 1, chunk: int = O.CHUNK) -> DataFrame:
    """``keys..., step, forecast, lower, upper`` and the model ``ar_order, difference, ma_order, seasonal_ar, seasonal_difference,
    seasonal_ma, aicc`` per series.

    ``period`` is the season's length in rows, 1 for none; a series shorter than three seasons and twelve rows is fitted without one.
    Orders go up to 5, 2, 5 and 2, 1, 2, searched step by step by AICc. A constant is part of models with less than two differences.
    A constant series keeps its value, one of fewer than eight rows its mean.
    """
    s, by, single = keyed(s, keys)
    stats = s.groupBy(*by).agg(F.avg("y").alias("mean"), F.coalesce(F.stddev_pop("y"), F.lit(0.0)).alias("scale"))
    chunks = chunk_arrays(s, by, max(chunk, reach(period) + 1), reach(period))
    chunks = stored(O.join_small(chunks, stats, by, bounded=single))
    size = max(chunk, reach(period) + 1)

    def each(batch: pd.DataFrame) -> Iterator[tuple]:
        for i, (first, part, n, y, mean, scale) in enumerate(zip(batch["first"], batch["_chunk"], batch["n_rows"], batch["y"], batch["mean"], batch["scale"])):
            yield i, int(first), int(part) * size - int(first), int(n), np.asarray(y, float), mean, scale

    def sums(made: DataFrame) -> DataFrame:
        return made.groupBy(*by, "d", "s", "i", "j").agg(F.sum("v").alias("v"), F.max("n").alias("n")).groupBy(*by)

    cells = "d int, s int, i int, j int, v double, n long"

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for i, _, own, n, y, mean, scale in each(batch):
                if scale > 0 and n >= 8:
                    for d, se, g in chunk_grams(y, own, n, mean, scale, season_for(n, period)):
                        a, b = np.triu_indices(len(g))
                        made += [(i, d, se, int(x), int(z), float(g[x, z]), n) for x, z in zip(a, b)]
            yield _rows(made, by, batch, ["d", "s", "i", "j", "v", "n"])

    def square(pdf: pd.DataFrame) -> np.ndarray:
        k = int(pdf["j"].max()) + 1
        g = np.zeros((k, k))
        g[pdf["i"], pdf["j"]] = pdf["v"]
        return np.triu(g) + np.triu(g, 1).T

    def long_model(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        grams = {(int(d), int(se)): square(g) for (d, se), g in pdf.groupby(["d", "s"])}
        d, se = choose_differences(grams, n, season_for(n, period))
        coef, _ = solve(grams[d, se], list(range(len(grams[d, se]) - 1)))
        return pdf[by].iloc[:1].assign(d=d, s=se, long=[coef.tolist()])

    first = sums(chunks.mapInPandas(products, spec(s, by, cells)))
    long = first.applyInPandas(long_model, spec(s, by, "d int, s int, long array<double>"))
    ready = O.join_small(chunks, stored(long), by, bounded=single)

    def innovations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cross-products of values and innovations; the last chunk also hands on the series' end, as numbers of matrix -1."""
        for batch in batches:
            made = []
            for (i, first_, own, n, y, mean, scale), d, se, coef in zip(each(batch), batch["d"], batch["s"], batch["long"]):
                m = season_for(n, period)
                lost, lags, places = int(d + se * m), lag_set(n, m, LONG_SEASONS, LONG_NEAR), Orders(n, m)
                z = (y - mean) / scale
                w = difference(z, int(d), int(se), m)
                e, begin = np.zeros(len(w)), max(lags)
                at = np.arange(begin, len(w))
                e[at] = w[at] - np.column_stack([np.ones(len(at)), lagged(w, at, lags)]) @ np.asarray(coef)
                rows = np.arange(max(begin + max(places.lags), own - lost), len(w))
                if len(rows):
                    v = np.column_stack([np.ones(len(rows)), lagged(w, rows, places.lags), lagged(e, rows, places.lags), w[rows]])
                    g = v.T @ v
                    a, b = np.triu_indices(len(g))
                    made += [(i, int(d), int(se), int(x), int(t), float(g[x, t]), n) for x, t in zip(a, b)]
                if first_ + len(y) == n:
                    tail = reach(period)
                    made += [(i, int(d), int(se), -1 - j, -1, float(v), n) for j, v in enumerate(z[::-1][:tail])]
                    made += [(i, int(d), int(se), -1 - j, -2, float(v), n) for j, v in enumerate(e[::-1][: len(w) - begin][:tail])]
                    made += [(i, int(d), int(se), -1, -3, float(mean), n), (i, int(d), int(se), -2, -3, float(scale), n)]
            yield _rows(made, by, batch, ["d", "s", "i", "j", "v", "n"])

    names = ["step", "forecast", "lower", "upper", "ar_order", "difference", "ma_order", "seasonal_ar", "seasonal_difference", "seasonal_ma", "aicc"]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n, d, se = (int(pdf[c].iloc[0]) for c in ("n", "d", "s"))
        m, ends, matrix = season_for(n, period), pdf[pdf["j"] < 0], pdf[pdf["j"] >= 0]
        z, e, (scale, mean) = (ends[ends["j"] == j].sort_values("i")["v"].to_numpy() for j in (-1, -2, -3))  # the latest last
        places = Orders(n, m)
        g = square(matrix) if len(matrix) else np.diag([1.0] + [0.0] * (places.size - 1))
        order, x, sse, aicc = search_orders(g, places, d, se)
        values, weight = forecast(z, e, places, order, x, d, se, periods)
        edge = 1.96 * scale * np.sqrt(sse / g[0, 0] * weight)
        out = pd.DataFrame({"step": np.arange(1, periods + 1), "forecast": mean + scale * values})
        out["lower"], out["upper"] = out["forecast"] - edge, out["forecast"] + edge
        for name, value in zip(names[4:], [order[0], d, order[1], order[2], se, order[3], float(aicc + g[0, 0] * np.log(scale**2))]):
            out[name] = value
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, *names]]

    kinds = "step int, forecast double, lower double, upper double, ar_order int, difference int, ma_order int, seasonal_ar int, seasonal_difference int, seasonal_ma int, aicc double"
    second = sums(ready.mapInPandas(innovations, spec(s, by, cells)))
    out = second.applyInPandas(finish, spec(s, by, kinds))
    flat = O.join_small(stats, s.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by, bounded=single).where("scale = 0 OR n < 8")
    zero = [F.lit(0).alias(c) for c in names[4:10]]
    steps = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
    edge = 1.96 * F.col("scale")
    plain = flat.select(*by, steps, F.col("mean").alias("forecast"), (F.col("mean") - edge).alias("lower"), (F.col("mean") + edge).alias("upper"), *zero, F.lit(None).cast("double").alias("aicc"))
    out = out.unionByName(plain)
    return out.drop("_series") if single else out
