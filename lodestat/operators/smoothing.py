"""Exponential smoothing of long series by a scan over chunks.

A smoothing step maps the state by an affine function, ``x -> M x + c y``, whose matrix depends on the place in the season only. A chunk
of rows is then one affine map: its matrix is a power of the season's matrix, its offset is what the chunk makes of a zero state. Chunks
find their offsets side by side, a small fold over chunks carries the state across, and each chunk runs once more from its true start.
No row is forgotten and figures don't depend on the size of a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import ordering as O
from lodestat.session import stored


def chunk_arrays(s: DataFrame, keys: list[str], chunk: int, before: int = 0) -> DataFrame:
    """One row per chunk of a series: ``keys..., _chunk, first`` (position), ``n_rows, y`` (in order), with ``before`` earlier rows."""
    rows = O.with_halo(s, keys, before, chunk=chunk)[0] if before else s.withColumn("_chunk", F.floor(F.col("pos") / chunk))
    y = F.transform(F.sort_array(F.collect_list(F.struct("pos", "y"))), lambda r: r["y"])
    return rows.groupBy(*keys, "_chunk").agg(F.min("pos").alias("first"), F.first("n_rows").alias("n_rows"), y.alias("y"))


def keyed(s: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], bool]:
    """A series column for a frame that has none, and whether there is just one series."""
    return (s, keys, False) if keys else (s.withColumn("_series", F.lit(0)), ["_series"], True)


def spec(df: DataFrame, keys: list[str], tail: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys] + [tail])


# ---- simple smoothing --------------------------------------------------------


def smooth(s: DataFrame, keys: list[str], alpha: float = 0.3, chunk: int = O.CHUNK) -> DataFrame:
    """Simple exponential smoothing of ``alpha`` in (0, 1]: the first row's value, then alpha * y + (1 - alpha) * the level before.

    Inside a chunk a level is a running sum of values divided by a power of 1 - alpha, so a chunk is short enough for that power.
    """
    keep = 1 - alpha
    if keep <= 0:
        return s.withColumn("smoothed", F.col("y"))
    chunk = max(1, min(chunk, int(-250 / math.log10(keep))))
    rows, by, single = keyed(s, keys)
    rows = rows.withColumns({"_chunk": F.floor(F.col("pos") / chunk), "_at": F.col("pos") % chunk})
    weight = F.when(F.col("pos") == 0, F.lit(1.0)).otherwise(F.lit(alpha)) * F.col("y")
    grown = F.pow(F.lit(keep), -F.col("_at").cast("double"))
    # what each chunk but the last makes of a zero state, and the state that the next one starts with
    full = rows.where(F.floor((F.col("n_rows") - 1) / chunk) > F.col("_chunk"))
    offsets = full.groupBy(*by, "_chunk").agg(F.sum(weight * F.pow(F.lit(keep), (chunk - 1 - F.col("_at")).cast("double"))).alias("offset"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, level, out = pdf.sort_values("_chunk"), 0.0, []
        for offset in pdf["offset"]:
            level = keep**chunk * level + offset
            out.append(level)
        return pdf[by].assign(_chunk=pdf["_chunk"] + 1, _start=out)

    starts = offsets.groupBy(*by).applyInPandas(fold, spec(rows, by, "_chunk long, _start double"))
    inside = Window.partitionBy(*by, "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cond = O.same_keys("l", "r", [*by, "_chunk"])
    out = rows.alias("l").join(starts.alias("r"), cond, "left").select("l.*", F.coalesce("r._start", F.lit(0.0)).alias("_start"))
    level = (F.sum(weight * grown).over(inside) + keep * F.col("_start")) / grown
    return out.withColumn("smoothed", level).drop("_chunk", "_at", "_start", *(["_series"] if single else []))


# ---- Holt-Winters ------------------------------------------------------------

HW_GRID = list(product([0.1, 0.3, 0.5, 0.8], [0.01, 0.1, 0.3], [0.05, 0.2, 0.5]))  # fixed values: alpha, beta, gamma
ALPHA, BETA, GAMMA = (np.array(v) for v in zip(*HW_GRID))


def season_of(n: int, period: int) -> tuple[bool, int]:
    """Whether a series of ``n`` rows has a season, and its length."""
    return (True, min(period, n // 2)) if n >= 24 else (False, min(2, max(1, n // 2)))


def first_state(y: np.ndarray, m: int, seasonal: bool) -> np.ndarray:
    """Level, trend and season of every grid point from the first two periods: one row per state entry."""
    x = np.zeros((m + 2, len(HW_GRID)))
    x[0] = y[:m].mean()
    x[1] = (y[m : 2 * m].mean() - y[:m].mean()) / m if len(y) >= 2 * m else 0.0
    if seasonal:
        x[2:] = (y[:m] - y[:m].mean())[:, None]
    return x


def run(y: np.ndarray, first: int, m: int, seasonal: bool, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State after the rows ``y`` from position ``first`` on, and the squared errors of the one-step forecasts."""
    x, sse = x.copy(), np.zeros(x.shape[1])
    for i, v in enumerate(y):
        k = 2 + (first + i) % m
        level, trend, season = x[0].copy(), x[1], x[k]
        sse += (v - level - trend - season) ** 2
        x[0] = ALPHA * (v - season) + (1 - ALPHA) * (level + trend)
        x[1] = BETA * (x[0] - level) + (1 - BETA) * trend
        if seasonal:
            x[k] = GAMMA * (v - x[0]) + (1 - GAMMA) * season
    return x, sse


def chunk_matrix(n: int, first: int, m: int, seasonal: bool) -> np.ndarray:
    """What ``n`` rows of zeros from position ``first`` on make of each state: grid points x entries x entries."""
    size, points = m + 2, len(HW_GRID)

    def rows(count: int) -> np.ndarray:
        whole = np.tile(np.eye(size), (points, 1, 1))
        for i in range(count):
            k = 2 + (first + i) % m
            ab, c = (ALPHA * BETA)[:, None], GAMMA[:, None] * (1 - ALPHA[:, None])
            a, level, trend, season = ALPHA[:, None], whole[:, 0].copy(), whole[:, 1].copy(), whole[:, k].copy()
            whole[:, 0] = (1 - a) * (level + trend) - a * season
            whole[:, 1] = (1 - ab) * trend - ab * (level + season)
            if seasonal:
                whole[:, k] = (1 - c) * season - c * (level + trend)
        return whole

    return rows(n % m) @ np.linalg.matrix_power(rows(m), n // m)


def forecast_holt_winters(s: DataFrame, keys: list[str], periods: int = 10, period: int = 12, chunk: int = O.CHUNK) -> DataFrame:
    """Additive trend and season (from 24 rows), parameters from a grid by squared error. Series of one row have no forecast.

    Returns ``keys..., step, time, forecast, lower, upper``; ``time`` moves on by the series' median interval.
    """
    from lodestat.operators import series as S

    s, by, single = keyed(s, keys)
    chunk = max(chunk, 2 * period + 1)
    chunks = stored(chunk_arrays(s, by, chunk))
    points = len(HW_GRID)
    state = spec(s, by, "_chunk long, first long, n_rows long, len long, x array<double>, sse array<double>")

    names = [*by, "_chunk", "first", "n_rows", "len", "x", "sse"]

    def once(starts: bool):
        """One run over each chunk: the first from the state that its rows give, others from ``start`` or from zero."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                begins = pdf["start"] if starts else [None] * len(pdf)
                for first, n, y, start in zip(pdf["first"], pdf["n_rows"], pdf["y"], begins):
                    seasonal, m = season_of(int(n), period)
                    y, at = np.asarray(y, float), 0
                    if first > 0:
                        x = np.zeros((m + 2, points)) if start is None else np.asarray(start, float).reshape(m + 2, points)
                    else:
                        at = min(m, len(y))
                        x = first_state(y, m, seasonal)
                    x, sse = run(y[at:], int(first) + at, m, seasonal, x)
                    out.append((len(y) - at, x.ravel(), sse))
                made = pdf[[*by, "_chunk", "first", "n_rows"]].copy()
                made["len"], made["x"], made["sse"] = zip(*out) if out else ([], [], [])
                yield made[made["len"] > 0][names]

        return part

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """Start state of every chunk but the first."""
        pdf = pdf.sort_values("_chunk")
        seasonal, m = season_of(int(pdf["n_rows"].iloc[0]), period)
        out, x, known = [], None, {}
        for first, n, z in zip(pdf["first"], pdf["len"], pdf["x"]):
            z = np.asarray(z, float).reshape(m + 2, points)
            if x is not None:
                shape = (int(n), int(first) % m)
                if shape not in known:
                    known[shape] = chunk_matrix(shape[0], shape[1], m, seasonal)
                z = np.einsum("gij,jg->ig", known[shape], x) + z
            out.append(z.ravel())
            x = z
        return pdf[by].assign(_chunk=pdf["_chunk"] + 1, start=out).iloc[:-1]

    long = F.col("n_rows") > chunk
    begun = stored(chunks.mapInPandas(once(False), state))
    starts = begun.where(long).groupBy(*by).applyInPandas(fold, spec(s, by, "_chunk long, start array<double>"))
    later = O.join_small(chunks.where(F.col("first") > 0), starts, [*by, "_chunk"], bounded=False)
    parts = begun.where("first = 0").unionByName(later.mapInPandas(once(True), state))
    sums = parts.groupBy(*by).agg(
        F.max("n_rows").alias("n"), F.sum("len").alias("c"), F.max_by("x", "_chunk").alias("x"), F.array(*[F.sum(F.get("sse", g)) for g in range(points)]).alias("all"),
    )
    best = sums.withColumn("g", (F.array_position("all", F.array_min("all")) - 1).cast("int")).withColumn("sse", F.array_min("all"))
    m = (F.size("x") / points).cast("int") - 2
    entry = lambda i: F.element_at("x", (i * points + F.col("g") + 1).cast("int"))
    best = best.select(*by, "n", "c", "sse", m.alias("m"), "g", "x")
    info = S._tail_info(s, by)
    rows = S._future(O.join_small(info, best, by, bounded=single), by, periods)
    y = entry(F.lit(0)) + F.col("step") * entry(F.lit(1)) + entry(2 + (F.col("n") + F.col("step") - 1) % F.col("m"))
    edge = 1.96 * F.sqrt(F.try_divide(F.col("sse"), F.col("c").cast("double")))
    return rows.select(*keys, "step", "time", y.alias("forecast"), (y - edge).alias("lower"), (y + edge).alias("upper"))
