"""Isolation forest (Liu, Ting, Zhou 2008)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.neighbors import flag_worst

SAMPLE = 256


def _path_constant(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng, depth: int, limit: int, nodes: list) -> int:
    """Append a node ``(feature, cut, left, right, length)``; leaves have feature -1."""
    at = len(nodes)
    spread = np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
    if depth >= limit or len(x) <= 1 or not spread.any():
        nodes.append((-1, 0.0, -1, -1, depth + _path_constant(len(x))))
        return at
    f = int(rng.choice(np.nonzero(spread)[0]))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    nodes.append(None)
    left = _grow(x[x[:, f] < cut], rng, depth + 1, limit, nodes)
    right = _grow(x[x[:, f] >= cut], rng, depth + 1, limit, nodes)
    nodes[at] = (f, cut, left, right, 0.0)
    return at


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Score per row, worst share flagged.

    Each tree grows on about 256 rows picked by a hash of tree and key, so
    trees do not depend on the partitioning. The forest is at most ``trees``
    times 511 nodes and travels with the scoring function.
    """
    rows = df.dropna(subset=columns).select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    n = rows.count()
    share = 1.0 if n <= SAMPLE else min(1.0, 1.5 * SAMPLE / n)
    cut = int(share * (1 << 30))
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(key)), F.lit(1 << 30)) < cut)
    sampled = rows.select(F.explode(picks).alias("tree"), key, "x")

    def build(pdf):
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(key)
        rng = np.random.default_rng([seed, t])
        x = np.stack(pdf["x"].to_numpy())
        x = x[rng.permutation(len(x))[:SAMPLE]]
        nodes: list = []
        _grow(x, rng, 0, math.ceil(math.log2(max(len(x), 2))), nodes)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "length"])
        return out.assign(tree=t, size=len(x), node=np.arange(len(out)))

    spec = "feature int, cut double, left int, right int, length double, tree int, size int, node int"
    forest = sampled.groupBy("tree").applyInPandas(build, spec).toPandas()
    parts = [g.sort_values("node") for _, g in forest.groupby("tree")]
    packed = [tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "length")) for g in parts]
    base = _path_constant(float(np.mean([g["size"].iloc[0] for g in parts]))) if parts else 1.0

    def score(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            total = np.zeros(len(x))
            for feature, cut_, left, right, length in packed:
                at = np.zeros(len(x), int)
                live = np.nonzero(feature[at] >= 0)[0]
                while len(live):
                    f = feature[at[live]]
                    go = x[live, f] < cut_[at[live]]
                    at[live] = np.where(go, left[at[live]], right[at[live]])
                    live = live[feature[at[live]] >= 0]
                total += length[at]
            yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-total / len(packed) / base)})

    kind = df.schema[key].dataType.simpleString()
    return flag_worst(rows.mapInPandas(score, f"`{key}` {kind}, score double"), key, "score", contamination)
