"""Ward clustering of any number of rows through mergeable clustering features.

Count, sum and sum of squares of a set of points are all that Ward's distance needs, and they add up. Rows become distinct points with
weights, points become the leaves of a pivot tree, one feature per leaf, and the bounded number of leaves is merged bottom up. Up to
``LEAVES`` distinct points are leaves themselves, so the clustering of a small table is exact.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.cluster import assembled
from lodestat.operators.neighbors import Tree
from lodestat.session import stored

LEAVES = 1500


def merges(weights: np.ndarray, centers: np.ndarray) -> list[tuple[float, int, int]]:
    """Ward's merges ``(increase of the squared error, node, node)`` by increase; leaves are 0.., node n + i is the i-th merge found.

    A chain of nearest neighbours ends in two clusters that are each other's nearest; with Ward's distance they belong together.
    """
    n = len(weights)
    w, c = weights.astype(float).copy(), centers.astype(float).copy()
    name, alive, out, chain = np.arange(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            gap = w * w[a] / (w + w[a]) * ((c - c[a]) ** 2).sum(axis=1)
            gap[~alive] = np.inf
            gap[a] = np.inf
            b = int(gap.argmin())
            if len(chain) > 1 and gap[chain[-2]] <= gap[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        out.append((float(gap[b]), int(name[a]), int(name[b])))
        c[a] = (w[a] * c[a] + w[b] * c[b]) / (w[a] + w[b])
        w[a] += w[b]
        alive[b] = False
        name[a] = n + len(out) - 1
    return out


def cut(n: int, tree: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """Cluster of each of ``n`` leaves after all merges but the ``k`` - 1 largest."""
    parent = np.arange(n + len(tree))
    order = sorted(range(len(tree)), key=lambda i: (tree[i][0], i))
    for i in order[: max(0, n - k)]:
        parent[tree[i][1]] = parent[tree[i][2]] = n + i

    def root(x: int) -> int:
        while parent[x] != x:
            x = int(parent[x])
        return x

    return np.array([root(x) for x in range(n)])


def leaves_of(points: DataFrame, width: int, limit: int) -> DataFrame:
    """``id, leaf, w, x``: distinct points with the leaf that they belong to, at most about ``limit`` leaves."""
    n = points.count()
    if n <= limit:
        return points.withColumn("leaf", F.col("id"))
    block = max(1, math.ceil(2 * n / limit))
    while True:
        found = Tree(points, block).points.withColumnRenamed("cell", "leaf")
        if found.select("leaf").distinct().count() <= 2 * limit:
            return found
        block *= 2


def hierarchical(df: DataFrame, columns: list[str], k: int, leaves: int = LEAVES, standardize: bool = True) -> DataFrame:
    """Rows of ``df`` without missing features and their ``cluster`` of ``k`` by Ward linkage; the largest cluster is 0.

    Clusters of equal size are numbered by their first centre. Fewer distinct points than ``k`` give as many clusters as there are points.
    Above ``leaves`` distinct points, points of one tree leaf stay together.
    """
    rows = assembled(df, columns, standardize).withColumn("_x", vector_to_array("_features")).drop("_features")
    rows = rows.withColumn("_id", F.xxhash64("_x"))
    points = stored(rows.groupBy(F.col("_id").alias("id")).agg(F.first("_x").alias("x"), F.count(F.lit(1)).alias("w")))
    width = len(columns)
    placed = stored(leaves_of(points, width, leaves))
    features = placed.groupBy("leaf").agg(F.sum("w").alias("w"), *[F.sum(F.get("x", i) * F.col("w")).alias(f"s{i}") for i in range(width)]).orderBy("leaf").collect()
    weights = np.array([r["w"] for r in features], float)
    centers = np.array([[r[f"s{i}"] / r["w"] for i in range(width)] for r in features]).reshape(len(features), width)
    groups = cut(len(features), merges(weights, centers), k) if features else np.zeros(0, int)
    size = {g: (-weights[groups == g].sum(), tuple(np.average(centers[groups == g], axis=0, weights=weights[groups == g]))) for g in set(groups.tolist())}
    rank = {g: i for i, g in enumerate(sorted(size, key=size.get))}
    table = df.sparkSession.createDataFrame([(r["leaf"], rank[g]) for r, g in zip(features, groups.tolist())], "leaf long, cluster int")
    named = placed.select("id", "leaf").join(F.broadcast(table), "leaf").select(F.col("id").alias("_id"), "cluster")  # a row per leaf
    return rows.join(named, "_id").drop("_id", "_x")
