"""Clustering, the choice of k, and cluster quality."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.operators import describe as D
from lodestat.operators.features import scale_standard


def assembled(df: DataFrame, columns: list[str], standardize: bool = True) -> DataFrame:
    """Rows without missing values and the feature vector; input columns stay unscaled."""
    clean = df.dropna(subset=columns)
    scaled = clean.withColumns({f"_s_{c}": F.col(c).cast("double") for c in columns})
    names = [f"_s_{c}" for c in columns]
    scaled = scale_standard(scaled, names) if standardize else scaled
    return VectorAssembler(inputCols=names, outputCol="_features").transform(scaled).drop(*names)


def _label(model, data: DataFrame) -> DataFrame:
    return model.transform(data).withColumnRenamed("prediction", "cluster")


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42, standardize: bool = True) -> DataFrame:
    data = assembled(df, columns, standardize)
    model = KMeans(k=k, seed=seed, featuresCol="_features").fit(data)
    return _label(model, data).drop("_features")


def kmeans_centers(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """Centres in standardised units with sizes and inertia; k rows."""
    data = assembled(df, columns)
    model = KMeans(k=k, seed=seed, featuresCol="_features").fit(data)
    s = model.summary
    rows = [
        (i, int(n), float(s.trainingCost), [float(v) for v in c]) for i, (n, c) in enumerate(zip(s.clusterSizes, model.clusterCenters()))
    ]
    return df.sparkSession.createDataFrame(rows, "cluster int, size long, inertia double, center array<double>")


def gaussian_mixture(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    data = assembled(df, columns)
    model = GaussianMixture(k=k, seed=seed, featuresCol="_features", maxIter=50).fit(data)
    out = _label(model, data).withColumn("log_likelihood", F.lit(float(model.summary.logLikelihood)))
    return out.drop("_features", "probability")


def hierarchical(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """k clusters of a divisive hierarchy; :mod:`lodestat.operators.ward` merges bottom up."""
    data = assembled(df, columns)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_features").fit(data)
    return _label(model, data).drop("_features")


def cluster_metrics(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """Sizes, balance, noise share, Calinski-Harabasz and Davies-Bouldin from grouped sums; one row."""
    xs = [C.number(df, c) for c in columns]
    rows = df.select(F.col(label).alias("g"), *[x.alias(f"x{i}") for i, x in enumerate(xs)])
    good = rows.where(F.col("g") >= 0)
    dims = range(len(columns))
    cent = good.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"c{i}") for i in dims])
    # one small row per cluster from here on
    dist2 = C.total([(F.col(f"x{i}") - F.col(f"c{i}")) ** 2 for i in dims])
    spread = good.join(F.broadcast(cent), "g").groupBy("g").agg(
        F.sum(dist2).alias("ss"), F.avg(F.sqrt(dist2)).alias("s")
    )
    g = cent.join(spread, "g")
    total = C.total([F.sum(F.col("n") * F.col(f"c{i}") ** 2) - F.sum(F.col("n") * F.col(f"c{i}")) ** 2 / F.sum("n") for i in dims])
    k, n = F.count(F.lit(1)).cast("double"), F.sum("n").cast("double")
    one = g.agg(
        k.cast("int").alias("clusters"),
        F.sum("n").alias("n_rows"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        C.ratio(F.min("n"), F.max("n")).alias("balance"),
        C.ratio(total / (k - 1), F.sum("ss") / (n - k)).alias("calinski_harabasz"),
    )
    a, b = g.alias("a"), g.alias("b")
    gap = F.sqrt(C.total([(F.col(f"a.c{i}") - F.col(f"b.c{i}")) ** 2 for i in dims]))
    worst = a.join(F.broadcast(b), F.col("a.g") != F.col("b.g")).groupBy(F.col("a.g")).agg(  # clusters, not rows
        F.max((F.col("a.s") + F.col("b.s")) / gap).alias("r")
    )
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    noise = rows.agg(F.avg((F.col("g") < 0).cast("double")).alias("noise_share"))
    return one.crossJoin(db).crossJoin(noise)


def silhouette(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """Mean silhouette on squared distances (linear-time form)."""
    data = VectorAssembler(inputCols=columns, outputCol="_features").transform(df.where(F.col(label) >= 0).dropna(subset=columns))
    value = ClusteringEvaluator(featuresCol="_features", predictionCol=label).evaluate(data.withColumn(label, F.col(label).cast("double")))
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette double")


def choose_k(df: DataFrame, columns: list[str], k_max: int = 10, seed: int = 42) -> DataFrame:
    """Scores for k = 2..k_max and the vote of silhouette, elbow, Calinski-Harabasz and Davies-Bouldin."""
    data = assembled(df, columns).select("_features", *columns).cache()
    judge = ClusteringEvaluator(featuresCol="_features")
    rows = []
    for k in range(2, k_max + 1):
        model = KMeans(k=k, seed=seed, featuresCol="_features").fit(data)
        out = model.transform(data)
        m = cluster_metrics(_scaled_from(out, columns), columns, "prediction").first()
        rows.append((k, float(model.summary.trainingCost), float(judge.evaluate(out)), m["calinski_harabasz"], m["davies_bouldin"]))
    data.unpersist()
    bend = {rows[i][0]: rows[i - 1][1] - 2 * rows[i][1] + rows[i + 1][1] for i in range(1, len(rows) - 1)}
    votes = [
        max(rows, key=lambda r: r[2])[0],
        max(bend, key=bend.get) if bend else rows[0][0],
        max(rows, key=lambda r: r[3])[0],
        min(rows, key=lambda r: r[4])[0],
    ]
    best = max(sorted(set(votes)), key=votes.count)
    spec = "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, votes int, chosen boolean"
    return df.sparkSession.createDataFrame([(*r, votes.count(r[0]), r[0] == best) for r in rows], spec)


def _scaled_from(out: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    arr = out.withColumn("_a", vector_to_array("_features"))
    return arr.select("prediction", *[F.col("_a")[i].alias(c) for i, c in enumerate(columns)])


def cluster_profiles(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """Describe rows per cluster and feature with size and share."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.agg(F.sum("size").alias("_all"))
    sizes = sizes.crossJoin(F.broadcast(whole)).select(label, "size", (F.col("size") / F.col("_all") * 100).alias("pct"))
    return D.describe(df, columns, [label]).join(F.broadcast(sizes), label)
