"""Structured Streaming: running statistics, windows, drift, learning, scoring and logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from lodestat.functions import columns as C
from lodestat.operators import stats as H

PERIODS = {"1h": "1 hour", "24h": "24 hours", "7d": "7 days"}  # fixed values


def running_stats(stream: DataFrame, key: str, value: str) -> DataFrame:
    """All-time count, mean, population variance and std per key, updated as rows arrive."""
    x = F.col(value).cast("double")
    return stream.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std"))


def latest(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The last ``n`` rows ``(key, t, v)`` per group."""
    order = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("v"))
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def last_n_stats(stream: DataFrame, key: str, value: str, time: str, n: int, folder: str, checkpoint: str, salts: int = 64) -> DataFrame:
    """Min, max, median and quartiles of the last ``n`` values per key, once everything available is read.

    The state after each micro-batch is a table of at most n rows per key in ``folder``; the next batch is merged into it. A batch is
    first trimmed to n rows per key and salt, so no task holds all rows of a frequent key. Replayed batches write the same state again.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v"))
    states: list[str] = []

    def fold(batch: DataFrame, batch_id: int) -> None:
        near = latest(batch.withColumn("_s", F.pmod(F.xxhash64("t", "v"), F.lit(salts))), ["key", "_s"], n).drop("_s")
        if batch_id:
            near = near.unionByName(batch.sparkSession.read.parquet(f"{folder}/state-{batch_id - 1}"))
        latest(near, ["key"], n).write.mode("overwrite").parquet(f"{folder}/state-{batch_id}")
        states.append(f"{folder}/state-{batch_id}")

    fold_batches(rows, fold, checkpoint)
    state = stream.sparkSession.read.schema("key string, t long, v double").parquet(states[-1]) if states else stream.sparkSession.createDataFrame([], "key string, t long, v double")
    q = F.percentile("v", [0.25, 0.5, 0.75])
    out = state.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), q.alias("_q"), F.max("v").alias("max"))
    return out.select("key", "n", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"), "max")


def ks_gap(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    both = np.sort(np.concatenate([a, b]))
    d = float(np.abs(np.searchsorted(np.sort(a), both, "right") / len(a) - np.searchsorted(np.sort(b), both, "right") / len(b)).max())
    lam = np.sqrt(len(a) * len(b) / (len(a) + len(b))) * d
    k = np.arange(1, 101)
    p = 1.0 if lam < 0.2 else float(np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * lam * lam)).sum(), 0, 1))
    return d, p


def drift_events(stream: DataFrame, key: str, value: str, time: str, window: int = 100, threshold: float = 0.05) -> DataFrame:
    """KS comparison of a reference window with the current one per key; on drift the reference is replaced.

    The windows follow the time order, so one key's rows of a micro-batch are
    sorted together; the source's rows-per-trigger option bounds them.
    """

    def update(keys, batches, state):
        ref, cur, seen = ([], [], 0) if not state.exists else (list(state.get[0]), list(state.get[1]), state.get[2])
        pdf = pd.concat(list(batches)).sort_values("t")
        out = []
        for v in pdf["v"]:
            seen += 1
            if len(ref) < window:
                ref.append(v)
                continue
            cur.append(v)
            if len(cur) == window:
                d, p = ks_gap(np.array(ref), np.array(cur))
                out.append((keys[0], seen, d, p, p < threshold))
                ref, cur = (cur, []) if p < threshold else (ref, [])
        state.update((ref, cur, seen))
        yield pd.DataFrame(out, columns=["key", "at", "statistic", "p_value", "drift"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(
        update, "key string, at long, statistic double, p_value double, drift boolean", "r array<double>, c array<double>, seen long", "append", GroupStateTimeout.NoTimeout
    )


class OnlineLinear:
    """Linear or logistic model trained by one gradient step per micro-batch.

    The gradient is an aggregation over the batch; only the weight vector
    (one number per feature) is kept on the driver. The scaler comes from the
    first batch and stays fixed.
    """

    def __init__(self, features: list[str], label: str, task: str = "classification", rate: float = 0.5):
        self.features, self.label, self.task, self.rate = features, label, task, rate
        self.weights = [0.0] * (len(features) + 1)
        self.scale: list[tuple[float, float]] | None = None
        self.scores: list[float] = []

    def _inputs(self, batch: DataFrame) -> list:
        return [F.lit(1.0)] + [(C.number(batch, c) - m) / s for c, (m, s) in zip(self.features, self.scale)]

    def partial_fit(self, batch: DataFrame, batch_id: int = 0) -> None:
        if self.scale is None:
            aggs = [f(C.number(batch, c)).alias(f"{n}{i}") for i, c in enumerate(self.features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
            r = batch.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
            if not r["n"]:
                return
            self.scale = [(r[f"m{i}"], r[f"s{i}"] or 1.0) for i in range(len(self.features))]
        xs, y = self._inputs(batch), C.number(batch, self.label)
        z = C.total([x * w for x, w in zip(xs, self.weights)])
        guess = 1 / (1 + F.exp(-z)) if self.task == "classification" else z
        score = F.avg(((guess > 0.5).cast("double") == y).cast("double")) if self.task == "classification" else -F.avg((y - guess) ** 2)
        r = batch.agg(F.count(y).alias("n"), score.alias("score"), *[F.avg((guess - y) * x).alias(f"g{i}") for i, x in enumerate(xs)]).first()
        if not r["n"]:
            return
        self.scores.append(float(r["score"]))
        self.weights = [w - self.rate * r[f"g{i}"] for i, w in enumerate(self.weights)]

    def predict(self, df: DataFrame) -> DataFrame:
        z = C.total([x * w for x, w in zip(self._inputs(df), self.weights)])
        if self.task != "classification":
            return df.withColumn("prediction", z)
        p = 1 / (1 + F.exp(-z))
        return df.withColumns({"confidence": F.greatest(p, 1 - p), "prediction": (p > 0.5).cast("int")})

    def trend(self) -> str:
        if len(self.scores) < 20:
            return "insufficient data"
        return "improving" if np.mean(self.scores[-10:]) > np.mean(self.scores[:10]) else "degrading"


def monitor_metrics(df: DataFrame, time: str, error: str, latency: str, period: str = "1h", late: str | None = None) -> DataFrame:
    """Predictions, error rate, latency statistics and throughput per window; ``late`` adds a watermark.

    Latency percentiles are exact in batch mode and sketches of 10,000 marks on a stream.
    """
    if period == "all":
        grouped, hours = df.groupBy(F.lit("all").alias("start")), None
    else:
        # watermarks want a zoned timestamp; the session zone keeps the wall clock
        rows = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else df
        grouped = rows.groupBy(F.window(time, PERIODS[period]).alias("_w"))
        hours = {"1h": 1.0, "24h": 24.0, "7d": 168.0}[period]
    n = F.count(F.lit(1))
    probs = [0.5, 0.95, 0.99]
    q = F.percentile_approx(latency, probs, 10_000) if df.isStreaming else F.percentile(latency, probs)
    out = grouped.agg(
        n.alias("predictions"),
        F.avg(F.col(error).cast("double")).alias("error_rate"),
        F.avg(latency).alias("latency_mean"),
        F.max(latency).alias("latency_max"),
        q.alias("_q"),
        ((F.max(F.unix_micros(F.col(time).cast("timestamp"))) - F.min(F.unix_micros(F.col(time).cast("timestamp")))) / 3.6e9).alias("_span"),
    )
    span = F.col("_span") if hours is None else F.lit(hours)
    out = out.withColumns(
        {
            "latency_median": F.col("_q")[0],
            "latency_p95": F.col("_q")[1],
            "latency_p99": F.col("_q")[2],
            "per_hour": C.ratio(F.col("predictions"), span),
            "per_minute": C.ratio(F.col("predictions"), span * 60),
        }
    ).drop("_q", "_span")
    return out if hours is None else out.withColumn("start", F.col("_w.start")).drop("_w")


def drift_report(reference: DataFrame, current: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """KS statistic and p-value per shared column."""
    from lodestat.functions.ordering import long_values

    a = long_values(reference, columns).withColumn("g", F.lit("a"))
    b = long_values(current, columns).withColumn("g", F.lit("b"))
    return H.ks_two_sample(a.unionByName(b), "g", "value", ["column_name"]).withColumn("drifted", F.col("p_value") < alpha)


def run_to_table(stream: DataFrame, folder: str, mode: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Process everything available and return the final result, kept in files below ``folder``.

    ``append``: all rows. ``complete``: the rows of the last micro-batch. ``update``: the last row per ``keys``.
    """
    done: list[int] = []

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch-{batch_id}")  # a repeated batch replaces itself
        done.append(batch_id)

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    if not done:
        return spark.createDataFrame([], stream.schema)
    names = done[-1:] if mode == "complete" else sorted(set(done))
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(*[f"{folder}/batch-{i}" for i in names])
    if mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in stream.columns]), "_batch").alias("r")).select("r.*")
    return rows.select(*[F.col(f"`{c}`") for c in stream.columns])


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream to parquet; the file sink is exactly-once."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def fold_batches(stream: DataFrame, fn, checkpoint: str) -> None:
    """Call ``fn(batch, batch_id)`` for each micro-batch in order."""
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def file_stream(spark, folder: str, schema, fmt: str = "parquet", files_per_trigger: int = 1, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)
