"""Queries that replay the events table as a stream and return the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import supervised as J
from lodestat.plans.registry import query
from lodestat.session import scratch_folder
from lodestat.streaming import streams as M


def events_stream(t):
    """The table as a file source, a file or a folder of part files, one micro-batch per file."""
    return M.file_stream(t.spark, f"{t.folder}/events.parquet*", t.events.schema)  # a pattern, as the source takes no single file


def events_in_parts(t, parts=6):
    """Events in time order in about ``parts`` files, so that there are several micro-batches."""
    path = scratch_folder(t.spark)
    rows = t.events.count() // parts + 1
    t.events.repartitionByRange("ts").sortWithinPartitions("ts").write.option("maxRecordsPerFile", rows).parquet(path)
    return M.file_stream(t.spark, path, t.events.schema)


def table(t, stream, mode):
    return M.run_to_table(stream, scratch_folder(t.spark), mode, scratch_folder(t.spark))


@query(
    "stream_running_stats",
    "SELECT event_type, count(value) AS n, avg(value) AS mean, var_pop(value) AS variance, stddev_pop(value) AS std FROM events GROUP BY 1",
    approx=("mean", "variance", "std"),
)
def _(t):
    return table(t, M.running_stats(events_in_parts(t), "event_type", "value"), "complete")


@query(
    "stream_last_n_stats",
    """WITH r AS (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS k FROM events)
       SELECT key, count(*) AS n, min(value) AS min, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75, max(value) AS max FROM r WHERE k <= 50 GROUP BY 1""",
    approx=("q25", "median", "q75"),
)
def _(t):
    return M.last_n_stats(events_in_parts(t), "event_type", "value", "ts", 50, scratch_folder(t.spark), scratch_folder(t.spark))


@query("stream_drift")
def _(t):
    return table(t, M.drift_events(events_in_parts(t), "event_type", "value", "ts", 100, 0.05), "append")


@query("stream_learn")
def _(t):
    learner = M.OnlineLinear(["value", "user_id"], "hit")
    stream = events_in_parts(t, 25).withColumn("hit", (F.col("value") > 50).cast("int"))
    M.fold_batches(stream, learner.partial_fit, scratch_folder(t.spark))
    rows = [(i, s, learner.trend()) for i, s in enumerate(learner.scores)]
    return t.spark.createDataFrame(rows, "batch int, score double, trend string")


@query("stream_predict")
def _(t):
    data = t.events.withColumn("hit", (F.col("value") > 50).cast("int"))
    model, classes = J.fit_classifier(data, ["value", "user_id"], "hit", "logistic")
    scored = J.batch_predict(model, events_stream(t), {"value": "double", "user_id": "bigint"}, classes)
    counts = scored.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("predictions"), F.avg("confidence").alias("mean_confidence"))
    return table(t, counts, "complete")


LOG = "(SELECT ts, event_type = 'error' AS is_error, value AS latency FROM events)"


def log(df):
    return df.select("ts", (F.col("event_type") == "error").alias("is_error"), F.col("value").alias("latency"))


for _period, _trunc in (("1h", "hour"), ("24h", "day")):
    _hours = {"1h": 1.0, "24h": 24.0}[_period]

    @query(
        f"monitor_metrics_{_period}",
        f"""SELECT strftime(date_trunc('{_trunc}', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS predictions, avg(CASE WHEN is_error THEN 1.0 ELSE 0 END) AS error_rate, avg(latency) AS latency_mean,
            max(latency) AS latency_max, median(latency) AS latency_median, quantile_cont(latency, 0.95) AS latency_p95, quantile_cont(latency, 0.99) AS latency_p99, count(*) / {_hours} AS per_hour, count(*) / {_hours * 60} AS per_minute FROM {LOG} x GROUP BY 1""",
        approx=("error_rate", "latency_mean", "latency_median", "latency_p95", "latency_p99", "per_hour", "per_minute"),
    )
    def _(t, period=_period):
        out = M.monitor_metrics(log(t.events), "ts", "is_error", "latency", period)
        return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query(
    "monitor_metrics_7d",
    f"""SELECT strftime(make_timestamp(CAST(floor(epoch_us(ts) / 604800000000.0) AS BIGINT) * 604800000000), '%Y-%m-%d') AS start, count(*) AS predictions,
        avg(CASE WHEN is_error THEN 1.0 ELSE 0 END) AS error_rate, median(latency) AS latency_median, count(*) / 168.0 AS per_hour FROM {LOG} x GROUP BY 1""",
    approx=("error_rate", "latency_median", "per_hour"),
)
def _(t):
    out = M.monitor_metrics(log(t.events), "ts", "is_error", "latency", "7d")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "predictions", "error_rate", "latency_median", "per_hour")


@query(
    "monitor_metrics_all",
    f"""SELECT 'all' AS start, count(*) AS predictions, avg(CASE WHEN is_error THEN 1.0 ELSE 0 END) AS error_rate, avg(latency) AS latency_mean, max(latency) AS latency_max,
        median(latency) AS latency_median, quantile_cont(latency, 0.95) AS latency_p95, quantile_cont(latency, 0.99) AS latency_p99,
        count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9) AS per_hour, count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 * 60) AS per_minute FROM {LOG} x""",
    approx=("error_rate", "latency_mean", "latency_median", "latency_p95", "latency_p99", "per_hour", "per_minute"),
)
def _(t):
    return M.monitor_metrics(log(t.events), "ts", "is_error", "latency", "all")


@query(
    "monitor_metrics_stream",
    f"""WITH w AS (SELECT date_trunc('hour', ts) AS h, is_error, latency FROM {LOG} x), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
        SELECT strftime(h, '%Y-%m-%d %H:%M') AS start, count(*) AS predictions, avg(CASE WHEN is_error THEN 1.0 ELSE 0 END) AS error_rate, avg(latency) AS latency_mean FROM w, m
        WHERE h + INTERVAL 1 HOUR <= mark GROUP BY 1""",
    approx=("error_rate", "latency_mean"),
)
def _(t):
    out = M.monitor_metrics(log(events_stream(t)), "ts", "is_error", "latency", "1h", late="10 minutes")
    done = table(t, out, "append")
    return done.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "predictions", "error_rate", "latency_mean")


@query("prediction_log", "SELECT event_id, CAST(value > 50 AS INTEGER) AS prediction, value AS latency FROM events")
def _(t):
    path = scratch_folder(t.spark)
    rows = events_in_parts(t).select("event_id", (F.col("value") > 50).cast("int").alias("prediction"), F.col("value").alias("latency"))
    M.run_to_files(rows, path, scratch_folder(t.spark))
    return t.spark.read.parquet(path)


@query(
    "drift_report",
    """WITH h AS (SELECT (event_id >= (SELECT count(*) FROM events) // 2) AS late, value, user_id FROM events),
       l AS (SELECT 'value' AS column_name, late, value FROM h UNION ALL SELECT 'user_id', late, CAST(user_id AS DOUBLE) FROM h),
       c AS (SELECT column_name, value, count(*) FILTER (NOT late) AS a, count(*) FILTER (late) AS b FROM l GROUP BY 1, 2),
       e AS (SELECT column_name, abs(sum(a) OVER w / sum(a) OVER k - sum(b) OVER w / sum(b) OVER k) AS d, sum(a) OVER k AS na, sum(b) OVER k AS nb FROM c
         WINDOW w AS (PARTITION BY column_name ORDER BY value), k AS (PARTITION BY column_name))
       SELECT column_name, max(d) AS statistic, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b FROM e GROUP BY 1""",
    approx=("statistic",),
)
def _(t):
    half = t.events.count() // 2
    old, new = t.events.where(F.col("event_id") < half), t.events.where(F.col("event_id") >= half)
    return M.drift_report(old, new, ["value", "user_id"]).drop("p_value", "drifted")
