"""Stream results must not depend on how the table is cut into micro-batches."""

import pytest
from pyspark.sql import functions as F

from lodestat.plans import streams as P
from lodestat.session import scratch_folder
from lodestat.streaming import streams as M


def events(spark):
    # one key holds a third of the rows
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
    return spark.range(2000).select(key.alias("k"), (F.col("id") * 37 % 1009).cast("double").alias("v"), F.timestamp_seconds(F.col("id") * 61 % 2003).alias("ts"))


@pytest.mark.parametrize("parts", [1, 7])
def test_last_n_and_updates(spark, tmp_path, parts):
    df = events(spark)
    path = str(tmp_path / "in")
    df.repartition(parts).write.parquet(path)
    stream = M.file_stream(spark, path, df.schema)
    got = M.last_n_stats(stream, "k", "v", "ts", 50, scratch_folder(spark), scratch_folder(spark), salts=4)
    want = {}
    for r in df.collect():
        want.setdefault(r["k"], []).append((r["ts"], r["v"]))
    want = {k: [v for _, v in sorted(x)[-50:]] for k, x in want.items()}
    assert {r["key"]: (r["n"], r["min"], r["max"]) for r in got.collect()} == {k: (len(x), min(x), max(x)) for k, x in want.items()}
    counts = stream.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for mode in ("update", "complete"):
        rows = M.run_to_table(counts, scratch_folder(spark), mode, scratch_folder(spark), ["k"]).collect()
        assert sorted(map(tuple, rows)) == sorted((k, n) for k, n in df.groupBy("k").count().collect())


@pytest.mark.parametrize("folder", [False, True])
def test_events_as_file_or_folder(spark, tmp_path, folder):
    path = tmp_path / "events.parquet"
    out = str(path) if folder else str(tmp_path / "parts")
    events(spark).repartition(3 if folder else 1).write.parquet(out)
    if not folder:
        next((tmp_path / "parts").glob("part-*.parquet")).rename(path)

    class Tables:
        pass

    t = Tables()
    t.spark, t.folder, t.events = spark, str(tmp_path), spark.read.parquet(str(path))
    rows = M.run_to_table(P.events_stream(t), scratch_folder(spark), "append", scratch_folder(spark))
    assert rows.count() == 2000
