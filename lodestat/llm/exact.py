"""Exact duplicates by a persistent index of digests.

The index is a table bucketed and sorted by digest with one row per distinct text. A batch is reduced to one row per digest before
it meets the index, so a text that fills a third of the batch is one row in that join, and the index itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import lower_ascii, materialise, whole_text

BUCKETS = 64


def with_digest(docs: DataFrame, text: str = "text", name: str = "text_sha256") -> DataFrame:
    """SHA-256 of the text after lower-casing A-Z; a missing text counts as empty."""
    return docs.withColumn(name, F.sha2(lower_ascii(whole_text(text)).cast("binary"), 256))


def open_index(spark: SparkSession, table: str, id_type: str = "bigint", buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """The index table, created empty where it doesn't exist; ``path`` places (or finds again) its files."""
    place = f"LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (text_sha256 STRING, keep_id {id_type}, group_size BIGINT) USING parquet "
        f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS {place}"
    )
    return spark.table(table)


def dedup_exact(docs: DataFrame, table: str, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key, text_sha256, keep_id, group_size, kept``; new digests are appended to the index ``table``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts in a batch the row with the largest key stays, unless the
    index knows the text from an earlier batch: then its key is ``keep_id`` and no row of the batch stays. ``group_size`` counts the
    rows of the batch. Missing text equals empty text; a missing key is the smallest; of rows that repeat key and text one stays.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    index = open_index(spark, table, kind, path=path)
    rows = with_digest(docs.select(F.col(key).alias("id"), F.col(text).alias("body")), "body")
    rows = materialise(rows.groupBy("text_sha256", "id").agg(F.count(F.lit(1)).alias("repeats")))
    groups = rows.groupBy("text_sha256").agg(F.max("id").alias("last_id"), F.sum("repeats").alias("group_size"))
    known = index.select("text_sha256", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
    groups = materialise(groups.join(known.hint("merge"), "text_sha256", "left"))
    fresh = groups.join(index.select("text_sha256").hint("merge"), "text_sha256", "left_anti")
    fresh = fresh.select("text_sha256", F.col("last_id").alias("keep_id"), "group_size")
    (
        fresh.repartition(BUCKETS, "text_sha256")
        .write.mode("append").format("parquet").bucketBy(BUCKETS, "text_sha256").sortBy("text_sha256")
        .option("compression", "zstd").saveAsTable(table, **({"path": path} if path else {}))
    )
    out = rows.join(groups, "text_sha256")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    new = F.col("known").isNull()
    return out.select(
        F.col("id").alias(key),
        "text_sha256",
        F.when(new, F.col("last_id")).otherwise(F.col("known_id")).alias("keep_id"),
        "group_size",
        (new & F.col("id").eqNullSafe(F.col("last_id")) & (F.col("copy") == 1)).alias("kept"),
    )


def drop_copies(docs: DataFrame, table: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``dedup_exact`` keeps, all columns; one row of each distinct text."""
    digest, keep = "__digest", "__keep"
    kept = dedup_exact(docs, table, key, text).where("kept").select(F.col("text_sha256").alias(digest), F.col("keep_id").alias(keep))
    found = with_digest(docs, text, digest).join(kept, digest).where(F.col(key).eqNullSafe(F.col(keep)))
    return found.dropDuplicates([digest]).select(*[F.col(f"`{c}`") for c in docs.columns])
