"""Mixing sources to target weights by Poisson replication.

Every document draws its number of copies from a Poisson distribution whose mean is the target repetition rate of its source. The
draw inverts the distribution at a uniform number hashed from seed and key, so it doesn't depend on partitioning or retries. Copies
are dealt to partitions by a hash and ordered in them by the same hash: a uniform global order with one shuffle and no sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import unit_hash, whole_text

#: The rate table is broadcast up to this many sources and joined by shuffle beyond.
BROADCAST_SOURCES = 100_000


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, source: str = "source", text: str = "text") -> DataFrame:
    """``source, n_docs, n_chars, weight, rate`` per source; the rates keep the expected number of characters.

    ``targets`` gives weights by source (others get 0); without it a source weighs its characters to the power ``alpha``. A missing
    source is a source of its own. A source without characters has rate 1.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.char_length(whole_text(text)).cast("long")).alias("n_chars")
    )
    if targets is None:
        raw = F.pow(F.col("n_chars").cast("double"), F.lit(alpha))
    else:
        table = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
        raw = F.coalesce(F.try_element_at(table, F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("raw", raw)
    total = sizes.agg(F.sum("raw").alias("all_raw"), F.sum("n_chars").alias("all_chars"))
    share = F.try_divide(F.col("raw"), F.col("all_raw"))
    return sizes.crossJoin(F.broadcast(total)).select(
        "source", "n_docs", "n_chars", F.coalesce(share, F.lit(0.0)).alias("weight"),
        F.when(F.col("n_chars") > 0, share * F.col("all_chars") / F.col("n_chars")).otherwise(F.lit(1.0)).alias("rate"),
    )


def poisson_bounds(rate: Column) -> Column:
    """Cumulative probabilities P(X <= k) for k = 0, 1, ... until beyond 52 bits; summed from logarithms, so large rates work."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("f"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("b"))

    def step(acc: Column, k: Column) -> Column:
        f = acc["f"] + F.ln(k.cast("double"))
        c = acc["c"] + F.exp(k * F.ln(rate) - rate - f)
        return F.struct(f.alias("f"), c.alias("c"), F.concat(acc["b"], F.array(c)).alias("b"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["b"])).otherwise(F.array(F.lit(1.0)))


def poisson_mix(
    docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, seed: str = "mix", key: str = "doc_id",
    source: str = "source", text: str = "text",
) -> DataFrame:
    """``docs`` with every row repeated as drawn, plus ``n_copies, copy_no`` (from 1), ``rate`` and ``shuffle_key``; globally shuffled.

    Rows that repeat a key draw alike; a missing key draws as the text "null". Columns of ``docs`` with these names are replaced.
    An empty table gives no rows.
    """
    rates = source_rates(docs, targets, alpha, source, text)
    rates = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), poisson_bounds(F.col("rate")).alias("__bounds"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    out = docs.drop("n_copies", "copy_no", "rate", "shuffle_key")
    out = out.join(rates, F.col(source).eqNullSafe(F.col("__source"))).withColumn("__u", unit_hash(F.col(key), seed=seed))
    out = out.withColumn("n_copies", F.size(F.filter("__bounds", lambda b: b <= F.col("__u"))).cast("long"))
    out = out.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    out = out.withColumn("shuffle_key", unit_hash(F.col(key), F.col("copy_no"), seed=f"{seed}-order"))
    out = out.withColumnRenamed("__rate", "rate").drop("__source", "__bounds", "__u")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", key)
