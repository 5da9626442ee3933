"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def number(df: DataFrame, name: str) -> Column:
    """Column as double with NaN read as missing."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c.cast("double")


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null on a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def or_zero(c: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


def bands(value: Column, steps: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """First label whose threshold the value reaches, thresholds in falling order."""
    out = None
    for limit, label in steps:
        test = value > limit if strict else value >= limit
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def per_column(df: DataFrame, columns: list[str], metrics, keys: list[str] | None = None) -> DataFrame:
    """One aggregation over the table, one result row per (keys, column).

    ``metrics(df, name)`` gives the named aggregate columns of one column, so
    all columns share a single scan with map-side partial aggregation.
    """
    keys = keys or []
    structs = [F.struct(F.lit(c).alias("column_name"), *metrics(df, c)) for c in columns]
    grouped = df.groupBy(*keys) if keys else df
    return grouped.agg(F.array(*structs).alias("_rows")).select(*keys, F.inline("_rows"))


def by_column(rows: DataFrame, columns: list[str]) -> dict[str, Row]:
    """Per-column statistics brought to the driver: at most one row for each named column."""
    got = rows.where(F.col("column_name").isin(columns)).limit(len(columns) + 1).collect()
    if len(got) > len(columns):
        raise ValueError("more than one row per column")
    return {r["column_name"]: r for r in got}


def to_metric_rows(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide metric columns to ``(ids..., metric, value)``."""
    cast = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(ids, metrics, "metric", "value")


def key_bucket(keys: list[str], buckets: int, seed: int = 42) -> Column:
    """Deterministic bucket in 0..buckets-1 from the key columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


# fixed values: Hart's rational approximation of the normal tail in West's form (double precision)
NORMAL_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
NORMAL_BOTTOM = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
]


def normal_tail(z: Column) -> Column:
    """Upper normal tail of |z| as a column expression."""
    x = F.abs(z)

    def poly(coefs):
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * x + k
        return out

    far = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
    density = F.exp(-x * x / 2)
    return F.when(x < 7.07106781186547, density * poly(NORMAL_TOP) / poly(NORMAL_BOTTOM)).otherwise(
        density / far / 2.506628274631
    )


def normal_cdf(z: Column) -> Column:
    return F.when(z > 0, 1 - normal_tail(z)).otherwise(normal_tail(z))


def normal_two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_tail(z))


def kolmogorov_p(lam: Column, terms: int = 100) -> Column:
    """Limit tail of the Kolmogorov statistic."""
    k = F.sequence(F.lit(1), F.lit(terms))
    term = F.transform(k, lambda i: F.when(i % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * i * i * lam * lam))
    series = F.aggregate(term, F.lit(0.0), lambda a, b: a + b)
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work when the input has fewer splits than cores.

    Inputs with enough splits, the normal case on a cluster, are left alone.
    """
    if df.isStreaming:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def corr(x: Column, y: Column) -> Column:
    """Pearson over complete pairs; null for a constant side (the built-in one fails there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
