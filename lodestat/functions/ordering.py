"""Order-dependent work without a single-task global window.

A window without partition keys, or with a key that holds a third of the rows,
runs in one task. These helpers cut the order into ranges by sketch quantiles,
work inside the ranges, and join back the small table of range offsets. The
sketch only places the cuts; results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import number


def range_count(df: DataFrame) -> int:
    """As many ranges as shuffle partitions, which the operator of a cluster sets by the size of the data."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def cuts(value: Column, n: int) -> Column:
    """Sketch quantiles that split ``value`` into ``n`` ranges of similar size, and every ~sqrt(n)-th of them."""
    step = max(1, int(n**0.5))
    fine = F.array_distinct(F.percentile_approx(value, [i / n for i in range(1, n)], max(1000, 20 * n)))
    return F.struct(fine.alias("fine"), F.filter(fine, lambda b, i: i % step == step - 1).alias("coarse"))


def range_of(value: Column, bounds: Column, n: int) -> Column:
    """Number of cuts below the value; two levels, so about 2*sqrt(n) compares."""
    step = max(1, int(n**0.5))
    skip = F.size(F.filter(bounds["coarse"], lambda b: b < value)) * step
    return skip + F.size(F.filter(F.slice(bounds["fine"], skip + 1, F.lit(step)), lambda b: b < value))


def is_cut(value: Column, bounds: Column, below: Column) -> Column:
    """Whether the value itself is a cut, given the number of cuts below it."""
    return F.coalesce(F.try_element_at(bounds["fine"], below + 1) == value, F.lit(False))


def join_small(df: DataFrame, small: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """Null-safe join on keys; broadcast only when the caller knows the row bound."""
    right = F.broadcast(small) if bounded else small
    if not keys:
        return df.crossJoin(right)  # one-row side
    extra = [c for c in small.columns if c not in keys]
    return (
        df.alias("l")
        .join(right.alias("r"), same_keys("l", "r", keys), "inner")
        .select("l.*", *[F.col(f"r.{c}") for c in extra])
    )


def cumulate(
    counts: DataFrame, value: str, measures: list[str], keys: list[str] | None = None, bounded_keys: bool = True
) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller values) and ``<m>_total`` per key group.

    ``counts`` holds one row per (keys, value), so a value that covers a third
    of the table is already a single row here. ``bounded_keys`` says that the
    number of key groups is small by construction (column names, models).
    """
    keys = keys or []
    n = range_count(counts)
    bounds = counts.groupBy(*keys).agg(cuts(F.col(value), n).alias("_cuts"))
    cut = join_small(counts, bounds, keys, bounded_keys)
    cut = cut.withColumn("_range", range_of(F.col(value), F.col("_cuts"), n)).drop("_cuts")
    sums = cut.groupBy(*keys, "_range").agg(*[F.sum(m).alias(f"_{m}_range") for m in measures])
    by_key = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(  # at most n rows per key group
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_{m}_range").over(earlier), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(f"_{m}_range").over(by_key).alias(f"{m}_total") for m in measures],
    )
    out = join_small(cut, offsets, [*keys, "_range"], bounded_keys)
    inside = Window.partitionBy(*[F.col(k) for k in keys], "_range").orderBy(value)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_{m}_offset") + F.coalesce(F.sum(m).over(inside), F.lit(0)))
    return out.drop("_range", *[f"_{m}_offset" for m in measures])


def long_values(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``(keys..., column_name, value)`` without missing values."""
    keys = keys or []
    wide = df.select(*keys, *[number(df, c).alias(f"_v{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"_v{i}").alias("value")) for i, c in enumerate(columns)]
    )
    return wide.select(*keys, F.inline(rows)).where(F.col("value").isNotNull())


def value_ranks(long: DataFrame, keys: list[str], bounded_keys: bool = True) -> DataFrame:
    """One row per (keys, value): ``cnt``, ``cnt_before``, ``cnt_total``, ``avg_rank``."""
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))
    out = cumulate(counts, "value", ["cnt"], keys, bounded_keys)
    return out.withColumn("avg_rank", F.col("cnt_before") + (F.col("cnt") + 1) / 2.0)


def pick_quantiles(ranked: DataFrame, keys: list[str], probs: dict[str, float], n: str = "cnt_total") -> DataFrame:
    """Linear-interpolation quantiles from :func:`value_ranks` rows."""
    first, last = F.col("cnt_before"), F.col("cnt_before") + F.col("cnt") - 1
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col(n) - 1)
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((first <= lo) & (lo <= last), F.col("value"))).alias(f"_{name}_lo"),
            F.max(F.when((first <= hi) & (hi <= last), F.col("value"))).alias(f"_{name}_hi"),
            F.max(at - lo).alias(f"_{name}_w"),
        ]
    out = ranked.groupBy(*keys).agg(F.max(n).alias("n"), *aggs)
    value = {
        name: F.col(f"_{name}_lo")
        + F.when(F.col(f"_{name}_w") == 0, 0.0).otherwise(
            (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")
        )
        for name in probs
    }
    return out.select(*keys, "n", *[c.alias(name) for name, c in value.items()])


def long_quantiles(ranked: DataFrame, keys: list[str], probs: list[float], n: str = "cnt_total") -> DataFrame:
    """``(keys..., p, quantile)`` rows for a long list of probabilities."""
    first, last = F.col("cnt_before"), F.col("cnt_before") + F.col("cnt") - 1

    def hit(at):
        lo, hi = F.floor(at), F.ceil(at)
        return ((first <= lo) & (lo <= last)) | ((first <= hi) & (hi <= last))

    wanted = F.filter(F.array(*[F.lit(float(p)) for p in probs]), lambda p: hit(p * (F.col(n) - 1)))
    rows = ranked.withColumn("p", F.explode(wanted)).withColumn("_at", F.col("p") * (F.col(n) - 1))
    at, w = F.col("_at"), F.max(F.col("_at") - F.floor("_at"))
    lo = F.max(F.when((first <= F.floor(at)) & (F.floor(at) <= last), F.col("value")))
    hi = F.max(F.when((first <= F.ceil(at)) & (F.ceil(at) <= last), F.col("value")))
    return rows.groupBy(*keys, "p").agg((lo + (hi - lo) * w).alias("quantile"))


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: dict[str, float] | None = None,
    keys: list[str] | None = None,
    bounded_keys: bool = False,
) -> DataFrame:
    """Exact quantiles per (keys, column): ``(keys..., column_name, n, <names>)``.

    The built-in exact percentile merges every distinct value of a group in
    one task; here distinct values stay spread over the cluster.
    """
    keys = keys or []
    by = [*keys, "column_name"]
    ranked = value_ranks(long_values(df, columns, keys), by, bounded_keys or not keys)
    return pick_quantiles(ranked, by, probs or QUARTILES)


def sort_number(df: DataFrame, name: str) -> Column:
    """A double that never falls as the column grows; used to place cuts only."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.StringType):
        return string_number(c, F.lit(0))
    return c.cast("double")


def string_number(c: Column, skip: Column) -> Column:
    """Six bytes of a string after ``skip`` bytes, as a number."""
    head = F.rpad(F.substring(F.hex(F.encode(c, "utf-8")), 2 * skip + 1, F.lit(12)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def common_bytes(low: Column, high: Column) -> Column:
    """Number of leading bytes in which two strings agree; all strings between them share these."""
    a, b = F.hex(F.encode(low, "utf-8")), F.hex(F.encode(high, "utf-8"))
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    same = F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.floor(F.size(same) / 2).cast("int"), F.lit(0))


def with_position(
    df: DataFrame, order_by: list[str], keys: list[str] | None = None, pos: str = "pos", n: str | None = "n_rows"
) -> DataFrame:
    """Add the 0-based position inside the key group under ``order_by``.

    Cuts come from the first order column; a value frequent enough to be a cut
    gets a range of its own, which is cut again by the second order column, so
    neither a large key group nor a frequent first value lands in one task.
    """
    keys = keys or []
    k = range_count(df)
    first = order_by[0]
    if isinstance(df.schema[first].dataType, T.StringType):
        # names like "Customer#0001" differ late: cut on the bytes after what the smallest and largest share, then on the next ones
        ends = df.agg(common_bytes(F.min(first), F.max(first)).alias("_skip"))
        named = df.crossJoin(F.broadcast(ends))
        o1, o2 = string_number(F.col(f"`{first}`"), F.col("_skip")), string_number(F.col(f"`{first}`"), F.col("_skip") + 6)
        named = named.withColumns({"_o1": o1, "_o2": o2}).drop("_skip")
    else:
        named = df.withColumn("_o1", sort_number(df, first))
        named = named.withColumn("_o2", sort_number(df, order_by[1]) if len(order_by) > 1 else F.lit(0.0))
    bounds = named.agg(cuts(F.col("_o1"), k).alias("_c1"), cuts(F.col("_o2"), k).alias("_c2"))
    cut = named.crossJoin(F.broadcast(bounds))
    cut = cut.withColumn("_r1", range_of(F.col("_o1"), F.col("_c1"), k))
    cut = cut.withColumn("_on", is_cut(F.col("_o1"), F.col("_c1"), F.col("_r1")))
    cut = cut.withColumns(
        {
            "_r1": F.coalesce(2 * F.col("_r1") + F.col("_on").cast("int"), F.lit(-1)),
            "_r2": F.when(F.col("_on"), F.coalesce(range_of(F.col("_o2"), F.col("_c2"), k), F.lit(-1))).otherwise(F.lit(0)),
        }
    ).drop("_on")
    cut = cut.drop("_c1", "_c2", "_o1", "_o2")
    sizes = cut.groupBy(*keys, "_r1", "_r2").agg(F.count(F.lit(1)).alias("_m"))
    by_key = Window.partitionBy(*[F.col(c) for c in keys]) if keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy("_r1", "_r2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_r1",
        "_r2",
        F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_m").over(by_key).alias(n or "_n"),
    )
    out = join_small(cut, offsets, [*keys, "_r1", "_r2"], bounded=False)
    inside = Window.partitionBy(*[F.col(c) for c in keys], "_r1", "_r2").orderBy(*order_by)
    out = out.withColumn(pos, F.col("_offset") + F.row_number().over(inside) - 1)
    return out.drop("_r1", "_r2", "_offset", *([] if n else ["_n"]))


CHUNK = 65536


def with_halo(
    df: DataFrame, keys: list[str], before: int, after: int = 0, pos: str = "pos", n: str = "n_rows", chunk: int = CHUNK
) -> tuple[DataFrame, "Window"]:
    """Cut each series into chunks that carry copies of their neighbours' edge rows.

    Returns the frame and the window to use inside a chunk. Frames that look at
    most ``before`` rows back and ``after`` rows ahead are exact for rows with
    ``_own``; :func:`drop_halo` keeps just those.
    """
    chunk = max(chunk, before + after + 1)
    low = F.floor(F.greatest(F.col(pos) - after, F.lit(0)) / chunk)
    high = F.floor(F.least(F.col(pos) + before, F.col(n) - 1) / chunk)
    out = df.withColumn("_chunk", F.explode(F.sequence(low, high)))
    out = out.withColumn("_own", F.col("_chunk") == F.floor(F.col(pos) / chunk))
    return out, Window.partitionBy(*[F.col(k) for k in keys], "_chunk").orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk")


def running_sum(
    df: DataFrame, measures: dict[str, Column], keys: list[str], pos: str = "pos", chunk: int = CHUNK
) -> DataFrame:
    """Inclusive running sums in position order, one chunk per task plus offsets."""
    cut = df.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    cut = cut.withColumns({f"_{m}": c for m, c in measures.items()})
    sums = cut.groupBy(*keys, "_chunk").agg(*[F.sum(f"_{m}").alias(f"_{m}_sum") for m in measures])
    by_key = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_{m}_sum").over(earlier), F.lit(0)).alias(f"_{m}_off") for m in measures]
    )
    out = join_small(cut, offsets, [*keys, "_chunk"], bounded=False)
    inside = Window.partitionBy(*[F.col(k) for k in keys], "_chunk").orderBy(pos)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for m in measures:
        out = out.withColumn(m, F.col(f"_{m}_off") + F.sum(f"_{m}").over(inside))
    return out.drop("_chunk", *[f"_{m}_off" for m in measures], *[f"_{m}" for m in measures])
