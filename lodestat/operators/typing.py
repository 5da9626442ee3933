"""Type inference, projection, filters and cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.operators import describe as D
from lodestat.operators import outliers as X
from lodestat.operators import quality as Q

# fixed values: accepted spellings and date shapes
TRUE_WORDS = ["true", "1", "yes", "y"]
FALSE_WORDS = ["false", "0", "no", "n"]
DATE_SHAPES = [
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{2}-\d{2}-\d{4}$",
    r"^\d{4}/\d{2}/\d{2}$",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}",
]
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy/MM/dd"]
NULL_WORDS = ["", "null", "na"]


def as_boolean(s: Column) -> Column:
    low = F.lower(F.trim(s))
    return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)


def as_timestamp(s: Column) -> Column:
    s = F.trim(s)
    tries = [
        F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))) for shape, fmt in zip(DATE_SHAPES, DATE_FORMATS)
    ]
    tries.append(F.when(s.rlike(DATE_SHAPES[4]), s.try_cast("timestamp")))
    return F.coalesce(*tries)


def infer_column_type(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Type per column from the share of values that parse: boolean, datetime, integer, float, string.

    All values vote; the reference looks at no more than the first 100, which
    has no meaning without a row order.
    """
    columns = columns or df.columns

    def metrics(d, c):
        s = F.trim(F.col(f"`{c}`").cast("string"))
        s = F.when(s != "", s)
        number = s.try_cast("double")
        return [
            F.count(s).alias("n"),
            F.count_if(as_boolean(s).isNotNull()).alias("booleans"),
            F.count_if(as_timestamp(s).isNotNull()).alias("dates"),
            F.count_if(number == F.floor(number)).alias("integers"),
            F.count(number).alias("numbers"),
        ]

    need = F.col("n") * threshold
    kind = (
        F.when(F.col("n") == 0, "string")
        .when(F.col("booleans") >= need, "boolean")
        .when(F.col("dates") >= need, "datetime")
        .when(F.col("integers") >= need, "integer")
        .when(F.col("numbers") >= need, "float")
        .otherwise("string")
    )
    return C.per_column(df, columns, metrics).withColumn("inferred_type", kind)


def convert_types(df: DataFrame, types: dict[str, str], raw_suffix: str = "_raw") -> DataFrame:
    """Convert string columns; a value that does not parse becomes null and stays in ``<col>_raw``."""
    out = df
    for c, kind in types.items():
        s = F.trim(F.col(f"`{c}`").cast("string"))
        new = {
            "integer": lambda s=s: F.floor(s.try_cast("double")).cast("long"),
            "float": lambda s=s: s.try_cast("double"),
            "boolean": lambda s=s: as_boolean(s),
            "datetime": lambda s=s: as_timestamp(s),
            "string": lambda s=s: F.when(s != "", s),
        }[kind]()
        lost = F.when(new.isNull() & (s != ""), F.col(f"`{c}`").cast("string"))
        out = out.withColumn(f"{c}{raw_suffix}", lost).withColumn(c, new)
    return out


def column_summary(df: DataFrame) -> DataFrame:
    """Per column: schema group, rows, nulls, distinct values."""

    def group(c):
        if c in C.boolean_columns(df):
            return "boolean"
        if c in C.temporal_columns(df):
            return "datetime"
        if c in C.numeric_columns(df):
            return "integer" if isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "float"
        return "text"

    def metrics(d, c):
        return [F.lit(group(c)).alias("base"), F.count(F.lit(1)).alias("n_rows"), F.count_if(C.missing(d, c)).alias("n_null")]

    return C.per_column(df, df.columns, metrics).join(Q.distinct_counts(df, df.columns), "column_name")


def select_by_type(df: DataFrame) -> DataFrame:
    """``(column_name, type_set)``: numeric needs two values, categorical at most 50."""
    base, d = F.col("base"), F.col("n_distinct")
    kind = (
        F.when(base.isin("integer", "float") & (d >= 2), "numeric")
        .when((base == "text") & (d <= 50), "categorical")
        .when(base.isin("datetime", "boolean"), base)
    )
    return column_summary(df).select("column_name", kind.alias("type_set")).where(F.col("type_set").isNotNull())


def column_kind(df: DataFrame) -> DataFrame:
    few = (C.ratio(F.col("n_distinct"), F.col("n_rows")) < 0.1) & (F.col("n_distinct") < 50)
    kind = F.when(F.col("base") != "text", F.col("base")).when(few, "categorical").otherwise("text")
    return column_summary(df).select("column_name", "n_distinct", kind.alias("kind"))


def judge_data_types(df: DataFrame) -> DataFrame:
    """Type, subtype, cardinality level and date-likeness per column."""
    numeric, strings = C.numeric_columns(df), C.string_columns(df)

    def metrics(d, c):
        x = C.number(d, c) if c in numeric else F.lit(None).cast("double")
        s = F.col(f"`{c}`") if c in strings else F.lit(None).cast("string")
        return [
            F.min(x).alias("low"),
            F.max(x).alias("high"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.coalesce(F.avg(as_timestamp(s).isNotNull().cast("double")) > 0.5, F.lit(False)).alias("date_like"),
        ]

    rows = column_summary(df).join(C.per_column(df, df.columns, metrics), "column_name")
    base, d = F.col("base"), F.col("n_distinct")
    share = C.ratio(d, F.col("n_rows"))
    sub_numeric = (
        F.when((base == "integer") & (d <= 20), "ordinal")
        .when((F.col("low") >= 0) & (F.col("high") <= 1), "probability")
        .when(base == "integer", "integer")
        .otherwise("continuous")
    )
    sub_text = F.when(d <= 5, "nominal_low").when(d <= 20, "nominal_medium").otherwise("nominal_high")
    is_num, is_text = base.isin("integer", "float"), base == "text"
    level = F.when(share > 0.8, "high").when(share > 0.3, "medium").otherwise("low")
    return rows.select(
        "column_name",
        F.when(is_num, "numeric").when(is_text, "categorical").otherwise(base).alias("type"),
        F.when(is_num, sub_numeric).when(is_text, sub_text).otherwise("standard").alias("sub_type"),
        F.when(is_text, level).alias("cardinality"),
        F.when(is_text, F.col("date_like")).otherwise(False).alias("date_like"),
        "n_rows",
        "n_null",
        "n_distinct",
        "mean",
        "std",
    )


INT_STEPS = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]
FLOAT_MAX = 3.4028234663852886e38


def downcast_plan(df: DataFrame) -> DataFrame:
    """Smallest type per column that holds its range; low-variety strings marked as category."""
    numeric = C.numeric_columns(df)

    def metrics(d, c):
        x = F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")
        return [F.min(x).alias("low"), F.max(x).alias("high"), F.lit(d.schema[c].dataType.simpleString()).alias("old_type")]

    rows = C.per_column(df, df.columns, metrics).join(column_summary(df).drop("n_null"), "column_name")
    lo, hi, base = F.col("low"), F.col("high"), F.col("base")
    ints = F.lit("bigint")
    for name, edge in reversed(INT_STEPS):
        ints = F.when((lo >= -edge) & (hi < edge), name).otherwise(ints)
    fits = (lo >= -FLOAT_MAX) & (hi <= FLOAT_MAX)
    new = (
        F.when((base == "integer") & lo.isNotNull(), ints)
        .when((base == "float") & fits, "float")
        .when((base == "text") & (C.ratio(F.col("n_distinct"), F.col("n_rows")) < 0.5), "category")
        .otherwise(F.col("old_type"))
    )
    return rows.select("column_name", "old_type", new.alias("new_type"))


def downcast_types(df: DataFrame) -> DataFrame:
    """Apply :func:`downcast_plan`; the plan is one small row per column."""
    plan = {r["column_name"]: r["new_type"] for r in downcast_plan(df).collect()}
    return df.select(
        *[F.col(f"`{c}`").cast(plan[c]).alias(c) if plan[c] != "category" else F.col(f"`{c}`") for c in df.columns]
    )


def clean_names(names: list[str], max_length: int | None = None) -> list[str]:
    out: list[str] = []
    for name in names:
        base = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", name, flags=re.UNICODE).strip())[:max_length] or "column"
        new, k = base, 0
        while new in out:
            k += 1
            new = f"{base}_{k}"
        out.append(new)
    return out


def sanitize_columns(df: DataFrame, max_length: int | None = None, drop_empty: bool = True) -> DataFrame:
    """Clean names, all-null columns out, infinities to null; strings are cut only where ``max_length`` says so."""
    keep = df.columns
    if drop_empty:
        filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
        keep = [c for i, c in enumerate(df.columns) if filled[i] > 0]

    def clean(c):
        kind, x = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, T.StringType) and max_length is not None:
            return F.substring(x, 1, max_length)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return F.when(F.abs(x) != float("inf"), x)
        return x

    return df.select(*[clean(c).alias(n) for c, n in zip(keep, clean_names(keep))])


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=subset)


def fill_constants(df: DataFrame, columns: list[str], strategy: str) -> DataFrame:
    """One row with the fill value of each column for mean, median or mode."""
    if strategy == "mean":
        return df.agg(*[F.avg(C.number(df, c)).alias(c) for c in columns])
    if strategy == "median":
        rows = O.exact_quantiles(df, columns, {"median": 0.5})
        return rows.agg(*[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(c) for c in columns])
    counts = D.value_counts(df, columns).where(F.col("value").isNotNull())
    best = counts.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("cnt"), "value")).alias("value"))
    return best.agg(*[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(c) for c in columns])


def fill_missing(
    df: DataFrame,
    columns: list[str],
    strategy: str = "mean",
    value: object = None,
    order_by: list[str] | None = None,
    keys: list[str] | None = None,
    chunk: int = O.CHUNK,
) -> DataFrame:
    """Fill by mean, median, mode, constant, forward_fill or back_fill."""
    if strategy == "constant":
        return df.fillna(value, subset=columns)
    if strategy in ("mean", "median", "mode"):
        one = fill_constants(df, columns, strategy).toDF(*[f"_f_{c}" for c in columns])
        fill = {}
        for c in columns:
            kind = df.schema[c].dataType
            kind = kind if strategy == "mode" else T.DoubleType()
            fill[c] = F.when(C.missing(df, c), F.col(f"_f_{c}").cast(kind)).otherwise(F.col(c).cast(kind))
        return df.crossJoin(F.broadcast(one)).withColumns(fill).drop(*one.columns)
    keys = keys or []
    back = strategy == "back_fill"
    pos = O.with_position(df, order_by, keys, "_pos", "_n").withColumn("_chunk", F.floor(F.col("_pos") / chunk))
    at = F.min_by if back else F.max_by
    edge = pos.groupBy(*keys, "_chunk").agg(
        *[at(F.col(c), F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_e_{c}") for c in columns]
    )
    # back filling reads from the end: a frame that grows is summed up row by row, one that shrinks is read anew for each row
    turn = F.desc if back else F.asc
    by_key = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy(turn("_chunk"))
    span = by_key.rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(*keys, "_chunk", *[F.last(f"_e_{c}", ignorenulls=True).over(span).alias(f"_k_{c}") for c in columns])
    joined = O.join_small(pos, carry, [*keys, "_chunk"], bounded=False)
    inside = Window.partitionBy(*[F.col(k) for k in keys], "_chunk").orderBy(turn("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_k_{c}")) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def duplicate_rows(df: DataFrame) -> DataFrame:
    return Q.duplicate_count(df).withColumn("duplicate_pct", C.ratio(F.col("n_duplicates"), F.col("n_rows")) * 100)


def drop_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(subset)


def validate_table(
    df: DataFrame, max_rows: int = 10_000_000, max_columns: int = 10_000, max_text: int = 100_000
) -> DataFrame:
    """``(check, column_name, value, ok)`` rows."""
    n, low = F.count(F.lit(1)), [c.lower() for c in df.columns]
    width = F.lit(len(df.columns)).cast("long")
    checks = []

    def check(name, column, value, ok):
        names = ("check", "column_name", "value", "ok")
        checks.append(F.struct(*[x.alias(k) for k, x in zip(names, (F.lit(name), F.lit(column), value, ok))]))

    check("row limit", "*", n, n <= max_rows)
    check("not empty", "*", n, n > 0)
    check("column limit", "*", width, width <= max_columns)
    for c in df.columns:
        known, same = F.count(F.col(f"`{c}`")), F.lit(low.count(c.lower())).cast("long")
        check("has values", c, known, known > 0)
        check("unique name", c, same, same == 1)
    for c in C.string_columns(df):
        longest = F.coalesce(F.max(F.length(f"`{c}`")), F.lit(0)).cast("long")
        check("text limit", c, longest, longest <= max_text)
    return df.agg(F.array(*checks).alias("_r")).select(F.inline("_r"))


def csv_quality_warnings(df: DataFrame) -> DataFrame:
    """Warning counts and score per string table as read from CSV; one row per column plus penalties."""
    names = df.columns

    def metrics(d, c):
        s = F.trim(F.col(f"`{c}`").cast("string"))
        gone = s.isNull() | F.lower(s).isin(NULL_WORDS)
        return [F.count(F.lit(1)).alias("n_rows"), F.count_if(gone).alias("n_missing")]

    rows = C.per_column(df, names, metrics).join(Q.distinct_counts(df, names), "column_name")
    known = F.col("n_rows") - F.col("n_missing")
    miss = C.ratio(F.col("n_missing"), F.col("n_rows")) * 100
    kinds = C.ratio(F.col("n_distinct"), known)
    flags = {
        "mostly_missing": miss > 90,
        "mostly_duplicates": F.coalesce((1 - kinds) > 0.8, F.lit(False)),
        "is_constant": F.col("n_distinct") == 1,
        "few_distinct": F.coalesce(kinds < 0.01, F.lit(False)),
    }
    points = F.when(miss > 50, 15).when(miss > 20, 10).when(miss > 10, 5).otherwise(0)
    out = rows.select("column_name", "n_rows", "n_missing", "n_distinct", miss.alias("missing_pct"), *[c.alias(n) for n, c in flags.items()])
    return out.withColumn("warnings", C.total([F.col(f).cast("int") for f in flags])).withColumn("missing_points", points)


def csv_quality_score(df: DataFrame) -> DataFrame:
    """100 - 5 per warning - the missing-share points of the whole table; one row."""
    w = csv_quality_warnings(df)
    one = w.agg(
        F.sum("warnings").alias("warnings"),
        (C.ratio(F.sum("n_missing"), F.sum("n_rows")) * 100).alias("missing_pct"),
    )
    pct = F.col("missing_pct")
    points = F.when(pct > 50, 15).when(pct > 20, 10).when(pct > 10, 5).otherwise(0)
    return one.withColumn("score", F.greatest(F.lit(0), 100 - 5 * F.col("warnings") - points))


def auto_preprocess_plan(df: DataFrame) -> DataFrame:
    """Plan rows ``(step, column_name, method)`` from the column judgement."""
    numeric = C.numeric_columns(df)
    rows = judge_data_types(df)
    if numeric:
        out = X.outliers_iqr(df, numeric).select("column_name", (F.col("outliers") > 0).alias("_out"))
        rows = rows.join(out, "column_name", "left")
    else:
        rows = rows.withColumn("_out", F.lit(False))
    outl = F.coalesce("_out", F.lit(False))
    null_pct = C.ratio(F.col("n_null"), F.col("n_rows")) * 100
    kind = F.col("type")
    fill = (
        F.when(kind == "numeric", F.when(outl, "median").otherwise("mean"))
        .when(kind == "categorical", "mode")
        .otherwise("forward_fill")
    )

    def step(name, method, test):
        return F.when(test, F.struct(F.lit(name).alias("step"), method.alias("method")))

    keep = null_pct <= 50
    steps = F.array_compact(
        F.array(
            step("remove_column", F.lit("drop"), null_pct > 50),
            step("handle_missing", fill, keep & (null_pct > 0)),
            step("handle_outliers", F.lit("iqr_clipping"), keep & (kind == "numeric") & outl),
            step("normalize", F.lit("standard_scaling"), keep & (kind == "numeric") & (F.col("std") > 2 * F.col("mean"))),
            step("reduce_cardinality", F.lit("top_categories"), keep & (F.col("cardinality") == "high")),
            step(
                "encode_categorical",
                F.when(F.col("n_distinct") <= 10, "one_hot").otherwise("label_encoding"),
                keep & (kind == "categorical"),
            ),
        )
    )
    plan = rows.select("column_name", F.inline(steps)).select("step", "column_name", "method")
    dup = Q.duplicate_count(df).where("n_duplicates > 0")
    return plan.unionByName(
        dup.select(F.lit("remove_duplicates").alias("step"), F.lit("*").alias("column_name"), F.lit("exact").alias("method"))
    )


def iqr_clip(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    fence = C.by_column(X.iqr_fences(df, columns, factor), columns)
    clip = {}
    for c, f in fence.items():
        x = C.number(df, c)
        clip[c] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(f["lower_fence"])), F.lit(f["upper_fence"])))
    return df.withColumns(clip)


def concat_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def join_inner(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "inner")


def join_semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def top_k(df: DataFrame, order_by: str, k: int, tie: str, largest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(order_by) if largest else F.asc(order_by), tie).limit(k)


def load_summary(df: DataFrame) -> DataFrame:
    """Shape, types, missing and duplicates as ``(column_name, metric, value)`` text rows."""

    def metrics(d, c):
        n, gone = F.count(F.lit(1)), F.count_if(C.missing(d, c))
        return [
            F.lit(d.schema[c].dataType.simpleString()).alias("dtype"),
            gone.cast("string").alias("missing"),
            F.format_string("%.2f", F.round(C.ratio(gone, n) * 100, 2)).alias("missing_pct"),
        ]

    per = C.per_column(df, df.columns, metrics).unpivot(["column_name"], ["dtype", "missing", "missing_pct"], "metric", "value")
    whole = Q.duplicate_count(df).select(
        F.lit("*").alias("column_name"),
        F.col("n_rows").cast("string").alias("n_rows"),
        F.lit(str(len(df.columns))).alias("n_columns"),
        F.col("n_duplicates").cast("string").alias("n_duplicates"),
    )
    return per.unionByName(whole.unpivot(["column_name"], ["n_rows", "n_columns", "n_duplicates"], "metric", "value"))


def sample_rows(
    df: DataFrame,
    method: str = "random",
    size: int | None = None,
    fraction: float | None = None,
    key: list[str] | None = None,
    strata: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Random, systematic or stratified sample; seeded by key so results do not depend on partitions."""
    key = key or df.columns
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key])
    order = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    if method == "random":
        if fraction is not None:
            return df.where(F.pmod(order, F.lit(1_000_000)) < int(fraction * 1_000_000))
        return df.orderBy(order, *key).limit(size)
    if method == "systematic":
        pos = O.with_position(df, key, None, "_pos", "_n")
        step = F.greatest(F.floor(F.col("_n") / size), F.lit(1))
        return pos.where((F.col("_pos") % step == 0) & (F.floor(F.col("_pos") / step) < size)).drop("_pos", "_n")
    sizes = df.groupBy(strata).agg(F.count(F.lit(1)).alias("_m"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) / F.col("_g")))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.count(F.lit(1)).alias("_g")))).select(strata, quota.alias("_quota"))
    local = Window.partitionBy(strata, "_salt").orderBy(order, *key)
    final = Window.partitionBy(strata).orderBy(order, *key)
    cut = df.withColumn("_salt", F.pmod(order, F.lit(256))).join(sizes, strata)
    cut = cut.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= F.col("_quota"))
    return cut.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= F.col("_quota")).drop("_r", "_salt", "_quota")
