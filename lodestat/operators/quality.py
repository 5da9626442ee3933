"""Missing data and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions import columns as C
from lodestat.operators import describe as D

# fixed values: name parts that select columns for the accuracy and validity rules
NON_NEGATIVE_NAMES = ["age", "count", "quantity", "amount", "price", "weight", "height"]
SHARE_NAMES = ["percentage", "percent", "rate", "ratio"]
MONEY_NAMES = ["price", "cost", "amount", "salary"]
PHONE_NAMES = ["phone", "tel", "전화"]
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^[\d\s\-\(\)\+]+$"
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def named_like(columns: list[str], parts: list[str]) -> list[str]:
    return [c for c in columns if any(p in c.lower() for p in parts)]


def short_form(df: DataFrame, name: str) -> Column:
    """The column with long texts as their digest: as many distinct values, far fewer bytes to move."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.length(c) > 64, F.sha2(c, 256)).otherwise(c)
    return c


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, n_distinct, top_cnt)``; values are counted once per column before the total."""
    short = df.select(*[short_form(df, c).alias(c) for c in columns])
    counts = D.value_counts(short, columns).where(F.col("value").isNotNull())
    rows = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"), F.max("cnt").alias("top_cnt"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(rows, "column_name", "left").select(
        "column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("top_cnt", F.lit(0)).alias("top_cnt")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_duplicates)``: rows equal to an earlier row."""
    groups = df.groupBy(*[short_form(df, c).alias(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicates")
    )


def missing_summary(df: DataFrame) -> DataFrame:
    cells = C.total([C.missing(df, c).cast("long") for c in df.columns])
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(cells), F.lit(0)).alias("total_missing"),
        F.count_if(cells == 0).alias("complete_rows"),
    )
    size = F.col("n_rows") * len(df.columns)
    return out.select(
        "total_missing",
        size.alias("total_cells"),
        F.round(C.ratio(F.col("total_missing"), size) * 100, 2).alias("missing_pct"),
        "complete_rows",
        F.round(C.ratio(F.col("complete_rows"), F.col("n_rows")) * 100, 2).alias("complete_row_pct"),
    )


def severity(pct):
    return (
        F.when(pct == 0, "none").when(pct < 5, "minor").when(pct < 15, "moderate").when(pct < 30, "severe").otherwise("critical")
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    def metrics(d, c):
        return [
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(C.missing(d, c)).alias("missing_count"),
            F.lit(d.schema[c].dataType.simpleString()).alias("data_type"),
        ]

    pct = F.col("missing_count") / F.col("n_rows") * 100
    rows = C.per_column(df, df.columns, metrics).where("n_rows > 0").join(distinct_counts(df, df.columns), "column_name")
    return rows.select(
        "column_name",
        "data_type",
        "missing_count",
        F.round(pct, 2).alias("missing_pct"),
        (F.col("n_rows") - F.col("missing_count")).alias("non_null_count"),
        "n_distinct",
        severity(pct).alias("severity"),
    )


def missing_patterns(df: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent sets of missing columns."""
    names = F.array_compact(F.array(*[F.when(C.missing(df, c), F.lit(c)) for c in df.columns]))
    counts = df.groupBy(F.array_join(names, ",").alias("pattern"), F.size(names).alias("n_missing")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    whole = counts.agg(F.sum("cnt").alias("_n"))
    k = F.col("n_missing")
    first = F.concat_ws(", ", F.slice(F.split("pattern", ","), 1, 3))
    text = (
        F.when(k == 0, "complete")
        .when(k == 1, F.concat(F.lit("only "), F.col("pattern")))
        .when(k == len(df.columns), "all columns")
        .otherwise(F.concat(k.cast("string"), F.lit(" columns: "), first, F.when(k > 3, "...").otherwise("")))
    )
    best = counts.orderBy(F.desc("cnt"), F.asc("pattern")).limit(top)
    return best.crossJoin(F.broadcast(whole)).select(
        "pattern", "n_missing", "cnt", F.round(F.col("cnt") / F.col("_n") * 100, 2).alias("pct"), text.alias("description")
    )


def suggest_imputation(df: DataFrame) -> DataFrame:
    """Fill method rows ``(column_name, method, priority)`` plus notes for columns with missing values."""
    from lodestat.operators.correlate import corr_pearson

    numeric = C.numeric_columns(df)
    rows = missing_by_column(df).where("missing_count > 0")
    is_num = F.col("column_name").isin(numeric) if numeric else F.lit(False)
    if len(numeric) > 1:
        pairs = corr_pearson(df, numeric).where(F.abs("r") > 0.7)
        linked = pairs.select(F.explode(F.array("column_a", "column_b")).alias("column_name")).distinct()
        rows = rows.join(linked.withColumn("_linked", F.lit(True)), "column_name", "left")
    else:
        rows = rows.withColumn("_linked", F.lit(None).cast("boolean"))
    linked = F.coalesce("_linked", F.lit(False))
    pct = F.col("missing_pct")

    def method(name, priority, test):
        return F.when(test, F.struct(F.lit(name).alias("method"), F.lit(priority).alias("priority")))

    low, mid = pct <= 20, (pct > 20) & (pct <= 50)
    methods = F.array_compact(
        F.array(
            method("drop column", "high", pct > 50),
            method("predictive model", "high", mid & is_num),
            method("multiple imputation", "high", mid),
            method("median", "high", low & is_num),
            method("mean", "medium", low & is_num),
            method("regression on correlated columns", "high", low & is_num & linked),
            method("mode", "high", low & ~is_num),
            method("own category", "medium", low & ~is_num),
        )
    )
    return rows.select(
        "column_name",
        "missing_pct",
        "severity",
        (pct < 10).alias("rows_may_be_dropped"),
        (F.coalesce(C.ratio(F.col("n_distinct"), F.col("non_null_count")), F.lit(0.0)) > 0.8).alias("mostly_distinct"),
        F.inline(methods),
    )


def missing_grade(df: DataFrame) -> DataFrame:
    pct, rows = F.col("missing_pct"), F.col("complete_row_pct")
    grade = (
        F.when((pct < 5) & (rows > 80), "excellent")
        .when((pct < 15) & (rows > 60), "good")
        .when(pct < 30, "fair")
        .otherwise("needs work")
    )
    score = F.greatest(F.lit(0.0), 100 - pct)
    return missing_summary(df).select("missing_pct", "complete_row_pct", F.round(score, 1).alias("score"), grade.alias("grade"))


def status(pct, steps=((95, "excellent"), (85, "good"), (70, "fair"))):
    return C.bands(pct, list(steps), "needs work")


def completeness(df: DataFrame) -> DataFrame:
    """``(scope, column_name, completeness, missing_count, status)`` for table, rows and columns."""

    def metrics(d, c):
        return [F.count(F.lit(1)).alias("n"), F.count_if(C.missing(d, c)).alias("missing_count")]

    per = C.per_column(df, df.columns, metrics)
    full = F.round((F.col("n") - F.col("missing_count")) / F.col("n") * 100, 2)
    cols = per.select(F.lit("column").alias("scope"), "column_name", full.alias("completeness"), "missing_count")
    s = missing_summary(df)
    whole = s.select(
        F.lit("table").alias("scope"),
        F.lit("*").alias("column_name"),
        F.round((F.col("total_cells") - F.col("total_missing")) / F.col("total_cells") * 100, 2).alias("completeness"),
        F.col("total_missing").alias("missing_count"),
    )
    rows = s.select(
        F.lit("rows").alias("scope"),
        F.lit("*").alias("column_name"),
        F.col("complete_row_pct").alias("completeness"),
        (F.col("total_cells") / len(df.columns) - F.col("complete_rows")).cast("long").alias("missing_count"),
    )
    return cols.unionByName(whole).unionByName(rows).withColumn("status", status(F.col("completeness")))


def _issue_rows(df: DataFrame) -> DataFrame:
    """``(dimension, type, column_name, penalty)``: one row per broken rule."""
    numeric, strings = C.numeric_columns(df), C.string_columns(df)
    n = F.count(F.lit(1))
    first = []  # rules that need one aggregation

    def rule(dimension, kind, column, penalty, broken):
        first.append(
            F.struct(
                F.lit(dimension).alias("dimension"),
                F.lit(kind).alias("type"),
                F.lit(column).alias("column_name"),
                F.lit(float(penalty)).alias("penalty"),
                broken.alias("_broken"),
            )
        )

    for c in strings:
        s = F.col(f"`{c}`")
        known, like = F.count(s), F.count_if(s.rlike(NUMBER_PATTERN))
        rule("consistency", "mixed types", c, 5, (like > 0) & (like < known) & ((known - like) / known < 0.9))
        rule("consistency", "outer spaces", c, 3, F.count_if(s.startswith(" ") | s.endswith(" ")) > 0)
    for c in named_like(numeric, NON_NEGATIVE_NAMES):
        rule("accuracy", "negative values", c, 8, F.count_if(C.number(df, c) < 0) > 0)
    for c in named_like(numeric, ["age"]):
        x = C.number(df, c)
        rule("accuracy", "impossible age", c, 10, F.count_if((x < 0) | (x > 150)) > 0)
    for c in named_like(numeric, SHARE_NAMES):
        x = C.number(df, c)
        rule("accuracy", "impossible share", c, 10, F.count_if((x < 0) | (x > 100)) > 0)
    for c in named_like(strings, ["email"]):
        rule("validity", "bad e-mail", c, 7, F.count_if(~F.col(f"`{c}`").rlike(EMAIL_PATTERN)) > 0)
    for c in named_like(strings, PHONE_NAMES):
        rule("validity", "bad phone", c, 7, F.count_if(~F.col(f"`{c}`").rlike(PHONE_PATTERN)) > 0)
    for c in named_like(numeric, MONEY_NAMES):
        rule("validity", "many zeros", c, 10, F.count_if(C.number(df, c) == 0) > n * 0.1)

    spec = "dimension string, type string, column_name string, penalty double"
    out = df.sparkSession.createDataFrame([], spec)
    if first:
        rows = df.agg(F.array(*first).alias("_r")).select(F.inline("_r"))
        out = out.unionByName(rows.where("_broken").drop("_broken"))

    counts = D.value_counts(df, df.columns).where(F.col("value").isNotNull())
    per = counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("kinds"), F.max("cnt").alias("top"), F.sum("cnt").alias("known")
    )
    repeated = per.where((F.col("top") / F.col("known") > 0.9) & (F.col("kinds") > 1))
    out = out.unionByName(_issues(repeated, "accuracy", "one value above 90 %", 5))
    if strings:
        folded = counts.where(F.col("column_name").isin(strings)).groupBy("column_name", F.lower("value").alias("v"))
        folded = folded.agg(F.count(F.lit(1)).alias("forms")).groupBy("column_name").agg(F.max("forms").alias("forms"))
        out = out.unionByName(_issues(folded.where("forms > 1"), "consistency", "letter case", 3))
    if numeric:
        basic = D.single_pass_stats(df, numeric).where("std > 0").select("column_name", "mean", "std")
        from lodestat.functions.ordering import long_values

        away = long_values(df, numeric).join(F.broadcast(basic), "column_name")
        far = away.groupBy("column_name").agg(
            F.avg((F.abs(F.col("value") - F.col("mean")) > 3 * F.col("std")).cast("double")).alias("share")
        )
        out = out.unionByName(_issues(far.where("share > 0.05"), "consistency", "extreme values", 5))
    return out


def _issues(rows: DataFrame, dimension: str, kind: str, penalty: float) -> DataFrame:
    return rows.select(
        F.lit(dimension).alias("dimension"), F.lit(kind).alias("type"), "column_name", F.lit(float(penalty)).alias("penalty")
    )


def consistency(df: DataFrame) -> DataFrame:
    return _dimension(df, "consistency")


def accuracy(df: DataFrame) -> DataFrame:
    return _dimension(df, "accuracy")


def validity(df: DataFrame) -> DataFrame:
    return _dimension(df, "validity")


def _dimension(df: DataFrame, name: str) -> DataFrame:
    """``(dimension, score, issues, issue_list, status)``; one row."""
    return quality_dimensions(df).where(F.col("dimension") == name)


def quality_dimensions(df: DataFrame) -> DataFrame:
    """Score rows for consistency, accuracy and validity."""
    dup = duplicate_count(df).select(
        F.lit("consistency").alias("dimension"),
        F.lit("duplicate rows").alias("type"),
        F.lit("*").alias("column_name"),
        F.least(F.lit(20.0), C.ratio(F.col("n_duplicates"), F.col("n_rows")) * 200).alias("penalty"),
    )
    issues = _issue_rows(df).unionByName(dup.where("penalty > 0"))
    names = df.sparkSession.createDataFrame([("consistency",), ("accuracy",), ("validity",)], "dimension string")
    label = F.concat_ws(":", "column_name", "type")
    got = issues.groupBy("dimension").agg(  # at most a few rules per column
        F.sum("penalty").alias("penalty"),
        F.count(F.lit(1)).alias("issues"),
        F.array_join(F.array_sort(F.collect_list(label)), ";").alias("issue_list"),
    )
    score = F.greatest(F.lit(0.0), 100 - F.coalesce("penalty", F.lit(0.0)))
    return names.join(got, "dimension", "left").select(
        "dimension",
        score.alias("score"),
        F.coalesce("issues", F.lit(0)).alias("issues"),
        F.coalesce("issue_list", F.lit("")).alias("issue_list"),
        status(score, ((90, "excellent"), (75, "good"), (60, "fair"))).alias("status"),
    )


# fixed values: weights of the quality dimensions
QUALITY_WEIGHTS = {"completeness": 0.3, "consistency": 0.25, "accuracy": 0.3, "validity": 0.15}


def quality_score(df: DataFrame) -> DataFrame:
    """Weighted score with letter grade; one row."""
    full = missing_summary(df).select(
        F.lit("completeness").alias("dimension"),
        ((F.col("total_cells") - F.col("total_missing")) / F.col("total_cells") * 100).alias("score"),
    )
    rows = quality_dimensions(df).select("dimension", "score").unionByName(full)

    def one(name):
        return F.max(F.when(F.col("dimension") == name, F.col("score")))

    wide = rows.agg(*[one(d).alias(d) for d in QUALITY_WEIGHTS])
    score = C.total([F.col(d) * w for d, w in QUALITY_WEIGHTS.items()])
    grade = C.bands(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")
    weak = F.array_compact(F.array(*[F.when(F.col(d) < 80, F.lit(d)) for d in QUALITY_WEIGHTS]))
    return wide.select(
        *[F.round(d, 1).alias(d) for d in QUALITY_WEIGHTS],
        F.round(score, 1).alias("overall"),
        grade.alias("grade"),
        F.array_join(weak, ",").alias("improve"),
    )


def uniqueness_score(df: DataFrame) -> DataFrame:
    """Distinct-ratio flags per column."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    rows = distinct_counts(df, df.columns).crossJoin(F.broadcast(n))
    share = C.ratio(F.col("n_distinct"), F.col("n_rows"))
    points = F.when(share == 1.0, 100).when((share > 0.95) | (share < 0.1), 80).otherwise(90)
    return rows.select(
        "column_name",
        "n_distinct",
        F.round(share, 4).alias("unique_ratio"),
        (share == 1.0).alias("is_identifier"),
        (share > 0.95).alias("is_highly_unique"),
        (share < 0.1).alias("is_low_cardinality"),
        points.alias("points"),
    )


def uniqueness_weighted_score(df: DataFrame) -> DataFrame:
    """The 0.3 / 0.2 / 0.3 / 0.2 score of completeness, consistency, validity and uniqueness."""
    from lodestat.operators.outliers import infinite_and_extreme

    full = missing_summary(df).select(
        ((F.col("total_cells") - F.col("total_missing")) / F.col("total_cells") * 100).alias("completeness")
    )
    dup = duplicate_count(df).select((100 - C.ratio(F.col("n_duplicates"), F.col("n_rows")) * 100).alias("consistency"))
    bad = infinite_and_extreme(df).agg(
        F.sum((F.col("infinite") > 0).cast("int") + (F.col("extreme") > 0).cast("int")).alias("k")
    )
    valid = bad.select(F.greatest(F.lit(0.0), 100.0 - F.coalesce("k", F.lit(0)) * 10).alias("validity"))
    uniq = uniqueness_score(df).agg(F.avg("points").alias("uniqueness"))
    row = full.crossJoin(dup).crossJoin(valid).crossJoin(uniq)  # one-row frames
    score = 0.3 * F.col("completeness") + 0.2 * F.col("consistency") + 0.3 * F.col("validity") + 0.2 * F.col("uniqueness")
    return row.withColumn("overall", score)


def load_quality(df: DataFrame) -> DataFrame:
    """Score of a freshly loaded table; empty strings count as missing."""
    blank = {c: C.missing(df, c) | (F.col(f"`{c}`") == "") for c in C.string_columns(df)}
    share = C.total(
        [F.avg(F.coalesce(blank.get(c, C.missing(df, c)), F.lit(True)).cast("double")) for c in df.columns]
    ) / len(df.columns)
    missing = df.agg((share * 100).alias("missing_pct"))
    dup = duplicate_count(df).select((C.ratio(F.col("n_duplicates"), F.col("n_rows")) * 100).alias("duplicate_pct"))
    # a typed table has one type per column, so a non-empty column is consistent
    filled = df.agg(
        (C.total([(F.count_if(~blank.get(c, C.missing(df, c))) > 0).cast("double") for c in df.columns]) / len(df.columns)).alias(
            "type_consistency"
        )
    )
    pct = F.col("missing_pct")
    score = (
        100
        - F.when(pct > 50, 30).when(pct > 20, 15).otherwise(0)
        - F.when(F.col("type_consistency") < 0.8, 20).otherwise(0)
        - F.when(F.col("duplicate_pct") > 10, 15).otherwise(0)
    )
    return missing.crossJoin(dup).crossJoin(filled).withColumn("score", F.greatest(F.lit(0), score))
