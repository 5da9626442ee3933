"""Queries over the descriptive operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import describe as D
from lodestat.plans.registry import LINEITEM_NULLS, long_sql, query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = long_sql("lineitem", NUM)
NULLS = long_sql(LINEITEM_NULLS, ["l_quantity", "l_extendedprice"])


def q(p):
    return f"quantile_cont(value, {p})"


@query(
    "describe",
    f"""SELECT column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
        max(value) AS max, {q(0.25)} AS q25, {q(0.5)} AS median, {q(0.75)} AS q75
        FROM {long_sql(LINEITEM_NULLS, NUM)} GROUP BY 1""",
    approx=("mean", "std", "q25", "median", "q75"),
)
def _(t):
    return D.describe(t.lineitem_nulls, NUM)


@query(
    "describe_by_group",
    f"""SELECT l_returnflag, column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,
        min(value) AS min, max(value) AS max, {q(0.25)} AS q25, {q(0.5)} AS median, {q(0.75)} AS q75
        FROM {long_sql("lineitem", NUM, ["l_returnflag"])} GROUP BY 1, 2""",
    approx=("mean", "std", "q25", "median", "q75"),
)
def _(t):
    return D.describe(t.lineitem, NUM, ["l_returnflag"])


SKEW_POP = "(skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)))"


@query(
    "moments",
    f"""SELECT column_name, count(value) AS n, var_samp(value) AS variance, {SKEW_POP} AS skewness,
        kurtosis_pop(value) AS kurtosis, skewness(value) AS skewness_sample, kurtosis(value) AS kurtosis_sample
        FROM {LONG} GROUP BY 1""",
    approx=("variance", "skewness", "kurtosis", "skewness_sample", "kurtosis_sample"),
)
def _(t):
    return D.moments(t.lineitem, NUM)


ADVANCED = f"""
    WITH l AS (SELECT * FROM {NULLS}),
    m AS (SELECT column_name, median(value) AS med FROM l GROUP BY 1),
    d AS (SELECT column_name, median(abs(value - med)) AS mad FROM l JOIN m USING (column_name) GROUP BY 1)
    SELECT column_name, count(value) AS valid, count(*) - count(value) AS missing, avg(value) AS mean,
      stddev_samp(value) AS std, max(value) - min(value) AS range, stddev_samp(value) / avg(value) AS cv,
      quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, any_value(mad) AS mad
    FROM l JOIN d USING (column_name) GROUP BY 1"""


@query("advanced_stats", ADVANCED, approx=("mean", "std", "range", "cv", "iqr", "mad"))
def _(t):
    return D.advanced_stats(t.lineitem_nulls, ["l_quantity", "l_extendedprice"])


@query(
    "summary_across_columns",
    f"""WITH r AS (SELECT column_name, avg(value) AS m, stddev_samp(value) AS s, count(*) - count(value) AS missing
          FROM {long_sql(LINEITEM_NULLS, NUM)} GROUP BY 1)
        SELECT min(m) AS mean_min, max(m) AS mean_max, avg(m) AS mean_average, stddev_samp(m) AS mean_std,
          min(s) AS std_min, max(s) AS std_max, avg(s) AS std_average, max(s) - min(s) AS std_range,
          CAST(sum(missing) AS BIGINT) AS total_missing, count(*) FILTER (missing > 0) AS columns_with_missing,
          max(missing) AS max_missing, avg(missing) AS avg_missing FROM r""",
    approx=(
        "mean_min", "mean_max", "mean_average", "mean_std", "std_min", "std_max", "std_average", "std_range", "avg_missing",
    ),
)
def _(t):
    return D.summary_across_columns(t.lineitem_nulls, NUM)


@query(
    "high_variation",
    f"""SELECT column_name, stddev_samp(value) / avg(value) AS cv FROM {long_sql("events", ["value", "user_id"])}
        GROUP BY 1 HAVING stddev_samp(value) / avg(value) > 0.9""",
    approx=("cv",),
)
def _(t):
    return D.high_variation(t.events, ["value", "user_id"], threshold=0.9)


@query(
    "distribution_label",
    f"""WITH m AS (SELECT column_name, {SKEW_POP} AS s, kurtosis_pop(value) AS k
          FROM {long_sql("lineitem", NUM)} GROUP BY 1
          UNION ALL SELECT column_name, {SKEW_POP}, kurtosis_pop(value) FROM {long_sql("events", ["value"])} GROUP BY 1),
        l AS (SELECT column_name,
          CASE WHEN abs(s) < 0.5 THEN 'symmetric' WHEN s > 0.5 THEN 'right_skewed' ELSE 'left_skewed' END AS skew_label,
          CASE WHEN abs(k) < 0.5 THEN 'mesokurtic' WHEN k > 0.5 THEN 'leptokurtic' ELSE 'platykurtic' END AS kurt_label
          FROM m)
        SELECT *, skew_label || '_' || kurt_label AS label FROM l""",
)
def _(t):
    return D.distribution_label(t.lineitem, NUM).unionByName(D.distribution_label(t.events, ["value"]))


@query(
    "distribution_shape",
    f"""WITH m AS (SELECT column_name, count(value) AS n, {SKEW_POP} AS skewness, kurtosis_pop(value) AS kurtosis,
          max(value) - min(value) AS range, stddev_samp(value) / avg(value) AS cv,
          {q(0.01)} AS p1, {q(0.05)} AS p5, {q(0.95)} AS p95, {q(0.99)} AS p99
          FROM {long_sql("events", ["value", "user_id"])} GROUP BY 1)
        SELECT *, CASE WHEN abs(skewness) < 0.5 THEN 'symmetric' WHEN skewness >= 1 THEN 'strong right'
            WHEN skewness >= 0.5 THEN 'slight right' WHEN skewness > -1 THEN 'slight left' ELSE 'strong left' END AS skew_band,
          CASE WHEN kurtosis > 1 THEN 'peaked' WHEN kurtosis < -1 THEN 'flat' ELSE 'normal-like' END AS kurt_band,
          CASE WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 1 THEN 'Normal-like' WHEN skewness > 1 THEN 'Right-skewed'
            WHEN skewness < -1 THEN 'Left-skewed' WHEN kurtosis > 2 THEN 'Heavy-tailed'
            WHEN kurtosis < -1 THEN 'Light-tailed' ELSE 'Moderately non-normal' END AS shape FROM m""",
    approx=("skewness", "kurtosis", "range", "cv", "p1", "p5", "p95", "p99"),
)
def _(t):
    return D.distribution_shape(t.events, ["value", "user_id"])


def counts_sql(table, cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM {table} s GROUP BY {c}" for c in cols
    )


@query(
    "categorical_stats",
    f"""WITH c AS ({counts_sql(LINEITEM_NULLS, ["l_returnflag", "l_linestatus"])}
          UNION ALL {counts_sql("part", ["p_brand"])}),
        t AS (SELECT column_name, count(value) AS n_distinct,
            CAST(coalesce(sum(cnt) FILTER (value IS NULL), 0) AS BIGINT) AS n_null,
            CAST(coalesce(sum(cnt) FILTER (value IS NOT NULL), 0) AS BIGINT) AS n_valid FROM c GROUP BY 1),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS INTEGER) AS rank
              FROM c WHERE value IS NOT NULL)
        SELECT t.*, r.value, r.cnt, r.rank FROM t JOIN r USING (column_name) WHERE rank <= 10""",
)
def _(t):
    return D.categorical_stats(t.lineitem_nulls, ["l_returnflag", "l_linestatus"]).unionByName(
        D.categorical_stats(t.part, ["p_brand"])
    )


@query(
    "frequency",
    """SELECT c_mktsegment AS value, count(*) AS cnt, 100.0 * count(*) / (SELECT count(*) FROM customer) AS pct
       FROM customer GROUP BY 1""",
    approx=("pct",),
)
def _(t):
    return D.frequency(t.customer, "c_mktsegment")


@query(
    "top_categories_with_other",
    """WITH c AS (SELECT p_brand AS category, count(*) AS cnt FROM part GROUP BY 1),
       a AS (SELECT CAST(sum(cnt) AS BIGINT) AS n, -sum(cnt / (SELECT count(*) FROM part) * log2(cnt / (SELECT count(*) FROM part))) AS entropy,
             max(cnt) / sum(cnt) AS largest_share FROM c),
       r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, category) AS k FROM c),
       o AS (SELECT category, cnt FROM r WHERE k <= 10 UNION ALL
             SELECT 'other', CAST(sum(cnt) AS BIGINT) FROM r WHERE k > 10 HAVING count(*) > 0)
       SELECT category, cnt, 100.0 * cnt / n AS pct, entropy, largest_share FROM o, a""",
    approx=("pct", "entropy", "largest_share"),
)
def _(t):
    return D.top_categories_with_other(t.part, "p_brand")


@query(
    "histogram",
    f"""WITH l AS (SELECT * FROM {long_sql("lineitem", ["l_quantity", "l_extendedprice"])}),
        s AS (SELECT column_name, count(value) AS n, min(value) AS lo, max(value) AS hi,
              {q(0.25)} AS a, {q(0.75)} AS b FROM l GROUP BY 1),
        o AS (SELECT *, [floor(log2(n) + 1), floor(sqrt(n)), floor((hi - lo) / (2 * (b - a) / cbrt(n)))] AS opts FROM s),
        k AS (SELECT *, CAST(floor(list_median(list_filter(opts, lambda x: x BETWEEN 5 AND 50))) AS INTEGER) AS bins FROM o),
        w AS (SELECT *, (hi - lo) / bins AS width FROM k),
        g AS (SELECT column_name, lo, hi, width, bins, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM w),
        c AS (SELECT column_name, CAST(least(floor((value - lo) / width), bins - 1) AS INTEGER) AS bin, count(*) AS cnt
              FROM l JOIN w USING (column_name) GROUP BY 1, 2)
        SELECT column_name, bin, lo + bin * width AS left, lo + bin * width + width AS right,
          lo + bin * width + width / 2 AS center, width, coalesce(cnt, 0) AS cnt
        FROM g LEFT JOIN c USING (column_name, bin)""",
    approx=('"left"', '"right"', "center", "width"),
)
def _(t):
    return D.histogram(t.lineitem, ["l_quantity", "l_extendedprice"])


@query(
    "ecdf",
    """WITH c AS (SELECT value, count(*) AS cnt FROM events GROUP BY 1)
       SELECT value, cnt, sum(cnt) OVER (ORDER BY value) / (SELECT count(*) FROM events) AS ecdf FROM c""",
    approx=("ecdf",),
)
def _(t):
    return D.ecdf(t.events, "value")


@query("qq_points")
def _(t):
    return D.qq_points(t.events, "value")


@query("qq_grid")
def _(t):
    return D.qq_grid(t.events, "value")


@query(
    "sigma_intervals",
    f"""WITH l AS (SELECT * FROM {LONG}),
        m AS (SELECT column_name, avg(value) AS mean, stddev_samp(value) AS std FROM l GROUP BY 1)
        SELECT column_name, any_value(mean) AS mean, any_value(std) AS std,
          100.0 * avg(CASE WHEN abs(value - mean) <= std THEN 1 ELSE 0 END) AS within_1,
          100.0 * avg(CASE WHEN abs(value - mean) <= 2 * std THEN 1 ELSE 0 END) AS within_2,
          {q(0.01)} AS p1, {q(0.05)} AS p5, {q(0.25)} AS p25, {q(0.5)} AS p50, {q(0.75)} AS p75, {q(0.95)} AS p95,
          {q(0.99)} AS p99 FROM l JOIN m USING (column_name) GROUP BY 1""",
    approx=("mean", "std", "within_1", "within_2", "p1", "p5", "p25", "p50", "p75", "p95", "p99"),
)
def _(t):
    return D.sigma_intervals(t.lineitem, NUM)


@query(
    "kde_grid",
    """WITH c AS (SELECT value, count(*) AS cnt FROM events GROUP BY 1),
       b AS (SELECT count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi FROM events),
       g AS (SELECT CAST(unnest(range(100)) AS INTEGER) AS g),
       x AS (SELECT g, lo + (hi - lo) * g / 99 AS x, n, h FROM g, b)
       SELECT g, any_value(x) AS x,
         sum(cnt * exp(-0.5 * pow((x - value) / h, 2)) / (n * h * sqrt(2 * pi()))) AS density FROM x, c GROUP BY g""",
    approx=("x", "density"),
)
def _(t):
    return D.kde_grid(t.events, "value")


@query("bootstrap_ci")
def _(t):
    return D.bootstrap_ci(t.lineitem, "l_quantity", resamples=1000)


@query(
    "numeric_profile",
    f"""SELECT column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
        max(value) AS max, sum(value) AS total, skewness(value) AS skewness, kurtosis(value) AS kurtosis,
        count(*) FILTER (value = 0) AS zeros, count(*) FILTER (value < 0) AS negatives,
        count(*) FILTER (value > 0) AS positives, {q(0.25)} AS q25, {q(0.5)} AS median, {q(0.75)} AS q75
        FROM {long_sql("customer", ["c_acctbal", "c_nationkey"])} GROUP BY 1""",
    approx=("mean", "std", "total", "skewness", "kurtosis", "q25", "median", "q75"),
)
def _(t):
    return D.numeric_profile(t.customer, ["c_acctbal", "c_nationkey"])


@query(
    "text_profile",
    r"""SELECT count(*) AS n, min(length(text)) AS min_length, max(length(text)) AS max_length,
        avg(length(text)) AS avg_length, CAST(sum(length(text)) AS BIGINT) AS total_characters,
        CAST(sum(len(regexp_split_to_array(text, '\s+'))) AS BIGINT) AS word_count,
        avg(len(regexp_split_to_array(text, '\s+'))) AS avg_words FROM documents""",
    approx=("avg_length", "avg_words"),
)
def _(t):
    return D.text_profile(t.documents, "text").withColumns(
        {c: F.col(c).cast("long") for c in ("min_length", "max_length")}
    )


@query(
    "text_patterns",
    """WITH p AS (SELECT 'length_' || length(p_name) AS pattern FROM part UNION ALL
         SELECT 'starts_with_' || lower(substr(p_name, 1, 1)) FROM part WHERE length(p_name) > 0)
       SELECT pattern, count(*) AS cnt, 100.0 * count(*) / (SELECT count(*) FROM part) AS pct FROM p
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    approx=("pct",),
)
def _(t):
    return D.text_patterns(t.part, "p_name")


@query(
    "datetime_profile",
    """SELECT 'earliest' AS metric, strftime(min(o_orderdate), '%Y-%m-%d') AS value FROM orders
       UNION ALL SELECT 'latest', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders
       UNION ALL SELECT 'span_days', CAST(CAST(max(o_orderdate) AS DATE) - CAST(min(o_orderdate) AS DATE) AS VARCHAR) FROM orders
       UNION ALL SELECT 'first_year', CAST(min(year(o_orderdate)) AS VARCHAR) FROM orders
       UNION ALL SELECT 'last_year', CAST(max(year(o_orderdate)) AS VARCHAR) FROM orders
       UNION ALL SELECT 'month_' || month(o_orderdate), CAST(count(*) AS VARCHAR) FROM orders GROUP BY 1
       UNION ALL SELECT 'weekday_' || (isodow(o_orderdate) - 1), CAST(count(*) AS VARCHAR) FROM orders GROUP BY 1""",
)
def _(t):
    return D.datetime_profile(t.orders, "o_orderdate")


@query(
    "group_sum",
    """WITH s AS (SELECT c_mktsegment AS category, sum(c_acctbal) AS total FROM customer GROUP BY 1),
       a AS (SELECT sum(total) AS n, max(total) AS m, count(*) AS categories FROM s),
       r AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC) AS INTEGER) AS t,
             CAST(row_number() OVER (ORDER BY total) AS INTEGER) AS b FROM s)
       SELECT category, total, total / n * 100 AS pct, CASE WHEN t <= 3 THEN t END AS top_rank,
         CASE WHEN b <= 3 THEN b END AS bottom_rank, m / n AS concentration, categories FROM r, a""",
    approx=("total", "pct", "concentration"),
)
def _(t):
    return D.group_sum(t.customer, "c_mktsegment", "c_acctbal")


@query(
    "group_stats",
    """SELECT c_mktsegment, count(c_acctbal) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std,
         median(c_acctbal) AS median FROM customer GROUP BY 1""",
    approx=("mean", "std", "median"),
)
def _(t):
    return D.group_stats(t.customer, "c_mktsegment", "c_acctbal")


BOX = """
    WITH f AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
           quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
    g AS (SELECT *, q75 - q25 AS iqr, q25 - 1.5 * (q75 - q25) AS lower_fence, q75 + 1.5 * (q75 - q25) AS upper_fence FROM f),
    s AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
          max(value) AS max, skewness(value) AS skewness, kurtosis(value) AS kurtosis, var_samp(value) AS variance,
          stddev_samp(value) / avg(value) AS cv, max(value) - min(value) AS range FROM events GROUP BY 1),
    o AS (SELECT event_type, count(*) AS outliers FROM events JOIN g USING (event_type)
          WHERE value < lower_fence OR value > upper_fence GROUP BY 1),
    d AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k
          FROM (SELECT DISTINCT event_type, value FROM events) JOIN g USING (event_type)
          WHERE value < lower_fence OR value > upper_fence),
    v AS (SELECT event_type, array_to_string(list(value ORDER BY value), ',') AS outlier_values FROM d WHERE k <= 20 GROUP BY 1),
    b AS (SELECT g.*, s.* EXCLUDE (event_type), coalesce(outliers, 0) AS outliers, coalesce(outliers, 0) * 100.0 / n AS outlier_pct,
          outlier_values FROM g JOIN s USING (event_type) LEFT JOIN o USING (event_type) LEFT JOIN v USING (event_type))"""


@query(
    "box_stats",
    BOX + " SELECT * EXCLUDE (variance) FROM b",
    approx=(
        "q25", "median", "q75", "iqr", "lower_fence", "upper_fence", "mean", "std", "skewness", "kurtosis", "cv",
        "range", "outlier_pct",
    ),
)
def _(t):
    out = D.box_stats(t.events, "value", "event_type")
    return out.withColumn("outlier_values", F.array_join(F.col("outlier_values").cast("array<string>"), ","))


@query(
    "compare_groups",
    BOX
    + """ SELECT count(*) AS groups, max(median) - min(median) AS median_range, arg_max(event_type, median) AS highest_median,
      arg_min(event_type, median) AS lowest_median, arg_max(event_type, variance) AS most_variable,
      arg_min(event_type, variance) AS least_variable, arg_max(event_type, outlier_pct) AS highest_outlier,
      max(variance) / min(variance) AS variance_ratio FROM b""",
    approx=("median_range", "variance_ratio"),
)
def _(t):
    return D.compare_groups(t.events, "value", "event_type")


@query(
    "crosstab",
    """WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS cnt FROM lineitem GROUP BY 1, 2)
       SELECT *, cnt / sum(cnt) OVER (PARTITION BY l_returnflag) AS row_share FROM c""",
    approx=("row_share",),
)
def _(t):
    return D.crosstab(t.lineitem, "l_returnflag", "l_linestatus")


@query(
    "single_pass_stats",
    f"""SELECT column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
        max(value) AS max FROM {long_sql("orders", ["o_totalprice", "o_custkey"])} GROUP BY 1""",
    approx=("mean", "std"),
)
def _(t):
    return D.single_pass_stats(t.orders, ["o_totalprice", "o_custkey"])


@query(
    "target_analysis",
    """WITH c AS (SELECT o_orderstatus, count(*) AS cnt FROM orders GROUP BY 1)
       SELECT count(*) AS n_distinct, max(cnt) AS largest, min(cnt) AS smallest, 'categorical' AS type,
         CASE WHEN count(*) = 2 THEN 'binary' ELSE 'multiclass' END AS hint, max(cnt) / min(cnt) AS imbalance_ratio,
         count(*) > 1 AND max(cnt) / min(cnt) > 5 AS imbalanced FROM c""",
    approx=("imbalance_ratio",),
)
def _(t):
    return D.target_analysis(t.orders, "o_orderstatus")


@query(
    "target_analysis_numeric",
    """SELECT avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, min(l_quantity) AS min, max(l_quantity) AS max,
         count(DISTINCT l_quantity) AS n_distinct, 'numeric' AS type,
         CASE WHEN count(DISTINCT l_quantity) < 10 THEN 'classification' ELSE 'regression' END AS hint FROM lineitem""",
    approx=("mean", "std"),
)
def _(t):
    return D.target_analysis(t.lineitem, "l_quantity")
