"""Queries over whole-table profiles."""

from __future__ import annotations

from lodestat.operators import profile as P
from lodestat.plans.describe import SKEW_POP
from lodestat.plans.registry import LINEITEM_NULLS, long_sql, query

NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
METRICS = ["n", "missing", "mean", "std", "min", "max", "skewness", "kurtosis", "q25", "median", "q75", "outliers"]


@query(
    "profile",
    f"""WITH l AS (SELECT * FROM {long_sql(LINEITEM_NULLS, NUM)}),
        m AS (SELECT column_name, CAST(count(value) AS DOUBLE) AS n, CAST(count(*) - count(value) AS DOUBLE) AS missing, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
          max(value) AS max, {SKEW_POP} AS skewness, kurtosis_pop(value) AS kurtosis, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75 FROM l GROUP BY 1),
        o AS (SELECT column_name, CAST(count(*) FILTER (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS DOUBLE) AS outliers FROM l JOIN m USING (column_name) GROUP BY 1),
        w AS (SELECT * FROM m JOIN o USING (column_name))
        SELECT column_name, metric, value FROM (UNPIVOT w ON {", ".join(METRICS)} INTO NAME metric VALUE value)""",
    approx=("value",),
)
def _(t):
    return P.profile(t.lineitem_nulls, NUM)


@query("data_profile")
def _(t):
    return P.data_profile(t.customer)


@query(
    "dashboard_overview",
    f"""WITH f AS (SELECT column_name, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM {long_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"])} GROUP BY 1)
        SELECT '*' AS column_name, unnest(['rows', 'columns', 'numeric_columns', 'text_columns', 'datetime_columns', 'missing_pct', 'duplicates']) AS metric,
          unnest([CAST(count(*) AS DOUBLE), 5, 3, 2, 0, 0, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS DOUBLE)]) AS value FROM customer
        UNION ALL SELECT column_name, 'iqr_outliers', CAST(count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS DOUBLE)
          FROM {long_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"])} JOIN f USING (column_name) GROUP BY 1""",
    approx=("value",),
)
def _(t):
    return P.dashboard_overview(t.customer)


EV = ["event_id", "user_id", "value"]


@query(
    "insights",
    f"""WITH l AS (SELECT * FROM {long_sql("events", EV)}),
        m AS (SELECT column_name, {SKEW_POP} AS s, stddev_samp(value) / avg(value) AS cv, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM l GROUP BY 1),
        o AS (SELECT column_name, 100.0 * count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*) AS p FROM l JOIN m USING (column_name) GROUP BY 1),
        c AS (SELECT 'event_id|user_id' AS column_name, corr(event_id, user_id) AS r FROM events UNION ALL SELECT 'event_id|value', corr(event_id, value) FROM events UNION ALL SELECT 'user_id|value', corr(user_id, value) FROM events)
        SELECT 'high variation' AS type, column_name, abs(cv) AS value, 'medium' AS severity FROM m WHERE abs(cv) > 1
        UNION ALL SELECT 'skewed', column_name, s, CASE WHEN abs(s) > 2 THEN 'high' ELSE 'medium' END FROM m WHERE abs(s) > 1
        UNION ALL SELECT 'outliers', column_name, p, 'medium' FROM o WHERE p > 10
        UNION ALL SELECT 'multicollinearity', column_name, r, 'high' FROM c WHERE abs(r) > 0.9""",
    approx=("value",),
)
def _(t):
    return P.insights(t.events)
