"""Queries over the missing-data, quality and outlier operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import outliers as X
from lodestat.operators import quality as Q
from lodestat.plans.registry import LINEITEM_NULLS, ORDERS_DUP, long_sql, query

LI = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LI_TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"]
NULLS_IN_ROW = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in LI)
SUMMARY = f"""
    s AS (SELECT CAST(sum({NULLS_IN_ROW}) AS BIGINT) AS total_missing, count(*) * {len(LI)} AS total_cells, count(*) AS n,
      count(*) FILTER (({NULLS_IN_ROW}) = 0) AS complete_rows FROM {LINEITEM_NULLS} x)"""


@query(
    "missing_summary",
    f"""WITH {SUMMARY} SELECT total_missing, total_cells, round(total_missing / total_cells * 100, 2) AS missing_pct,
        complete_rows, round(complete_rows / n * 100, 2) AS complete_row_pct FROM s""",
)
def _(t):
    return Q.missing_summary(t.lineitem_nulls)


BY_COLUMN = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, count({c}) AS non_null_count,
        count(DISTINCT {c}) AS n_distinct, (count(*) - count({c})) / count(*) * 100 AS pct FROM {LINEITEM_NULLS} x"""
    for c, k in zip(LI, LI_TYPES)
)
SEVERITY = """CASE WHEN pct = 0 THEN 'none' WHEN pct < 5 THEN 'minor' WHEN pct < 15 THEN 'moderate'
    WHEN pct < 30 THEN 'severe' ELSE 'critical' END"""


@query("missing_by_column", f"SELECT * EXCLUDE (pct), {SEVERITY} AS severity FROM ({BY_COLUMN}) y")
def _(t):
    return Q.missing_by_column(t.lineitem_nulls)


@query(
    "missing_patterns",
    f"""WITH p AS (SELECT concat_ws(',', CASE WHEN l_quantity IS NULL THEN 'l_quantity' END,
          CASE WHEN l_returnflag IS NULL THEN 'l_returnflag' END) AS pattern, CAST({NULLS_IN_ROW} AS INTEGER) AS n_missing,
          count(*) AS cnt FROM {LINEITEM_NULLS} x GROUP BY 1, 2)
        SELECT pattern, n_missing, cnt, round(cnt / (SELECT sum(cnt) FROM p) * 100, 2) AS pct,
          CASE WHEN n_missing = 0 THEN 'complete' WHEN n_missing = 1 THEN 'only ' || pattern
          ELSE n_missing || ' columns: ' || replace(pattern, ',', ', ') END AS description
        FROM p ORDER BY cnt DESC, pattern LIMIT 10""",
)
def _(t):
    return Q.missing_patterns(t.lineitem_nulls)


@query(
    "suggest_imputation",
    f"""WITH b AS ({BY_COLUMN}), k AS (SELECT *, {SEVERITY} AS severity FROM b WHERE missing_count > 0),
        r AS (SELECT 'l_quantity' AS column_name, greatest({", ".join(f"abs(corr(l_quantity, {c}))" for c in LI[:8] if c != "l_quantity")}) > 0.7 AS linked
              FROM {LINEITEM_NULLS} x),
        m AS (SELECT column_name, unnest(CASE WHEN column_name = 'l_quantity'
             THEN ['median|high', 'mean|medium'] ELSE ['mode|high', 'own category|medium'] END) AS mp FROM k
             UNION ALL SELECT column_name, 'regression on correlated columns|high' FROM r WHERE linked)
        SELECT column_name, missing_pct, severity, missing_pct < 10 AS rows_may_be_dropped,
          n_distinct / non_null_count > 0.8 AS mostly_distinct, split_part(mp, '|', 1) AS method,
          split_part(mp, '|', 2) AS priority FROM k JOIN m USING (column_name)""",
)
def _(t):
    return Q.suggest_imputation(t.lineitem_nulls)


@query(
    "missing_grade",
    f"""WITH {SUMMARY}, p AS (SELECT round(total_missing / total_cells * 100, 2) AS missing_pct,
          round(complete_rows / n * 100, 2) AS complete_row_pct FROM s)
        SELECT *, round(greatest(0, 100 - missing_pct), 1) AS score,
          CASE WHEN missing_pct < 5 AND complete_row_pct > 80 THEN 'excellent' WHEN missing_pct < 15 AND complete_row_pct > 60
          THEN 'good' WHEN missing_pct < 30 THEN 'fair' ELSE 'needs work' END AS grade FROM p""",
)
def _(t):
    return Q.missing_grade(t.lineitem_nulls)


STATUS = """CASE WHEN completeness >= 95 THEN 'excellent' WHEN completeness >= 85 THEN 'good'
    WHEN completeness >= 70 THEN 'fair' ELSE 'needs work' END AS status"""


@query(
    "completeness",
    f"""WITH {SUMMARY}, b AS ({BY_COLUMN}),
        a AS (SELECT 'column' AS scope, column_name, round((1 - missing_count / (missing_count + non_null_count)) * 100, 2) AS completeness,
            missing_count FROM b
          UNION ALL SELECT 'table', '*', round((total_cells - total_missing) / total_cells * 100, 2), total_missing FROM s
          UNION ALL SELECT 'rows', '*', round(complete_rows / n * 100, 2), n - complete_rows FROM s)
        SELECT *, {STATUS} FROM a""",
    approx=("completeness",),
)
def _(t):
    return Q.completeness(t.lineitem_nulls)


ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
# orders with duplicates, one status in lower case and spaces, and negative prices
DIRTY = f"""(SELECT * REPLACE (
      CASE WHEN o_orderkey % 97 = 0 THEN lower(o_orderstatus) || ' ' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderkey % 101 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
      CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS o_orderpriority)
      FROM {ORDERS_DUP} x)"""


def dirty(t):
    key = F.col("o_orderkey")
    return t.orders_dup.withColumns(
        {
            "o_orderstatus": F.when(key % 97 == 0, F.concat(F.lower("o_orderstatus"), F.lit(" "))).otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(key % 101 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")),
            "o_orderpriority": F.when(key % 4 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")),
        }
    )


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
STRINGS = ["o_orderstatus", "o_orderpriority"]
ISSUES = f"""
    t AS (SELECT * FROM {DIRTY} d),
    dup AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS dups FROM t),
    num AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v, avg({c}) OVER () AS m, stddev_samp({c}) OVER () AS s FROM t" for c in ("o_orderkey", "o_custkey", "o_totalprice"))}),
    vals AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM t" for c in ORD)}),
    cnt AS (SELECT column_name, v, count(*) AS c FROM vals GROUP BY 1, 2),
    issues AS (
      SELECT 'consistency' AS dimension, 'duplicate rows' AS type, '*' AS column_name, least(20.0, dups / n * 200) AS penalty FROM dup WHERE dups > 0
      {" ".join(f"UNION ALL SELECT 'consistency', 'mixed types', '{c}', 5 FROM t HAVING count(*) FILTER (regexp_matches({c}, '{NUMBER}')) > 0 AND count(*) FILTER (regexp_matches({c}, '{NUMBER}')) < count(*) AND 1 - count(*) FILTER (regexp_matches({c}, '{NUMBER}')) / count(*) < 0.9" for c in STRINGS)}
      {" ".join(f"UNION ALL SELECT 'consistency', 'outer spaces', '{c}', 3 FROM t HAVING count(*) FILTER ({c} LIKE ' %' OR {c} LIKE '% ') > 0" for c in STRINGS)}
      {" ".join(f"UNION ALL SELECT 'consistency', 'letter case', '{c}', 3 FROM t HAVING count(DISTINCT {c}) <> count(DISTINCT lower({c}))" for c in STRINGS)}
      UNION ALL SELECT 'consistency', 'extreme values', column_name, 5 FROM num GROUP BY column_name
        HAVING count(*) FILTER (abs(v - m) > 3 * s) / count(*) > 0.05
      UNION ALL SELECT 'accuracy', 'negative values', 'o_totalprice', 8 FROM t HAVING count(*) FILTER (o_totalprice < 0) > 0
      UNION ALL SELECT 'accuracy', 'one value above 90 %', column_name, 5 FROM cnt GROUP BY column_name
        HAVING max(c) / sum(c) > 0.9 AND count(*) > 1
      UNION ALL SELECT 'validity', 'many zeros', 'o_totalprice', 10 FROM t HAVING count(*) FILTER (o_totalprice = 0) > count(*) * 0.1),
    dims AS (SELECT d.dimension, greatest(0, 100 - coalesce(sum(penalty), 0)) AS score, count(i.type) AS issues,
        coalesce(string_agg(column_name || ':' || type, ';' ORDER BY column_name || ':' || type), '') AS issue_list
      FROM (VALUES ('consistency'), ('accuracy'), ('validity')) d(dimension) LEFT JOIN issues i ON i.dimension = d.dimension GROUP BY 1)"""
SCORE_STATUS = "CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'needs work' END AS status"

for _name in ("consistency", "accuracy", "validity"):

    @query(_name, f"WITH {ISSUES} SELECT *, {SCORE_STATUS} FROM dims WHERE dimension = '{_name}'", approx=("score",))
    def _(t, name=_name):
        return getattr(Q, name)(dirty(t))


@query(
    "quality_score",
    f"""WITH {ISSUES}, w AS (SELECT 100.0 AS completeness, max(score) FILTER (dimension = 'consistency') AS consistency,
          max(score) FILTER (dimension = 'accuracy') AS accuracy, max(score) FILTER (dimension = 'validity') AS validity FROM dims),
        s AS (SELECT *, 0.3 * completeness + 0.25 * consistency + 0.3 * accuracy + 0.15 * validity AS o FROM w)
        SELECT CAST(round(completeness, 1) AS DOUBLE) AS completeness, CAST(round(consistency, 1) AS DOUBLE) AS consistency,
          CAST(round(accuracy, 1) AS DOUBLE) AS accuracy, CAST(round(validity, 1) AS DOUBLE) AS validity,
          CAST(round(o, 1) AS DOUBLE) AS overall,
          CASE WHEN o >= 90 THEN 'A' WHEN o >= 80 THEN 'B' WHEN o >= 70 THEN 'C' WHEN o >= 60 THEN 'D' ELSE 'F' END AS grade,
          concat_ws(',', CASE WHEN completeness < 80 THEN 'completeness' END, CASE WHEN consistency < 80 THEN 'consistency' END,
            CASE WHEN accuracy < 80 THEN 'accuracy' END, CASE WHEN validity < 80 THEN 'validity' END) AS improve FROM s""",
    approx=("completeness", "consistency", "accuracy", "validity", "overall"),
)
def _(t):
    return Q.quality_score(dirty(t))


CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
UNIQ = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) / count(*) AS r FROM customer" for c in CUST
)
POINTS = "CAST(CASE WHEN r = 1 THEN 100 WHEN r > 0.95 OR r < 0.1 THEN 80 ELSE 90 END AS INTEGER)"


@query(
    "uniqueness_score",
    f"""SELECT column_name, n_distinct, round(r, 4) AS unique_ratio, r = 1 AS is_identifier, r > 0.95 AS is_highly_unique,
        r < 0.1 AS is_low_cardinality, {POINTS} AS points FROM ({UNIQ}) u""",
)
def _(t):
    return Q.uniqueness_score(t.customer)


CUST_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]


@query(
    "uniqueness_weighted_score",
    f"""WITH l AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM {long_sql("customer", CUST_NUM)}
          WINDOW w AS (PARTITION BY column_name)),
        b AS (SELECT column_name, count(*) FILTER (abs(value - m) > 3 * s) AS x FROM l GROUP BY 1),
        v AS (SELECT 100.0 AS completeness, 100.0 AS consistency, greatest(0, 100.0 - 10 * count(*) FILTER (x > 0)) AS validity FROM b),
        u AS (SELECT avg({POINTS}) AS uniqueness FROM ({UNIQ}) q)
        SELECT CAST(completeness AS DOUBLE) AS completeness, CAST(consistency AS DOUBLE) AS consistency,
          CAST(validity AS DOUBLE) AS validity, uniqueness,
          0.3 * completeness + 0.2 * consistency + 0.3 * validity + 0.2 * uniqueness AS overall FROM v, u""",
    approx=("completeness", "consistency", "validity", "uniqueness", "overall"),
)
def _(t):
    return Q.uniqueness_weighted_score(t.customer)


@query(
    "load_quality",
    f"""WITH t AS (SELECT * FROM {ORDERS_DUP} x),
        d AS (SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / count(*) * 100 AS duplicate_pct FROM t)
        SELECT 0.0 AS missing_pct, duplicate_pct, 1.0 AS type_consistency,
          CAST(100 - CASE WHEN duplicate_pct > 10 THEN 15 ELSE 0 END AS INTEGER) AS score FROM d""",
    approx=("missing_pct", "duplicate_pct", "type_consistency"),
)
def _(t):
    return Q.load_quality(t.orders_dup)


COLS = ["l_quantity", "l_extendedprice"]
EV = ["value", "user_id"]
FENCES = f"""f AS (SELECT column_name, count(value) AS n, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
    FROM {long_sql("events", EV)} GROUP BY 1),
  g AS (SELECT *, q75 - q25 AS iqr, q25 - 1.5 * (q75 - q25) AS lower_fence, q75 + 1.5 * (q75 - q25) AS upper_fence FROM f)"""


@query(
    "outliers_iqr",
    f"""WITH {FENCES} SELECT g.*, c.* EXCLUDE (column_name), outliers / n * 100 AS outlier_pct FROM g JOIN
        (SELECT column_name, count(*) FILTER (value < lower_fence) AS low_outliers, count(*) FILTER (value > upper_fence) AS high_outliers,
         count(*) FILTER (value < lower_fence OR value > upper_fence) AS outliers
         FROM {long_sql("events", EV)} JOIN g USING (column_name) GROUP BY 1) c USING (column_name)""",
    approx=("q25", "q75", "iqr", "lower_fence", "upper_fence", "outlier_pct"),
)
def _(t):
    return X.outliers_iqr(t.events, EV)


FLAGS = """
    c AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, avg(value) AS m, stddev_samp(value) AS s,
          median(value) AS med, quantile_cont(user_id, 0.25) AS ua, quantile_cont(user_id, 0.75) AS ub, avg(user_id) AS um,
          stddev_samp(user_id) AS us, median(user_id) AS umed FROM events),
    d AS (SELECT median(abs(value - med)) AS mad, median(abs(user_id - umed)) AS umad FROM events, c),
    fl AS (SELECT e.*,
        ((b - a) > 0 AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))) OR
        ((ub - ua) > 0 AND (user_id < ua - 1.5 * (ub - ua) OR user_id > ub + 1.5 * (ub - ua))) AS is_iqr,
        greatest(abs(value - m) / s, abs(user_id - um) / us) > 3 AS is_zscore,
        greatest(abs(0.6745 * (value - med) / mad), abs(0.6745 * (user_id - umed) / umad)) > 3.5 AS is_modified_z
      FROM events e, c, d)"""


@query("outlier_rows_iqr", f"WITH {FLAGS} SELECT event_id, value, user_id FROM fl WHERE is_iqr")
def _(t):
    return X.flag_iqr(t.events, EV).where("is_iqr").select("event_id", "value", "user_id")


@query(
    "outliers_zscore",
    f"""WITH l AS (SELECT * FROM {long_sql("events", EV)}),
        b AS (SELECT column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM l GROUP BY 1)
        SELECT column_name, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std,
          count(*) FILTER (abs(value - mean) / std > 3) AS outliers, max(abs(value - mean) / std) AS max_z,
          100.0 * count(*) FILTER (abs(value - mean) / std > 3) / any_value(n) AS outlier_pct
        FROM l JOIN b USING (column_name) GROUP BY 1""",
    approx=("mean", "std", "max_z", "outlier_pct"),
)
def _(t):
    return X.outliers_zscore(t.events, EV)


@query(
    "outliers_modified_z",
    f"""WITH l AS (SELECT * FROM {long_sql("events", EV)}),
        m AS (SELECT column_name, median(value) AS median FROM l GROUP BY 1),
        d AS (SELECT column_name, any_value(median) AS median, median(abs(value - median)) AS mad FROM l JOIN m USING (column_name) GROUP BY 1)
        SELECT column_name, any_value(median) AS median, any_value(mad) AS mad, count(value) AS n,
          count(*) FILTER (abs(0.6745 * (value - median) / mad) > 3.5) AS outliers,
          100.0 * count(*) FILTER (abs(0.6745 * (value - median) / mad) > 3.5) / count(value) AS outlier_pct
        FROM l JOIN d USING (column_name) GROUP BY 1""",
    approx=("median", "mad", "outlier_pct"),
)
def _(t):
    return X.outliers_modified_z(t.events, EV)


@query(
    "outlier_consensus",
    f"""WITH {FLAGS}, v AS (SELECT *, CAST(is_iqr AS INTEGER) + CAST(is_zscore AS INTEGER) + CAST(is_modified_z AS INTEGER) AS votes FROM fl)
        SELECT votes, votes >= 2 AS consensus, votes = 3 AS unanimous, count(*) AS n_rows, count(*) FILTER (is_iqr) AS is_iqr,
          count(*) FILTER (is_zscore) AS is_zscore, count(*) FILTER (is_modified_z) AS is_modified_z FROM v GROUP BY 1, 2, 3""",
)
def _(t):
    return X.outlier_consensus(t.events, EV)


@query(
    "intersect_outliers",
    f"WITH {FLAGS} SELECT event_id, value FROM fl WHERE is_iqr AND is_zscore AND is_modified_z",
)
def _(t):
    return X.intersect_outliers(t.events, EV).select("event_id", "value")


def impact(flag, col):
    return f"""SELECT '{flag[3:]}' AS method, '{col}' AS column_name, count(*) FILTER ({flag}) AS n_outliers,
      avg({col}) FILTER ({flag}) AS outlier_mean, avg({col}) FILTER (NOT {flag}) AS normal_mean,
      abs(avg({col}) FILTER ({flag}) - avg({col}) FILTER (NOT {flag})) / stddev_samp({col}) FILTER (NOT {flag}) AS effect_size
      FROM fl HAVING count(*) FILTER ({flag}) > 0"""


@query(
    "outlier_impact",
    f"WITH {FLAGS} " + " UNION ALL ".join(impact(f, c) for f in ("is_iqr", "is_zscore", "is_modified_z") for c in EV),
    approx=("outlier_mean", "normal_mean", "effect_size"),
)
def _(t):
    return X.outlier_impact(t.events, EV)


@query(
    "infinite_and_extreme",
    f"""WITH l AS (SELECT column_name, CASE WHEN value > 300 THEN 'infinity'::DOUBLE ELSE value END AS value
          FROM {long_sql("events", EV)}),
        i AS (SELECT column_name, count(*) FILTER (isinf(value)) AS infinite FROM l GROUP BY 1),
        b AS (SELECT column_name, avg(value) AS m, stddev_samp(value) AS s FROM l WHERE column_name = 'user_id' GROUP BY 1)
        SELECT i.column_name, infinite, CASE WHEN i.column_name = 'user_id' THEN
          (SELECT count(*) FROM l JOIN b USING (column_name) WHERE abs(value - m) > 3 * s) ELSE 0 END AS extreme FROM i""",
)
def _(t):
    x = F.when(F.col("value") > 300, F.lit(float("inf"))).otherwise(F.col("value"))
    return X.infinite_and_extreme(t.events.withColumn("value", x), EV)
