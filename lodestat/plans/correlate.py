"""Queries over the correlation operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from lodestat.operators import correlate as R
from lodestat.plans.registry import LINEITEM_NULLS, query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pearson_sql(table, cols):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, coalesce(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE corr({a}, {b}) END, 0) AS r,
            count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, regr_slope({b}, {a}) AS slope,
            regr_intercept({b}, {a}) AS intercept FROM {table} x"""
        for a, b in combinations(cols, 2)
    )


# two products of other columns, so that some pairs are strong
WIDE = f"(SELECT *, l_extendedprice * (1 - l_discount) AS revenue, l_quantity * l_tax AS levy FROM {LINEITEM_NULLS} z)"
MORE = [*NUM, "revenue", "levy"]
PW = f"p AS ({pearson_sql(WIDE, MORE)})"


def wide(t):
    return t.lineitem_nulls.withColumns({"revenue": F.col("l_extendedprice") * (1 - F.col("l_discount")), "levy": F.col("l_quantity") * F.col("l_tax")})


P = f"p AS ({pearson_sql(LINEITEM_NULLS, NUM)})"


@query("corr_pearson", f"WITH {P} SELECT column_a, column_b, r, n FROM p", approx=("r",))
def _(t):
    return R.corr_pearson(t.lineitem_nulls, NUM)


def spearman_sql(table, cols):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, corr(rx, ry) AS r, count(*) AS n FROM (
            SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS rx,
              rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS ry
            FROM {table} x WHERE {a} IS NOT NULL AND {b} IS NOT NULL) z"""
        for a, b in combinations(cols, 2)
    )


@query("corr_spearman", spearman_sql(LINEITEM_NULLS, NUM[:3]), approx=("r",))
def _(t):
    return R.corr_spearman(t.lineitem_nulls, NUM[:3])


KENDALL = """
    WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS w FROM lineitem GROUP BY 1, 2),
    s AS (SELECT sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b),
    n AS (SELECT sum(w) AS n FROM c),
    tx AS (SELECT sum(k * (k - 1) / 2) AS tx FROM (SELECT sum(w) AS k FROM c GROUP BY x) q),
    ty AS (SELECT sum(k * (k - 1) / 2) AS ty FROM (SELECT sum(w) AS k FROM c GROUP BY y) q)
    SELECT 'l_quantity' AS column_a, 'l_discount' AS column_b,
      s / (sqrt(n * (n - 1) / 2 - tx) * sqrt(n * (n - 1) / 2 - ty)) AS r, CAST(n AS BIGINT) AS n FROM s, n, tx, ty"""


@query("corr_kendall", KENDALL, approx=("r",))
def _(t):
    return R.corr_kendall(t.lineitem, ["l_quantity", "l_discount"])


STRENGTH = """CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate'
    WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'very weak' END"""


@query(
    "strong_pairs",
    f"""WITH {PW} SELECT column_a, column_b, r, n, {STRENGTH} AS strength,
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM p WHERE abs(r) >= 0.3""",
    approx=("r",),
)
def _(t):
    return R.strong_pairs(wide(t), MORE, threshold=0.3)


@query(
    "corr_summary",
    f"""WITH {PW} SELECT avg(r) AS mean, median(r) AS median, stddev_samp(r) AS std, min(r) AS min, max(r) AS max,
        avg(abs(r)) AS abs_mean, {", ".join(f"count(*) FILTER ({STRENGTH} = '{s}') AS {s.replace(' ', '_')}" for s in ("very strong", "strong", "moderate", "weak", "very weak"))},
        arg_max(column_a || '|' || column_b, abs(r)) AS max_pair FROM p""",
    approx=("mean", "median", "std", "min", "max", "abs_mean"),
)
def _(t):
    return R.corr_summary(wide(t), MORE)


@query(
    "corr_network",
    f"""WITH {PW} SELECT column_a AS source, column_b AS target, r, 5 * abs(r) AS weight,
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign FROM p WHERE abs(r) >= 0.3""",
    approx=("r", "weight"),
)
def _(t):
    return R.corr_network(wide(t), MORE)


@query(
    "top_pair_fits",
    f"WITH {PW} SELECT column_a, column_b, r, slope, intercept FROM p ORDER BY abs(r) DESC LIMIT 4",
    approx=("r", "slope", "intercept"),
)
def _(t):
    return R.top_pair_fits(wide(t), MORE)


@query(
    "feature_interactions",
    f"""WITH {PW} SELECT column_a, column_b, r, n, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS kind
        FROM p WHERE abs(r) > 0.5""",
    approx=("r",),
)
def _(t):
    return R.feature_interactions(wide(t), MORE, top_n=6)


@query("corr_test")
def _(t):
    out = R.corr_test(t.lineitem, "l_quantity", "l_discount")
    out = out.unionByName(R.corr_test(t.lineitem, "l_quantity", "l_discount", "spearman"))
    return out.unionByName(R.corr_test(t.lineitem, "l_quantity", "l_discount", "kendall"))


@query(
    "residual_fit",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
         regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem),
       e AS (SELECT f.*, l_extendedprice - slope * l_quantity - intercept AS e FROM lineitem, f)
       SELECT any_value(slope) AS slope, any_value(intercept) AS intercept, any_value(r2) AS r2, sqrt(avg(e * e)) AS rmse,
         avg(abs(e)) AS mae, round(avg(e), 4) + 0.0 AS residual_mean, stddev_pop(e) AS residual_std FROM e""",
    approx=("slope", "intercept", "r2", "rmse", "mae", "residual_mean", "residual_std"),
)
def _(t):
    return R.residual_fit(t.lineitem, "l_quantity", "l_extendedprice").withColumn("residual_mean", F.round("residual_mean", 4))
