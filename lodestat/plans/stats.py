"""Queries over the hypothesis tests and Bayesian operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.functions.columns import NORMAL_BOTTOM, NORMAL_TOP
from lodestat.operators import stats as H
from lodestat.plans.registry import query


def horner(coefs, x):
    out = str(coefs[0])
    for k in coefs[1:]:
        out = f"({out} * {x} + {k})"
    return out


def tail_sql(z):
    x = f"abs({z})"
    return f"""(CASE WHEN {x} < 7.07106781186547 THEN exp(-{x} * {x} / 2) * {horner(NORMAL_TOP, x)} / {horner(NORMAL_BOTTOM, x)}
      ELSE exp(-{x} * {x} / 2) / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65))))) / 2.506628274631 END)"""


def cdf_sql(z):
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail_sql(z)} ELSE {tail_sql(z)} END)"


def ks_p_sql(lam):
    return f"""(CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101),
      lambda i: (CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * i * i * {lam} * {lam}))))) END)"""


AB = "(SELECT CASE event_type WHEN 'purchase' THEN 'a' WHEN 'signup' THEN 'b' END AS g, value FROM events WHERE event_type IN ('purchase', 'signup'))"
GROUPS = ("event_type", "value", "purchase", "signup")

T_SQL = f"""WITH s AS (SELECT count(*) FILTER (g = 'a') AS n_a, count(*) FILTER (g = 'b') AS n_b, avg(value) FILTER (g = 'a') AS mean_a,
    avg(value) FILTER (g = 'b') AS mean_b, var_samp(value) FILTER (g = 'a') AS va, var_samp(value) FILTER (g = 'b') AS vb FROM {AB} q)"""


@query(
    "t_test_ind",
    T_SQL
    + """ SELECT n_a, n_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)) AS statistic,
      CAST(n_a + n_b - 2 AS DOUBLE) AS dof FROM s""",
    approx=("mean_a", "mean_b", "statistic", "dof"),
)
def _(t):
    return H.t_test_ind(t.events, *GROUPS).drop("p_value")


@query(
    "t_test_welch",
    T_SQL
    + """ SELECT n_a, n_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(va / n_a + vb / n_b) AS statistic,
      pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) AS dof FROM s""",
    approx=("mean_a", "mean_b", "statistic", "dof"),
)
def _(t):
    return H.t_test_ind(t.events, *GROUPS, equal_var=False).drop("p_value")


@query("t_test_p_values")
def _(t):
    a = H.t_test_ind(t.events, *GROUPS).select(F.lit("student").alias("test"), "statistic", "dof", "p_value")
    b = H.t_test_ind(t.events, *GROUPS, equal_var=False).select(F.lit("welch").alias("test"), "statistic", "dof", "p_value")
    return a.unionByName(b)


@query(
    "t_test_paired",
    """SELECT count(*) AS n, avg(l_discount - l_tax) AS mean, stddev_samp(l_discount - l_tax) AS std,
       avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS dof FROM lineitem""",
    approx=("mean", "std", "statistic", "dof"),
)
def _(t):
    return H.t_test_paired(t.lineitem, "l_discount", "l_tax").drop("p_value")


@query(
    "t_test_one_sample",
    """SELECT count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, (avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))) AS statistic,
       CAST(count(*) - 1 AS DOUBLE) AS dof FROM events""",
    approx=("mean", "std", "statistic", "dof"),
)
def _(t):
    return H.t_test_one_sample(t.events, "value", 50.0).drop("p_value")


RANKED = "rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"


@query(
    "mann_whitney",
    f"""WITH r AS (SELECT g, value, {RANKED.format(v='value')} AS r FROM {AB} q),
        t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY value) z),
        s AS (SELECT count(*) FILTER (g = 'a') AS n_a, count(*) FILTER (g = 'b') AS n_b, sum(r) FILTER (g = 'a') AS ra FROM r),
        u AS (SELECT n_a, n_b, ra - CAST(n_a AS DOUBLE) * (n_a + 1) / 2 AS statistic, CAST(n_a AS DOUBLE) AS x, CAST(n_b AS DOUBLE) AS y, ties FROM s, t),
        z AS (SELECT n_a, n_b, statistic, greatest(abs(statistic - x * y / 2) - 0.5, 0) /
          sqrt(x * y / 12 * (x + y + 1 - ties / ((x + y) * (x + y - 1)))) AS z FROM u)
        SELECT *, least(1.0, 2 * {tail_sql('z')}) AS p_value FROM z""",
    approx=("statistic", "z", "p_value"),
)
def _(t):
    return H.mann_whitney(t.events, *GROUPS)


@query(
    "wilcoxon_signed_rank",
    f"""WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem WHERE l_discount - l_tax <> 0),
        r AS (SELECT d, abs(d) AS v, {RANKED.format(v='abs(d)')} AS r FROM d),
        t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY v) z),
        s AS (SELECT count(*) AS n, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS w FROM r),
        z AS (SELECT n, w AS statistic, (w - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, t)
        SELECT *, least(1.0, 2 * {tail_sql('z')}) AS p_value FROM z""",
    approx=("z", "p_value"),
)
def _(t):
    return H.wilcoxon_signed_rank(t.lineitem, "l_discount", "l_tax")


CHI = """WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} GROUP BY 1, 2),
    ra AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), cb AS (SELECT b, sum(o) AS k FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c),
    g AS (SELECT ra.a, cb.b, coalesce(o, 0) AS o, r * k / n AS e, n FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN c ON c.a = ra.a AND c.b = cb.b)"""


@query(
    "chi_square",
    CHI.format(a="l_returnflag", b="l_linenumber", t="lineitem")
    + """ SELECT CAST(max(n) AS BIGINT) AS n, sum(pow(o - e, 2) / e) AS statistic,
      CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS DOUBLE) AS dof FROM g""",
    approx=("statistic", "dof"),
)
def _(t):
    return H.chi_square(t.lineitem, "l_returnflag", "l_linenumber").drop("p_value")


@query(
    "chi_square_yates",
    CHI.format(a="l_linestatus", b="l_quantity > 25", t="lineitem")
    + """ SELECT CAST(max(n) AS BIGINT) AS n, sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS statistic, CAST(1 AS DOUBLE) AS dof FROM g""",
    approx=("statistic", "dof"),
)
def _(t):
    return H.chi_square(t.lineitem.withColumn("big", F.col("l_quantity") > 25), "l_linestatus", "big").drop("p_value")


@query(
    "chi_square_cells",
    CHI.format(a="l_returnflag", b="l_linestatus", t="lineitem") + " SELECT a, b, CAST(o AS BIGINT) AS observed, e AS expected FROM g WHERE o > 0",
    approx=("expected",),
)
def _(t):
    return H.chi_square_cells(t.lineitem, "l_returnflag", "l_linestatus")


# the hypergeometric probabilities of all tables with the same margins, those not likelier than the given one summed
@query(
    "fisher_exact",
    """WITH e AS (SELECT event_type = 'purchase' AS a, value > 50 AS b FROM events WHERE event_type IN ('purchase', 'signup')),
        s AS (SELECT count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM e),
        m AS (SELECT *, n11 + n10 AS r, n11 + n01 AS c, n11 + n10 + n01 + n00 AS n FROM s),
        k AS (SELECT *, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) AS k FROM m),
        p AS (SELECT *, lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + lgamma(n - c + 1) - lgamma(r - k + 1) - lgamma(n - c - r + k + 1)
          - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1) AS lp FROM k),
        o AS (SELECT lp AS here FROM p WHERE k = n11)
        SELECT n11, n10, n01, n00, CAST(n11 * n00 AS DOUBLE) / (n10 * n01) AS odds_ratio, least(1.0, sum(exp(lp)) FILTER (lp <= here + 1e-7)) AS p_value FROM p, o GROUP BY n11, n10, n01, n00""",
    approx=("odds_ratio", "p_value"),
)
def _(t):
    e = t.events.where(F.col("event_type").isin("purchase", "signup"))
    return H.fisher_exact(e.withColumns({"is_a": F.col("event_type") == "purchase", "hit": F.col("value") > 50}), "is_a", "hit")


ANOVA = """WITH x AS (SELECT {g} AS g, {v} AS v FROM {t} q), m AS (SELECT g, count(*) AS n, avg(v) AS m FROM x GROUP BY 1),
    a AS (SELECT avg(v) AS gm, count(*) AS n FROM x),
    b AS (SELECT sum(m.n * pow(m.m - gm, 2)) AS ssb, count(*) AS k FROM m, a),
    w AS (SELECT sum(pow(v - m.m, 2)) AS ssw FROM x JOIN m USING (g))"""


@query(
    "anova_one_way",
    ANOVA.format(g="event_type", v="value", t="events")
    + """ SELECT n, ssb / (k - 1) / (ssw / (n - k)) AS statistic, CAST(k - 1 AS DOUBLE) AS dof_between, CAST(n - k AS DOUBLE) AS dof_within FROM a, b, w""",
    approx=("statistic", "dof_between", "dof_within"),
)
def _(t):
    return H.anova_one_way(t.events, "event_type", "value").drop("p_value")


@query(
    "kruskal_wallis",
    f"""WITH r AS (SELECT event_type AS g, value, {RANKED.format(v='value')} AS r FROM events),
        t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY value) z),
        s AS (SELECT g, sum(r) AS sr, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY 1),
        a AS (SELECT sum(sr * sr / c) AS q, count(*) AS k, sum(c) AS n FROM s)
        SELECT CAST(n AS BIGINT) AS n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS statistic, CAST(k - 1 AS DOUBLE) AS dof FROM a, t""",
    approx=("statistic", "dof"),
)
def _(t):
    out = H.kruskal_wallis(t.events, "event_type", "value").drop("p_value")
    return out


@query("normality")
def _(t):
    return H.normality(t.events, "value")


KSN = f"""WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM events),
    c AS (SELECT value, count(*) AS c FROM events GROUP BY 1),
    e AS (SELECT value, c, sum(c) OVER (ORDER BY value) - c AS lo, sum(c) OVER (ORDER BY value) AS hi FROM c),
    f AS (SELECT e.*, n, (value - m) / s AS z FROM e, m)"""


@query(
    "ks_normal",
    KSN
    + f""", d AS (SELECT any_value(n) AS n, max(greatest(hi / n - {cdf_sql('z')}, {cdf_sql('z')} - lo / n)) AS statistic FROM f)
      SELECT n, statistic, {ks_p_sql('(sqrt(n) * statistic)')} AS p_value FROM d""",
    approx=("statistic", "p_value"),
)
def _(t):
    return H.ks_normal(t.events, "value")


@query(
    "anderson_darling",
    KSN
    + f""", d AS (SELECT any_value(n) AS n, sum((CAST(hi AS DOUBLE) * hi - CAST(lo AS DOUBLE) * lo) * ln({cdf_sql('z')}) +
        (CAST(n - lo AS DOUBLE) * (n - lo) - CAST(n - hi AS DOUBLE) * (n - hi)) * ln({cdf_sql('(-z)')})) AS t FROM f),
      a AS (SELECT n, -n - t / n AS statistic, 0.752 / (1 + 0.75 / n + 2.25 / n / n) AS critical_5 FROM d)
      SELECT *, statistic < critical_5 AS normal FROM a""",
    approx=("statistic", "critical_5"),
)
def _(t):
    return H.anderson_darling(t.events, "value")


@query("dagostino_pearson")
def _(t):
    return H.dagostino_pearson(t.events, "value").unionByName(H.dagostino_pearson(t.lineitem, "l_quantity"))


@query("shapiro_wilk")
def _(t):
    return H.shapiro_wilk(t.supplier, "s_acctbal")


MED = "(SELECT event_type, abs(value - med) AS d FROM events JOIN (SELECT event_type, median(value) AS med FROM events GROUP BY 1) USING (event_type))"


@query(
    "variance_equality",
    ANOVA.format(g="event_type", v="d", t=MED)
    + """, p AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, var_samp(value) AS v FROM events GROUP BY 1),
      q AS (SELECT sum(n) AS n, CAST(count(*) AS DOUBLE) AS k, sum((n - 1) * v) AS pooled, sum((n - 1) * ln(v)) AS logs, sum(1 / (n - 1)) AS inv FROM p)
      SELECT 'levene' AS test, ssb / (k - 1) / (ssw / (n - k)) AS statistic, CAST(k - 1 AS DOUBLE) AS dof FROM a, b, w
      UNION ALL SELECT 'bartlett', ((n - k) * ln(pooled / (n - k)) - logs) / (1 + (inv - 1 / (n - k)) / (3 * (k - 1))), k - 1 FROM q""",
    approx=("statistic", "dof"),
)
def _(t):
    return H.variance_equality(t.events, "event_type", "value").drop("p_value")


# p-value-like shares by order, to adjust a table that grows with the data
PS = "(SELECT l_orderkey, avg(l_discount) AS p FROM lineitem GROUP BY 1)"


def share_table(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.avg("l_discount"), 12).alias("p"))


PS = "(SELECT l_orderkey, round(avg(l_discount), 12) AS p FROM lineitem GROUP BY 1)"


@query(
    "bonferroni",
    f"SELECT l_orderkey, p, least(1.0, p * (SELECT count(*) FROM {PS} y)) AS p_adjusted, least(1.0, p * (SELECT count(*) FROM {PS} y)) < 0.05 AS significant FROM {PS} x",
    approx=("p", "p_adjusted"),
)
def _(t):
    return H.bonferroni(share_table(t), "p")


@query(
    "fdr_bh",
    f"""WITH r AS (SELECT l_orderkey, p, row_number() OVER (ORDER BY p, l_orderkey) AS k, count(*) OVER () AS n FROM {PS} x),
        q AS (SELECT *, least(1.0, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adjusted FROM r)
        SELECT l_orderkey, p, p_adjusted, p_adjusted < 0.05 AS significant FROM q""",
    approx=("p", "p_adjusted"),
)
def _(t):
    return H.fdr_bh(share_table(t), "p", ["l_orderkey"])


@query(
    "ks_two_sample",
    f"""WITH c AS (SELECT value, count(*) FILTER (g = 'a') AS a, count(*) FILTER (g = 'b') AS b FROM {AB} q GROUP BY 1),
        n AS (SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM c),
        e AS (SELECT abs(sum(a) OVER (ORDER BY value) / n_a - sum(b) OVER (ORDER BY value) / n_b) AS d, n_a, n_b FROM c, n),
        s AS (SELECT max(d) AS statistic, any_value(n_a) AS n_a, any_value(n_b) AS n_b FROM e)
        SELECT *, {ks_p_sql('(sqrt(CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)) * statistic)')} AS p_value FROM s""",
    approx=("statistic", "p_value"),
)
def _(t):
    return H.ks_test(t.events, *GROUPS)


@query(
    "beta_binomial",
    """WITH s AS (SELECT event_type, count(*) FILTER (value > 50) AS successes, count(*) AS trials FROM events GROUP BY 1),
       p AS (SELECT *, CAST(1 + successes AS DOUBLE) AS alpha, CAST(1 + trials - successes AS DOUBLE) AS beta FROM s)
       SELECT *, alpha / (alpha + beta) AS mean, alpha * beta / (pow(alpha + beta, 2) * (alpha + beta + 1)) AS variance FROM p""",
    approx=("alpha", "beta", "mean", "variance"),
)
def _(t):
    return H.beta_binomial(t.events, "event_type", F.col("value") > 50).drop("low", "high")


@query("beta_binomial_interval")
def _(t):
    return H.beta_binomial(t.events, "event_type", F.col("value") > 50)


@query(
    "normal_normal",
    """WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS sample_mean, stddev_samp(value) AS sample_std FROM events GROUP BY 1),
       p AS (SELECT *, (0.01 * 50 + n / pow(sample_std, 2) * sample_mean) / (0.01 + n / pow(sample_std, 2)) AS posterior_mean,
         sqrt(1 / (0.01 + n / pow(sample_std, 2))) AS posterior_std FROM s)
       SELECT *, posterior_mean - 1.96 * posterior_std AS low, posterior_mean + 1.96 * posterior_std AS high FROM p""",
    approx=("sample_mean", "sample_std", "posterior_mean", "posterior_std", "low", "high"),
)
def _(t):
    return H.normal_normal(t.events, "event_type", "value", 50.0, 10.0)


@query("ab_test_bayes")
def _(t):
    return H.ab_test_bayes(t.events, "event_type", F.col("value") > 50, "purchase", "signup")
