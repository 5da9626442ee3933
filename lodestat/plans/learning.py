"""Queries over features, clustering and supervised learning."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import functions as F

from lodestat.operators import cluster as I
from lodestat.operators import features as G
from lodestat.operators import inspection as X
from lodestat.operators import supervised as J
from lodestat.operators import ward
from lodestat.plans.registry import long_sql, query
from lodestat.session import scratch_folder

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber"]


def li(t):
    return t.lineitem.select(*KEY, *NUM)


def scaled_sql(expr):
    cols = ", ".join(f"round({expr.format(c=c)}, 6) + 0.0 AS {c}" for c in NUM)
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM lineitem"


STD = "({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"
MINMAX = "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
ROBUST = "({c} - (SELECT median({c}) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"

for _n, _e in (("standard", STD), ("minmax", MINMAX), ("robust", ROBUST)):

    @query(f"scale_{_n}", scaled_sql(_e))
    def _(t, scale=G.SCALERS[_n]):
        return scale(li(t), NUM).withColumns({c: F.round(c, 6) + 0.0 for c in NUM})


def raw_sql(expr):
    return "SELECT " + ", ".join(f"{expr.format(c=c)} AS {c}" for c in NUM) + " FROM lineitem"


def stat_sql(table, name):
    return f"SELECT column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, '{name}' AS scaling FROM {long_sql(table, NUM)} GROUP BY 1"


@query(
    "compare_scaling",
    " UNION ALL ".join(stat_sql("lineitem" if e is None else f"({raw_sql(e)})", n) for n, e in (("none", None), ("standard", STD), ("minmax", MINMAX), ("robust", ROBUST))),
    approx=("mean", "std", "min", "max"),
)
def _(t):
    return G.compare_scaling(li(t), NUM)


@query("encode_label", "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'missing')) - 1 AS o_orderpriority_code FROM orders")
def _(t):
    return G.encode_label(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query(
    "encode_onehot",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O",
       CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P", CAST(o_orderstatus IS NULL AS INTEGER) AS o_orderstatus_null FROM orders""",
)
def _(t):
    return G.encode_onehot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", null_indicator=True)


@query(
    "encode_onehot_many",
    "SELECT c_custkey, " + ", ".join(f'CAST(c_nationkey = {i} AS INTEGER) AS "c_nationkey_{i}"' for i in range(25)) + " FROM customer",
)
def _(t):
    return G.encode_onehot(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey")


@query(
    "encode_onehot_long",
    "SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS \"index\", CAST(o_custkey AS VARCHAR) AS value, CAST(1 AS INTEGER) AS flag FROM orders",
)
def _(t):
    return G.encode_onehot_long(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey")


SIX = [*NUM, "l_partkey", "l_suppkey"]
POLY = {(f"{a}_sq" if a == b else f"{a}_x_{b}"): f"CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE)" for a, b in combinations_with_replacement(SIX, 2)}


@query(
    "polynomial",
    f"SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in POLY.items())} FROM lineitem",
)
def _(t):
    return G.polynomial(t.lineitem.select(*KEY, *SIX), SIX).drop(*SIX)


INTER = {f"{a}_x_{b}": f"CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE)" for a, b in combinations(SIX, 2)}


@query("interactions", f"SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in INTER.items())} FROM lineitem")
def _(t):
    return G.interactions(t.lineitem.select(*KEY, *SIX), SIX).drop(*SIX)


RANKED = "SELECT column_name, score, d1, d2, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, column_name) AS INTEGER) AS rank, row_number() OVER (ORDER BY score DESC NULLS LAST, column_name) <= 2 AS selected FROM s"
LF = long_sql("lineitem", NUM, ["l_returnflag"])


@query(
    "select_k_best_f_classif",
    f"""WITH l AS (SELECT * FROM {LF}), m AS (SELECT column_name, l_returnflag, count(*) AS n, avg(value) AS m FROM l GROUP BY 1, 2),
        a AS (SELECT column_name, avg(value) AS gm, count(*) AS n FROM l GROUP BY 1),
        b AS (SELECT column_name, sum(m.n * pow(m - gm, 2)) AS ssb, count(*) AS k FROM m JOIN a USING (column_name) GROUP BY 1),
        w AS (SELECT column_name, sum(pow(value - m, 2)) AS ssw FROM l JOIN m USING (column_name, l_returnflag) GROUP BY 1),
        s AS (SELECT column_name, ssb / (k - 1) / (ssw / (n - k)) AS score, k - 1 AS d1, CAST(n - k AS DOUBLE) AS d2 FROM a JOIN b USING (column_name) JOIN w USING (column_name))
        {RANKED}""",
    approx=("score", "d2"),
)
def _(t):
    return G.select_k_best(t.lineitem, NUM, "l_returnflag", "f_classif", 2)


@query(
    "select_k_best_f_regression",
    f"""WITH r AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))}),
        s AS (SELECT column_name, r * r * (n - 2) / (1 - r * r) AS score, CAST(1 AS BIGINT) AS d1, n - 2 AS d2 FROM r) {RANKED}""",
    approx=("score",),
)
def _(t):
    return G.select_k_best(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "f_regression", 2)


@query(
    "select_k_best_chi2",
    f"""WITH g AS (SELECT column_name, l_returnflag, sum(value) AS o, count(*) AS n FROM {LF} GROUP BY 1, 2),
        e AS (SELECT *, sum(o) OVER (PARTITION BY column_name) * n / sum(n) OVER (PARTITION BY column_name) AS e FROM g),
        s AS (SELECT column_name, sum(pow(o - e, 2) / e) AS score, count(*) - 1 AS d1, CAST(NULL AS BIGINT) AS d2 FROM e GROUP BY 1) {RANKED}""",
    approx=("score",),
)
def _(t):
    return G.select_k_best(t.lineitem, NUM, "l_returnflag", "chi2", 2)


@query(
    "select_by_variance",
    f"SELECT column_name, var_pop(value) AS variance, var_pop(value) > 0.001 AS selected FROM {long_sql('lineitem', NUM)} GROUP BY 1",
    approx=("variance",),
)
def _(t):
    return G.select_by_variance(t.lineitem, NUM, 0.001)


@query(
    "select_by_correlation",
    """WITH p AS (SELECT 'l_extendedprice' AS column_name, abs(corr(l_extendedprice, l_quantity)) AS r FROM lineitem
         UNION ALL SELECT 'total', abs(corr(l_quantity * l_tax, l_quantity)) FROM lineitem UNION ALL SELECT 'total', abs(corr(l_quantity * l_tax, l_extendedprice)) FROM lineitem)
       SELECT c AS column_name, max(r) FILTER (r > 0.5) AS max_r, max(r) FILTER (r > 0.5) IS NULL AS selected
       FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('total')) v(c) LEFT JOIN p ON c = column_name GROUP BY 1""",
    approx=("max_r",),
)
def _(t):
    d = t.lineitem.withColumn("total", F.col("l_quantity") * F.col("l_tax"))
    return G.select_by_correlation(d, ["l_quantity", "l_extendedprice", "total"], 0.5)


@query("select_by_importance")
def _(t):
    return J.importance_model(t.lineitem, NUM, "l_returnflag", "random_forest").where("importance > 0.01")


@query("pca")
def _(t):
    return G.pca(li(t), NUM, 2)


@query("pca_variance")
def _(t):
    return G.pca_variance(li(t), NUM)


@query("pca_components_choice")
def _(t):
    return G.pca_components_choice(li(t), NUM)


@query("pca_contributions")
def _(t):
    return G.pca_contributions(li(t), NUM)


OSTD = "({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"


@query(
    "feature_chain",
    f"""SELECT o_orderkey, o_orderstatus, round({OSTD.format(c='o_totalprice')}, 6) AS o_totalprice, round({OSTD.format(c='o_custkey')}, 6) AS o_custkey,
        round(({OSTD.format(c='o_totalprice')}) * ({OSTD.format(c='o_custkey')}), 6) AS o_totalprice_x_o_custkey FROM orders""",
)
def _(t):
    d = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    cols = ["o_totalprice", "o_custkey"]
    out = G.feature_chain(d, [lambda x: G.scale_standard(x, cols), lambda x: G.interactions(x, cols)], "o_orderstatus", ["o_orderkey"])
    return out.withColumns({c: F.round(c, 6) for c in [*cols, "o_totalprice_x_o_custkey"]})


@query(
    "feature_report",
    """SELECT c AS column_name, s AS state, (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders) AS rows_after FROM (VALUES
       ('o_orderkey', 'kept'), ('o_orderstatus', 'dropped'), ('o_orderstatus_F', 'added'), ('o_orderstatus_O', 'added'), ('o_orderstatus_P', 'added')) v(c, s)""",
)
def _(t):
    d = t.orders.select("o_orderkey", "o_orderstatus")
    return G.feature_report(d, G.encode_onehot(d, "o_orderstatus"))


# ---- clustering ----

C2 = ["c_acctbal", "c_nationkey"]


@query("kmeans")
def _(t):
    return I.kmeans(t.customer, C2, 4)


@query("kmeans_centers")
def _(t):
    return I.kmeans_centers(t.customer, C2, 4)


@query("gaussian_mixture")
def _(t):
    return I.gaussian_mixture(t.customer, C2, 3)


@query("hierarchical")
def _(t):
    return ward.hierarchical(t.customer, C2, 4)


@query("hierarchical_divisive")
def _(t):
    return I.hierarchical(t.customer, C2, 4)


@query("choose_k")
def _(t):
    return I.choose_k(t.customer, C2)


GROUPED = "(SELECT c_acctbal, c_nationkey, CAST(c_custkey % 4 AS INTEGER) - 1 AS cluster FROM customer)"


def grouped(t):
    return t.customer.withColumn("cluster", (F.col("c_custkey") % 4).cast("int") - 1)


@query(
    "cluster_metrics",
    f"""WITH d AS (SELECT * FROM {GROUPED} x), g AS (SELECT * FROM d WHERE cluster >= 0),
        c AS (SELECT cluster AS g, count(*) AS n, avg(c_acctbal) AS a, avg(c_nationkey) AS b FROM g GROUP BY 1),
        m AS (SELECT avg(c_acctbal) AS ma, avg(c_nationkey) AS mb FROM g),
        w AS (SELECT c.g, sum(pow(c_acctbal - a, 2) + pow(c_nationkey - b, 2)) AS ss, avg(sqrt(pow(c_acctbal - a, 2) + pow(c_nationkey - b, 2))) AS s FROM g JOIN c ON cluster = c.g GROUP BY 1),
        bt AS (SELECT sum(n * (pow(a - ma, 2) + pow(b - mb, 2))) AS between_ss FROM c, m),
        k AS (SELECT CAST(count(*) AS INTEGER) AS clusters, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS smallest, max(n) AS largest, min(n) / max(n) AS balance FROM c),
        r AS (SELECT x.g, max((wx.s + wy.s) / sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) AS r FROM c x JOIN c y ON x.g <> y.g JOIN w wx ON wx.g = x.g JOIN w wy ON wy.g = y.g GROUP BY 1)
        SELECT k.*, between_ss / (clusters - 1) / ((SELECT sum(ss) FROM w) / (n_rows - clusters)) AS calinski_harabasz, (SELECT avg(r) FROM r) AS davies_bouldin,
          (SELECT avg(CASE WHEN cluster < 0 THEN 1 ELSE 0 END) FROM d) AS noise_share FROM k, bt""",
    approx=("balance", "calinski_harabasz", "davies_bouldin", "noise_share"),
)
def _(t):
    return I.cluster_metrics(grouped(t), C2)


@query("cluster_silhouette")
def _(t):
    return I.silhouette(I.kmeans(t.customer, C2, 4, standardize=False), C2)


@query(
    "cluster_profiles",
    f"""SELECT s.cluster, column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
        quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75, any_value(size) AS size, any_value(pct) AS pct
        FROM {long_sql(GROUPED, C2, ["cluster"])} l JOIN (SELECT cluster, count(*) AS size, 100.0 * count(*) / (SELECT count(*) FROM customer) AS pct FROM {GROUPED} x GROUP BY 1) s USING (cluster) GROUP BY 1, 2""",
    approx=("mean", "std", "q25", "median", "q75", "pct"),
)
def _(t):
    return I.cluster_profiles(grouped(t), C2)


# ---- supervised ----


@query(
    "detect_task",
    """SELECT CASE WHEN count(DISTINCT l_linenumber) <= 10 AND count(DISTINCT l_linenumber) < 0.1 * count(*) THEN 'classification' ELSE 'regression' END AS task,
       count(DISTINCT l_linenumber) AS n_distinct, count(*) AS n_rows FROM lineitem
       UNION ALL SELECT CASE WHEN count(DISTINCT l_extendedprice) <= 10 THEN 'classification' ELSE 'regression' END, count(DISTINCT l_extendedprice), count(*) FROM lineitem
       UNION ALL SELECT 'classification', count(DISTINCT l_returnflag), count(*) FROM lineitem""",
)
def _(t):
    d = t.lineitem
    return J.detect_task(d, "l_linenumber").unionByName(J.detect_task(d, "l_extendedprice")).unionByName(J.detect_task(d, "l_returnflag"))


@query(
    "split_train_test",
    """WITH p AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS pos,
         count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
       SELECT o_orderkey, o_orderstatus, CASE WHEN pos < floor(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM p""",
)
def _(t):
    return J.split_train_test(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 0.2, "o_orderstatus")


def mixed(t):
    return t.lineitem.select(*KEY, *NUM, "l_linestatus", "l_returnflag")


@query("prepare_features")
def _(t):
    return J.prepare_features(t.lineitem_nulls.select(*KEY, *NUM, "l_returnflag"), ["l_quantity", "l_tax", "l_returnflag"])


@query("train_classifier")
def _(t):
    d = t.lineitem.select(*KEY, *NUM, "l_returnflag", (F.col("l_extendedprice") > 50000).cast("int").alias("dear"))
    names = ["logistic", "random_forest", "gradient_boosting", "linear_svm", "naive_bayes_gaussian", "naive_bayes_multinomial", "naive_bayes_bernoulli"]
    return J.train_classifier(d, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "dear", KEY, names)


@query("train_mlp_classifier")
def _(t):
    d = t.lineitem.withColumn("dear", (F.col("l_extendedprice") > 50000).cast("int"))
    return J.train_classifier(d, ["l_quantity", "l_discount", "l_tax"], "dear", KEY, ["mlp"])


@query("train_regressor")
def _(t):
    names = ["linear", "ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting"]
    return J.train_regressor(mixed(t), ["l_quantity", "l_discount", "l_tax", "l_linestatus"], "l_extendedprice", KEY, names)


@query(
    "train_regressor_linear",
    "SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem",
    approx=("slope", "intercept"),
)
def _(t):
    return J.linear_coefficients(t.lineitem, "l_quantity", "l_extendedprice")


@query("cross_validate")
def _(t):
    return J.cross_validate(mixed(t), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", KEY, "linear", "regression", 5)


@query("tune")
def _(t):
    return J.tune(mixed(t), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", KEY, "ridge", "regression", folds=3)


@query("tune_random")
def _(t):
    return J.tune(mixed(t), ["l_quantity", "l_discount"], "l_linestatus", KEY, "logistic", method="random", iterations=6)


SCORES = """(SELECT l_returnflag AS parameter, CAST(l_linenumber AS VARCHAR) AS value, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_score FROM lineitem GROUP BY 1, 2
    UNION ALL SELECT l_linestatus, CAST(l_linenumber AS VARCHAR), CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM lineitem GROUP BY 1, 2)"""


@query(
    "parameter_importance",
    f"""WITH m AS (SELECT parameter, value, avg(mean_score) AS m FROM {SCORES} x GROUP BY 1, 2)
        SELECT parameter, max(m) AS best, min(m) AS worst, arg_max(value, m) AS best_value, max(m) - min(m) AS importance FROM m GROUP BY 1""",
    approx=("best", "worst", "importance"),
)
def _(t):
    def part(c):
        mean = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
        return t.lineitem.groupBy(F.col(c).alias("parameter"), F.col("l_linenumber").cast("string").alias("value")).agg(mean.alias("mean_score"))

    return J.parameter_importance(part("l_returnflag").unionByName(part("l_linestatus")))


PRED = "(SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS label, CAST(l_quantity > 25 AS INTEGER) AS prediction, l_discount AS score FROM lineitem)"


def pred(t):
    return t.lineitem.select(
        *KEY, (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") > 25).cast("int").alias("prediction"), F.col("l_discount").alias("score")
    )


CLS = """WITH c AS (SELECT DISTINCT label AS cls FROM {p} x UNION SELECT DISTINCT prediction FROM {p} x),
    m AS (SELECT cls, count(*) FILTER (label = cls AND prediction = cls) AS tp, count(*) FILTER (label <> cls AND prediction = cls) AS fp,
      count(*) FILTER (label = cls AND prediction <> cls) AS fn, count(*) FILTER (label <> cls AND prediction <> cls) AS tn, count(*) AS n FROM {p} x, c GROUP BY 1),
    r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
      CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS specificity FROM m),
    f AS (SELECT cls, tp, fp, fn, tn, precision, recall, specificity, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
      tp + fn AS support, (tp + fn) / n AS share FROM r)"""
BIN = CLS.format(p=PRED)


@query(
    "classification_metrics",
    BIN
    + """ SELECT sum(tp) / sum(support) AS accuracy, CAST(sum(support) AS BIGINT) AS n, avg(precision) AS macro_precision, sum(precision * support) / sum(support) AS weighted_precision,
      avg(recall) AS macro_recall, sum(recall * support) / sum(support) AS weighted_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM f""",
    approx=("accuracy", "macro_precision", "weighted_precision", "macro_recall", "weighted_recall", "macro_f1", "weighted_f1"),
)
def _(t):
    return J.classification_summary(pred(t))


MULTI = "(SELECT l_orderkey, l_linenumber, l_returnflag AS label, CASE WHEN l_quantity > 33 THEN 'R' WHEN l_quantity > 16 THEN 'N' ELSE 'A' END AS prediction FROM lineitem)"


def multi(t):
    q = F.col("l_quantity")
    return t.lineitem.select(*KEY, F.col("l_returnflag").alias("label"), F.when(q > 33, "R").when(q > 16, "N").otherwise("A").alias("prediction"))


@query("class_metrics", CLS.format(p=MULTI) + " SELECT * FROM f", approx=("precision", "recall", "specificity", "f1", "share"))
def _(t):
    return J.class_metrics(multi(t))


@query("confusion_matrix", f"SELECT label, prediction, count(*) AS cnt FROM {MULTI} x GROUP BY 1, 2")
def _(t):
    return J.confusion_matrix(multi(t))


@query(
    "confused_pairs",
    f"""WITH m AS (SELECT label, prediction, count(*) AS cnt FROM {MULTI} x GROUP BY 1, 2), s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY label) AS error_share FROM m)
        SELECT * FROM s WHERE label <> prediction ORDER BY cnt DESC, label, prediction LIMIT 5""",
    approx=("error_share",),
)
def _(t):
    return J.confused_pairs(multi(t))


def auc_sql(label, score, table):
    return f"""SELECT sum(y) AS positives, count(*) AS n, (sum(y * r) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) AS auc
      FROM (SELECT CAST({label} AS INTEGER) AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r FROM {table}) z"""


@query("roc_auc", f"SELECT CAST(positives AS BIGINT) AS positives, n, auc FROM ({auc_sql('label', 'score', PRED + ' p')}) y", approx=("auc",))
def _(t):
    return J.roc_auc(pred(t), F.col("label"), "score")


@query(
    "roc_auc_one_vs_rest",
    " UNION ALL ".join(
        f"SELECT '{k}' AS cls, CAST(positives AS BIGINT) AS positives, n, auc FROM ({auc_sql(f'l_returnflag = {chr(39)}{k}{chr(39)}', c, 'lineitem')}) y"
        for k, c in (("A", "l_discount"), ("N", "l_tax"), ("R", "l_quantity"))
    ),
    approx=("auc",),
)
def _(t):
    return J.roc_auc_one_vs_rest(t.lineitem, "l_returnflag", {"A": "l_discount", "N": "l_tax", "R": "l_quantity"})


@query(
    "confidence_bands",
    """WITH p AS (SELECT greatest(l_quantity / 50, 1 - l_quantity / 50) AS p FROM lineitem)
       SELECT avg(p) AS mean, min(p) AS min, max(p) AS max, stddev_pop(p) AS std, count(*) FILTER (p > 0.9) AS very_high, count(*) FILTER (p > 0.7 AND p <= 0.9) AS high,
         count(*) FILTER (p > 0.5 AND p <= 0.7) AS medium, count(*) FILTER (p <= 0.5) AS low, count(*) FILTER (p > 0.8) AS sure, count(*) FILTER (p < 0.6) AS unsure FROM p""",
    approx=("mean", "min", "max", "std"),
)
def _(t):
    p = F.col("l_quantity") / 50
    return J.confidence_bands(t.lineitem.select(F.array(p, 1 - p).alias("probability")), "probability")


REG = "(SELECT l_orderkey, l_linenumber, l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem)"


def reg(t):
    return t.lineitem.select(*KEY, F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))


@query(
    "regression_metrics",
    f"""WITH e AS (SELECT label AS y, label - prediction AS e FROM {REG} x),
        m AS (SELECT count(*) AS n, 1 - avg(e * e) / var_pop(y) AS r2, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(abs(e) / greatest(abs(y), 1e-8)) * 100 AS mape,
          1 - var_pop(e) / var_pop(y) AS explained_variance, max(abs(e)) AS max_error, median(abs(e)) AS median_ae, quantile_cont(abs(e), 0.9) AS p90_error, quantile_cont(abs(e), 0.95) AS p95_error FROM e)
        SELECT *, CASE WHEN r2 >= 0.9 THEN 'excellent' WHEN r2 >= 0.7 THEN 'good' WHEN r2 >= 0.5 THEN 'fair' ELSE 'poor' END AS grade FROM m""",
    approx=("r2", "mse", "rmse", "mae", "mape", "explained_variance", "max_error", "median_ae", "p90_error", "p95_error"),
)
def _(t):
    return J.regression_metrics(reg(t), "label", "prediction")


@query(
    "residual_analysis",
    f"""WITH e AS (SELECT label - prediction AS e, row_number() OVER (ORDER BY prediction, l_orderkey, l_linenumber) - 1 AS pos, count(*) OVER () AS n FROM {REG} x),
        s AS (SELECT avg(e) AS mean, stddev_pop(e) AS std, skewness(e) * (count(e) - 2) / sqrt(count(e) * (count(e) - 1.0)) AS skewness, min(e) AS min, max(e) AS max FROM e),
        h AS (SELECT count(*) FILTER (abs(e) > 2 * std) AS outliers, stddev_pop(e) FILTER (pos < ceil(n / 2)) AS first_std, stddev_pop(e) FILTER (pos >= ceil(n / 2)) AS second_std FROM e, s)
        SELECT s.*, outliers, greatest(first_std, second_std) / least(first_std, second_std) AS std_ratio, greatest(first_std, second_std) / least(first_std, second_std) > 1.5 AS heteroscedastic FROM s, h""",
    approx=("mean", "std", "skewness", "min", "max", "std_ratio"),
)
def _(t):
    return J.residual_analysis(reg(t), "label", "prediction", KEY).drop("first_std", "second_std")


@query(
    "baseline_compare",
    f"""WITH tr AS (SELECT * FROM {MULTI} x WHERE l_orderkey % 5 <> 0), te AS (SELECT * FROM {MULTI} x WHERE l_orderkey % 5 = 0),
        b AS (SELECT label AS base FROM tr GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1),
        s AS (SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END) AS model_score, avg(CASE WHEN label = base THEN 1.0 ELSE 0 END) AS baseline_score FROM te, b)
        SELECT *, (model_score - baseline_score) / baseline_score * 100 AS improvement_pct FROM s""",
    approx=("model_score", "baseline_score", "improvement_pct"),
)
def _(t):
    m = multi(t)
    return J.baseline_compare(m.where("l_orderkey % 5 <> 0"), m.where("l_orderkey % 5 = 0"), "label", "prediction")


@query(
    "baseline_compare_regression",
    f"""WITH b AS (SELECT avg(label) AS base FROM {REG} x WHERE l_orderkey % 5 <> 0),
        s AS (SELECT sqrt(avg(pow(label - prediction, 2))) AS model_score, sqrt(avg(pow(label - base, 2))) AS baseline_score FROM {REG} x, b WHERE l_orderkey % 5 = 0)
        SELECT *, (baseline_score - model_score) / baseline_score * 100 AS improvement_pct FROM s""",
    approx=("model_score", "baseline_score", "improvement_pct"),
)
def _(t):
    m = reg(t)
    return J.baseline_compare(m.where("l_orderkey % 5 <> 0"), m.where("l_orderkey % 5 = 0"), "label", "prediction", "regression")


OKEY = ["o_orderkey"]


def three(t):
    p = F.col("o_totalprice")
    return [t.orders.select(*OKEY, e.alias("prediction")) for e in (p * 0.9, p * 0.8 + 2000, F.lit(250000.0))]


@query(
    "ensemble_vote",
    "SELECT o_orderkey, (o_totalprice * 0.9 + (o_totalprice * 0.8 + 2000) + 250000.0) / 3 AS ensemble, CAST(3 AS BIGINT) AS models FROM orders",
    approx=("ensemble",),
)
def _(t):
    return J.ensemble_vote(three(t), OKEY)


@query(
    "ensemble_vote_class",
    """WITH v AS (SELECT o_orderkey, unnest([CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'P' END, o_orderstatus]) AS p FROM orders),
       c AS (SELECT o_orderkey, p, count(*) AS v FROM v GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC, p) AS k, CAST(sum(v) OVER (PARTITION BY o_orderkey) AS BIGINT) AS models FROM c)
       SELECT o_orderkey, p AS ensemble, models FROM r WHERE k = 1""",
)
def _(t):
    votes = [F.when(F.col("o_totalprice") > 250000, "F").otherwise("O"), F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("P"), F.col("o_orderstatus")]
    return J.ensemble_vote([t.orders.select(*OKEY, v.alias("prediction")) for v in votes], OKEY, kind="vote")


@query(
    "ensemble_weighted",
    "SELECT o_orderkey, (o_totalprice * 0.9 * 0.5 + (o_totalprice * 0.8 + 2000) * 0.3 + 250000.0 * 0.2) AS ensemble FROM orders",
    approx=("ensemble",),
)
def _(t):
    return J.ensemble_weighted(three(t), [0.5, 0.3, 0.2], OKEY)


@query("ensemble_stacking")
def _(t):
    return J.ensemble_stacking(mixed(t), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", KEY, ["linear", "random_forest"])


@query("importance_model")
def _(t):
    return J.importance_model(mixed(t), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "random_forest", "regression")


IMP = "(SELECT c_mktsegment || '_' || c_nationkey AS column_name, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS importance FROM customer GROUP BY 1)"


@query(
    "importance_analysis",
    f"""WITH q AS (SELECT quantile_cont(abs(importance), 0.75) AS a, quantile_cont(abs(importance), 0.25) AS b FROM {IMP} x)
        SELECT column_name, importance, CAST(row_number() OVER w AS INTEGER) AS rank, sum(abs(importance)) OVER w / sum(abs(importance)) OVER () AS cumulative, split_part(column_name, '_', 1) AS prefix,
          CASE WHEN abs(importance) >= a THEN 'high' WHEN abs(importance) <= b THEN 'low' ELSE 'medium' END AS tier FROM {IMP} x, q
        WINDOW w AS (ORDER BY abs(importance) DESC, column_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    approx=("importance", "cumulative"),
)
def _(t):
    rows = t.customer.groupBy(F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("column_name")).agg(
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("importance")
    )
    return J.analyze_importance(rows)


SOFT = """(SELECT o_orderkey, [[0.1 + o_custkey % 7 / 10.0, 0.8 - o_custkey % 7 / 10.0, 0.1], [0.2, 0.3 + o_orderkey % 5 / 10.0, 0.5 - o_orderkey % 5 / 10.0],
    [CASE WHEN o_totalprice > 150000 THEN 0.6 ELSE 0.1 END, 0.3, CASE WHEN o_totalprice > 150000 THEN 0.1 ELSE 0.6 END]] AS p, [1.0, 2.0, 0.5] AS w FROM orders)"""


@query(
    "ensemble_soft_vote",
    f"""WITH e AS (SELECT o_orderkey, unnest(range(1, 4)) AS m, p, w FROM {SOFT} x),
        s AS (SELECT o_orderkey, unnest(['F', 'O', 'P']) AS class, unnest([sum(p[m][1]::DOUBLE * w[m]::DOUBLE), sum(p[m][2]::DOUBLE * w[m]::DOUBLE), sum(p[m][3]::DOUBLE * w[m]::DOUBLE)]) / 3.5 AS v FROM e GROUP BY 1)
        SELECT o_orderkey, arg_max(class, (round(v, 9), -ascii(class))) AS ensemble, max(v) AS confidence, CAST(3 AS BIGINT) AS models FROM s GROUP BY 1""",
    approx=("confidence",),
)
def _(t):
    a, b = F.col("o_custkey") % 7 / 10, F.col("o_orderkey") % 5 / 10
    dear_ = F.col("o_totalprice") > 150000
    rows = [
        F.array(0.1 + a, 0.8 - a, F.lit(0.1)), F.array(F.lit(0.2), 0.3 + b, 0.5 - b),
        F.array(F.when(dear_, 0.6).otherwise(0.1), F.lit(0.3), F.when(dear_, 0.1).otherwise(0.6)),
    ]
    models = [t.orders.select(*OKEY, F.transform(p, lambda x: F.round(x, 9)).alias("probability")) for p in rows]
    return X.soft_vote(models, OKEY, ["F", "O", "P"], [1.0, 2.0, 0.5])


@query("stacking_classifier")
def _(t):
    return X.stacking_classifier(mixed(t), ["l_quantity", "l_discount", "l_extendedprice"], "l_returnflag", KEY, ["logistic", "random_forest"]).select(*KEY, "l_returnflag", "prediction")


@query("permutation_importance")
def _(t):
    return X.permutation_importance(dear(t), ["l_quantity", "l_discount", "l_tax"], "dear", KEY, "logistic")


@query("permutation_importance_regression")
def _(t):
    return X.permutation_importance(mixed(t), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", KEY, "linear", "regression")


@query("partial_dependence_classes")
def _(t):
    return X.partial_dependence_classes(dear(t), ["l_quantity", "l_discount", "l_tax"], "dear", "l_quantity", 20, "logistic")


@query("learning_curve_classes")
def _(t):
    return X.learning_curve_folds(dear(t), ["l_quantity", "l_discount", "l_tax"], "dear", KEY, "logistic", folds=3, shares=(0.1, 0.3, 0.5, 0.7, 1.0))


@query("importance_permutation")
def _(t):
    return J.importance_permutation(mixed(t), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", KEY, "linear")


@query("partial_dependence")
def _(t):
    return J.partial_dependence(mixed(t), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_quantity")


SHAP = """(SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS column_name,
    unnest([1500 * (l_quantity - mq), -200 * (l_discount - md), 90000 * (l_tax - mt)]) AS contribution FROM lineitem,
    (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_tax) AS mt FROM lineitem))"""
COEF = {"l_quantity": 1500.0, "l_discount": -200.0, "l_tax": 90000.0}


@query(
    "linear_shap",
    """WITH d AS (SELECT o_orderkey, 3 * (o_totalprice - avg(o_totalprice) OVER ()) AS a, -40 * (o_custkey - avg(o_custkey) OVER ()) AS b FROM orders)
       SELECT o_orderkey, 'o_totalprice' AS column_name, a AS contribution, CASE WHEN abs(a) >= abs(b) THEN 1 ELSE 2 END AS rank FROM d
       UNION ALL SELECT o_orderkey, 'o_custkey', b, CASE WHEN abs(a) >= abs(b) THEN 2 ELSE 1 END FROM d""",
    approx=("contribution",),
)
def _(t):
    return J.linear_shap(t.orders, {"o_totalprice": 3.0, "o_custkey": -40.0}, ["o_orderkey"])


@query(
    "linear_shap_summary",
    f"SELECT column_name, avg(abs(contribution)) AS mean_abs, round(avg(contribution), 4) + 0.0 AS mean FROM {SHAP} x GROUP BY 1",
    approx=("mean_abs", "mean"),
)
def _(t):
    out = J.linear_shap_summary(J.linear_shap(t.lineitem, COEF, KEY))
    return out.withColumn("mean", F.round("mean", 4) + 0.0)


@query("learning_curve")
def _(t):
    return J.learning_curve(mixed(t), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", KEY)


def dear(t):
    return t.lineitem.select(*KEY, *NUM, "l_linestatus", (F.col("l_extendedprice") > 50000).cast("int").alias("dear"))


MODEL_COLUMNS = {"l_quantity": "double", "l_discount": "double", "l_linestatus": "string"}


@query("batch_predict")
def _(t):
    model, classes = J.fit_classifier(dear(t), list(MODEL_COLUMNS), "dear", "logistic")
    return J.batch_predict(model, dear(t).drop("l_discount", "dear"), MODEL_COLUMNS, classes)


@query("prediction_distribution")
def _(t):
    model, classes = J.fit_classifier(dear(t), list(MODEL_COLUMNS), "dear", "logistic")
    return J.prediction_distribution(J.batch_predict(model, dear(t), MODEL_COLUMNS, classes), "predicted_class")


@query("save_load_model")
def _(t):
    path = scratch_folder(t.spark)
    model, classes = J.fit_classifier(dear(t), list(MODEL_COLUMNS), "dear", "logistic")
    J.save_model(model, path)
    return J.batch_predict(J.load_model(path), dear(t), MODEL_COLUMNS, classes).select(*KEY, "prediction")


@query(
    "compare_models",
    """WITH m AS (SELECT l_returnflag AS model, avg(l_discount) AS r2, avg(l_quantity) AS rmse FROM lineitem GROUP BY 1)
       SELECT model, 'r2' AS metric, r2 AS value, CAST(row_number() OVER (ORDER BY r2 DESC, model) AS INTEGER) AS rank FROM m
       UNION ALL SELECT model, 'rmse', rmse, row_number() OVER (ORDER BY rmse, model) FROM m""",
    approx=("value",),
)
def _(t):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_discount").alias("r2"), F.avg("l_quantity").alias("rmse"))
    return J.compare_models(m, {"r2": True, "rmse": False})


@query("automl")
def _(t):
    return J.automl(mixed(t), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", KEY)
