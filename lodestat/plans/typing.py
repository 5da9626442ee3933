"""Queries over the typing, filter and cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import typing as Y
from lodestat.plans.quality import CUST, DIRTY, dirty
from lodestat.plans.registry import LINEITEM_NULLS, ORDERS_DUP, query

# customer as text, the way a CSV read without types gives it
TEXT_CUST = "(SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CUST) + ", 'Y' AS flag, strftime(DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER), '%Y-%m-%d') AS joined FROM customer)"


def text_customer(t):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")), "yyyy-MM-dd")
    return t.customer.select(*[F.col(c).cast("string").alias(c) for c in CUST], F.lit("Y").alias("flag"), day.alias("joined"))


def infer_sql(c):
    s = f"nullif(trim({c}), '')"
    num = f"TRY_CAST({s} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, count({s}) AS n,
      count(*) FILTER (lower({s}) IN ('true','false','1','0','yes','no','y','n')) AS booleans,
      count(*) FILTER (regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')) AS dates,
      count(*) FILTER ({num} = floor({num})) AS integers, count({num}) AS numbers FROM {TEXT_CUST} x"""


@query(
    "infer_column_type",
    "WITH s AS ("
    + " UNION ALL ".join(infer_sql(c) for c in [*CUST, "flag", "joined"])
    + """) SELECT *, CASE WHEN n = 0 THEN 'string' WHEN booleans >= 0.8 * n THEN 'boolean' WHEN dates >= 0.8 * n THEN 'datetime'
        WHEN integers >= 0.8 * n THEN 'integer' WHEN numbers >= 0.8 * n THEN 'float' ELSE 'string' END AS inferred_type FROM s""",
)
def _(t):
    return Y.infer_column_type(text_customer(t))


@query(
    "convert_types",
    f"""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(NULL AS VARCHAR) AS c_custkey_raw, c_name,
        CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_acctbal_raw,
        TRY_CAST(c_mktsegment AS DOUBLE) AS c_mktsegment, c_mktsegment AS c_mktsegment_raw, TRUE AS flag,
        CAST(NULL AS VARCHAR) AS flag_raw, strftime(CAST(joined AS DATE), '%Y-%m-%d') AS joined, CAST(NULL AS VARCHAR) AS joined_raw
        FROM {TEXT_CUST} x""",
)
def _(t):
    out = Y.convert_types(
        text_customer(t),
        {"c_custkey": "integer", "c_acctbal": "float", "c_mktsegment": "float", "flag": "boolean", "joined": "datetime"},
    )
    return out.drop("c_nationkey").withColumn("joined", F.date_format("joined", "yyyy-MM-dd"))


@query(
    "select_by_type",
    """SELECT 'o_orderkey' AS column_name, 'numeric' AS type_set UNION ALL SELECT 'o_custkey', 'numeric'
       UNION ALL SELECT 'o_totalprice', 'numeric' FROM orders HAVING count(DISTINCT o_totalprice) >= 2
       UNION ALL SELECT 'o_orderdate', 'datetime'
       UNION ALL SELECT 'o_orderstatus', 'categorical' FROM orders HAVING count(DISTINCT o_orderstatus) <= 50
       UNION ALL SELECT 'o_orderpriority', 'categorical' FROM orders HAVING count(DISTINCT o_orderpriority) <= 50""",
)
def _(t):
    return Y.select_by_type(t.orders)


DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


@query(
    "column_kind",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, {"'integer'" if c in ("doc_id", "n_chars") else
        f"CASE WHEN count(DISTINCT {c}) / count(*) < 0.1 AND count(DISTINCT {c}) < 50 THEN 'categorical' ELSE 'text' END"} AS kind FROM documents"""
        for c in DOCS
    ),
)
def _(t):
    return Y.column_kind(t.documents)


def judge_sql(c, base):
    x = c if base in ("integer", "float") else "CAST(NULL AS DOUBLE)"
    d, n = f"count(DISTINCT {c})", "count(*)"
    if base in ("integer", "float"):
        kind = "'numeric'"
        first = f"WHEN {d} <= 20 THEN 'ordinal' " if base == "integer" else ""
        last = "'integer'" if base == "integer" else "'continuous'"
        sub = f"CASE {first}WHEN min({c}) >= 0 AND max({c}) <= 1 THEN 'probability' ELSE {last} END"
        card = "CAST(NULL AS VARCHAR)"
    elif base == "text":
        kind = "'categorical'"
        sub = f"CASE WHEN {d} <= 5 THEN 'nominal_low' WHEN {d} <= 20 THEN 'nominal_medium' ELSE 'nominal_high' END"
        card = f"CASE WHEN {d} / {n} > 0.8 THEN 'high' WHEN {d} / {n} > 0.3 THEN 'medium' ELSE 'low' END"
    else:
        kind, sub, card = f"'{base}'", "'standard'", "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{c}' AS column_name, {kind} AS type, {sub} AS sub_type, {card} AS cardinality, FALSE AS date_like,
        {n} AS n_rows, {n} - count({c}) AS n_null, {d} AS n_distinct, avg({x}) AS mean, stddev_samp({x}) AS std FROM {{table}} x"""


LI_BASE = {
    "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "float",
    "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "text", "l_linestatus": "text",
    "l_shipdate": "datetime",
}
JUDGE = " UNION ALL ".join(judge_sql(c, b) for c, b in LI_BASE.items()).replace("{table}", LINEITEM_NULLS)


@query("judge_data_types", JUDGE, approx=("mean", "std"))
def _(t):
    return Y.judge_data_types(t.lineitem_nulls)


@query(
    "auto_preprocess_plan",
    f"""WITH j AS ({JUDGE}),
        o AS (SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice','l_discount','l_tax']) AS column_name,
          unnest([{", ".join(f"(SELECT count(*) > 0 FROM lineitem_n, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem_n) q WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))" for c in list(LI_BASE)[:8])}]) AS out),
        k AS (SELECT j.*, coalesce(out, FALSE) AS out, n_null / n_rows * 100 AS p FROM j LEFT JOIN o USING (column_name))
        SELECT 'remove_column' AS step, column_name, 'drop' AS method FROM k WHERE p > 50
        UNION ALL SELECT 'handle_missing', column_name, CASE WHEN type = 'numeric' THEN CASE WHEN out THEN 'median' ELSE 'mean' END
          WHEN type = 'categorical' THEN 'mode' ELSE 'forward_fill' END FROM k WHERE p > 0 AND p <= 50
        UNION ALL SELECT 'handle_outliers', column_name, 'iqr_clipping' FROM k WHERE p <= 50 AND type = 'numeric' AND out
        UNION ALL SELECT 'normalize', column_name, 'standard_scaling' FROM k WHERE p <= 50 AND type = 'numeric' AND std > 2 * mean
        UNION ALL SELECT 'reduce_cardinality', column_name, 'top_categories' FROM k WHERE p <= 50 AND cardinality = 'high'
        UNION ALL SELECT 'encode_categorical', column_name, CASE WHEN n_distinct <= 10 THEN 'one_hot' ELSE 'label_encoding' END
          FROM k WHERE p <= 50 AND type = 'categorical'
        UNION ALL SELECT 'remove_duplicates', '*', 'exact' FROM lineitem_n
          HAVING count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem_n))""".replace(
        "WITH j AS", f"WITH lineitem_n AS (SELECT * FROM {LINEITEM_NULLS} z), j AS"
    ),
)
def _(t):
    return Y.auto_preprocess_plan(t.lineitem_nulls)


def ladder(c):
    return f"""CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint'
      WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END"""


PART = {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double", "p_name": "string", "p_brand": "string", "p_type": "string"}


def downcast_sql(c, k):
    new = {"double": "max('float')", "string": f"CASE WHEN count(DISTINCT {c}) / count(*) < 0.5 THEN 'category' ELSE 'string' END"}.get(k) or ladder(c)
    return f"SELECT '{c}' AS column_name, '{k}' AS old_type, {new} AS new_type FROM part"


@query("downcast_types", " UNION ALL ".join(downcast_sql(c, k) for c, k in PART.items()))
def _(t):
    return Y.downcast_plan(t.part)


@query(
    "sanitize_columns",
    """SELECT c_custkey, c_name AS "customer_name", c_acctbal AS acctbal_usd, c_mktsegment AS acctbal_usd_1 FROM customer""",
)
def _(t):
    odd = t.customer.select(
        "c_custkey", F.col("c_name").alias("customer name!"), F.col("c_acctbal").alias("acctbal (usd)"),
        F.col("c_mktsegment").alias("acctbal usd"), F.lit(None).cast("string").alias("nothing"),
    )
    return Y.sanitize_columns(odd)


@query("drop_null_rows", f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM {LINEITEM_NULLS} x WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL")
def _(t):
    return Y.drop_null_rows(t.lineitem_nulls.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))


def fill_sql(value, flag):
    return f"SELECT l_orderkey, l_partkey, coalesce(l_quantity, {value}) AS l_quantity, coalesce(l_returnflag, {flag}) AS l_returnflag FROM {LINEITEM_NULLS} x"


PICK = ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"]
MODE = f"(SELECT l_returnflag FROM {LINEITEM_NULLS} y WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"

for _how in ("mean", "median"):
    _agg = {"mean": "avg(l_quantity)", "median": "median(l_quantity)"}[_how]

    @query(f"fill_missing_{_how}", fill_sql(f"(SELECT {_agg} FROM {LINEITEM_NULLS} y)", MODE), approx=("l_quantity",))
    def _(t, how=_how):
        df = t.lineitem_nulls.select(*PICK)
        return Y.fill_missing(Y.fill_missing(df, ["l_quantity"], how), ["l_returnflag"], "mode")


# the most frequent value of a number and of a string column, the smaller of equally frequent ones
@query(
    "fill_missing_mode",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM {LINEITEM_NULLS} y),
        q AS (SELECT l_quantity AS v FROM x WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        f AS (SELECT l_returnflag AS v FROM x WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT l_orderkey, l_linenumber, coalesce(l_quantity, q.v) AS l_quantity, coalesce(l_returnflag, f.v) AS l_returnflag FROM x, q, f""",
)
def _(t):
    return Y.fill_missing(t.lineitem_nulls.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), ["l_quantity", "l_returnflag"], "mode")


@query("fill_missing_constant", fill_sql("-1", "'missing'"))
def _(t):
    df = t.lineitem_nulls.select(*PICK)
    return Y.fill_missing(Y.fill_missing(df, ["l_quantity"], "constant", -1.0), ["l_returnflag"], "constant", "missing")


EV_NULL = "(SELECT event_id, event_type, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)"


def events_null(t):
    return t.events.select("event_id", "event_type", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


@query(
    "fill_missing_forward",
    f"""SELECT event_id, event_type, last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EV_NULL} x""",
)
def _(t):
    return Y.fill_missing(events_null(t), ["value"], "forward_fill", order_by=["ts", "event_id"], keys=["event_type"]).drop("ts")


@query(
    "fill_missing_back",
    f"""SELECT event_id, event_type, first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {EV_NULL} x""",
)
def _(t):
    return Y.fill_missing(events_null(t), ["value"], "back_fill", order_by=["ts", "event_id"]).drop("ts")


@query(
    "duplicate_rows",
    f"""WITH t AS (SELECT * FROM {ORDERS_DUP} x), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM t))
        SELECT count(*) AS n_rows, count(*) - (SELECT n FROM d) AS n_duplicates,
          (count(*) - (SELECT n FROM d)) / count(*) * 100 AS duplicate_pct FROM t""",
    approx=("duplicate_pct",),
)
def _(t):
    return Y.duplicate_rows(t.orders_dup)


@query("drop_duplicates", f"SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {ORDERS_DUP} x")
def _(t):
    return Y.drop_duplicates(t.orders_dup.drop("o_orderdate"))


@query(
    "validate_table",
    """WITH n AS (SELECT count(*) AS n FROM part)
       SELECT 'row limit' AS "check", '*' AS column_name, n AS value, n <= 10000000 AS ok FROM n
       UNION ALL SELECT 'not empty', '*', n, n > 0 FROM n UNION ALL SELECT 'column limit', '*', 6, TRUE
       """
    + " ".join(f"UNION ALL SELECT 'has values', '{c}', count({c}), count({c}) > 0 FROM part UNION ALL SELECT 'unique name', '{c}', 1, TRUE" for c in PART)
    + " "
    + " ".join(f"UNION ALL SELECT 'text limit', '{c}', max(length({c})), max(length({c})) <= 100000 FROM part" for c in ("p_name", "p_brand", "p_type")),
)
def _(t):
    return Y.validate_table(t.part)


WARN = "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL OR lower(trim(CAST({c} AS VARCHAR))) IN ('','null','na')) AS n_missing,
        count(DISTINCT {c}) AS n_distinct FROM {DIRTY} x"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
) + ") y"
WARN = f"""WITH w AS ({WARN}), f AS (SELECT *, n_missing / n_rows * 100 AS missing_pct, n_missing / n_rows * 100 > 90 AS mostly_missing,
    1 - n_distinct / (n_rows - n_missing) > 0.8 AS mostly_duplicates, n_distinct = 1 AS is_constant,
    n_distinct / (n_rows - n_missing) < 0.01 AS few_distinct FROM w),
  g AS (SELECT *, CAST(mostly_missing AS INTEGER) + CAST(mostly_duplicates AS INTEGER) + CAST(is_constant AS INTEGER) + CAST(few_distinct AS INTEGER) AS warnings,
    CAST(CASE WHEN missing_pct > 50 THEN 15 WHEN missing_pct > 20 THEN 10 WHEN missing_pct > 10 THEN 5 ELSE 0 END AS INTEGER) AS missing_points FROM f)"""


@query("csv_quality_warnings", WARN + " SELECT * FROM g", approx=("missing_pct",))
def _(t):
    return Y.csv_quality_warnings(dirty(t))


@query(
    "csv_quality_score",
    WARN
    + """, s AS (SELECT CAST(sum(warnings) AS BIGINT) AS warnings, sum(n_missing) / sum(n_rows) * 100 AS missing_pct FROM g)
      SELECT *, CAST(greatest(0, 100 - 5 * warnings - CASE WHEN missing_pct > 50 THEN 15 WHEN missing_pct > 20 THEN 10
        WHEN missing_pct > 10 THEN 5 ELSE 0 END) AS BIGINT) AS score FROM s""",
    approx=("missing_pct",),
)
def _(t):
    return Y.csv_quality_score(dirty(t))


@query(
    "iqr_clip",
    """WITH f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
       SELECT event_id, least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS value FROM events, f""",
    approx=("value",),
)
def _(t):
    return Y.iqr_clip(t.events.select("event_id", "value"), ["value"])


@query("concat_rows", f"SELECT o_orderkey, o_totalprice FROM {ORDERS_DUP} x")
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    return Y.concat_rows(o, o.where("o_orderkey % 20 = 0"))


@query("join_inner", "SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    left = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return Y.join_inner(left, t.customer, ["c_custkey"]).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(t):
    big = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return Y.join_semi(t.customer.select("c_custkey", "c_name"), big, ["c_custkey"])


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return Y.top_k(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey")


@query(
    "load_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, unnest(['dtype', 'missing', 'missing_pct']) AS metric,
            unnest(['{k}', CAST(count(*) - count({c}) AS VARCHAR), printf('%.2f', round((count(*) - count({c})) / count(*) * 100, 2))]) AS value FROM {LINEITEM_NULLS} x"""
        for c, k in zip(LI_BASE, ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"])
    )
    + f""" UNION ALL SELECT '*', unnest(['n_rows', 'n_columns', 'n_duplicates']), unnest([CAST(count(*) AS VARCHAR), '11',
        CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {LINEITEM_NULLS} z)) AS VARCHAR)]) FROM {LINEITEM_NULLS} x""",
)
def _(t):
    return Y.load_summary(t.lineitem_nulls)


DRAW = "('0x' || md5('42|' || o_orderkey)[:13])::BIGINT"


@query("sample_rows_random", f"SELECT * FROM orders ORDER BY {DRAW}, o_orderkey LIMIT 500")
def _(t):
    return Y.sample_rows(t.orders, "random", size=500, key=["o_orderkey"])


@query(
    "sample_rows_stratified",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {DRAW}, o_orderkey) AS k FROM orders)
        SELECT * EXCLUDE (k) FROM r WHERE k <= greatest(1, 300 // (SELECT count(DISTINCT o_orderstatus) FROM orders))""",
)
def _(t):
    return Y.sample_rows(t.orders, "stratified", size=300, key=["o_orderkey"], strata="o_orderstatus")


@query(
    "sample_rows_systematic",
    """WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, o_totalprice FROM p WHERE pos % (n // 700) = 0 AND pos // (n // 700) < 700""",
)
def _(t):
    return Y.sample_rows(t.orders, "systematic", size=700, key=["o_orderkey"]).select("o_orderkey", "o_totalprice")
