"""Queries over sources, sinks and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import apply as U
from lodestat.plans.registry import query
from lodestat.session import scratch_folder
from lodestat.sources import files as A

CUSTOMER = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer"
PICK = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def saved(t, fmt, sep=",", table=None):
    path = scratch_folder(t.spark)
    df = table if table is not None else t.customer.select(*PICK)
    writer = df.write.option("header", "true").option("sep", sep)
    getattr(writer, fmt)(path)
    return path


@query("read_csv", CUSTOMER)
def _(t):
    return A.read_csv(t.spark, saved(t, "csv", ";"))


@query("read_tsv", CUSTOMER)
def _(t):
    return A.read_tsv(t.spark, saved(t, "csv", "\t"))


@query("detect_delimiter", "SELECT '|' AS delimiter, CAST(3 AS INTEGER) AS cnt FROM customer HAVING count(*) > 0")
def _(t):
    return A.detect_delimiter(t.spark, saved(t, "csv", "|"))


@query("read_json", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return A.read_json(t.spark, saved(t, "json"), lines=True, schema=t.customer.select(*PICK).schema)


@query("read_json_array", "SELECT c_custkey AS k, c_name AS name FROM customer")
def _(t):
    # one object per file with the records below a dotted path
    path = scratch_folder(t.spark)
    records = t.customer.groupBy(F.col("c_custkey") % 16).agg(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))).alias("rows"))
    records.select(F.struct("rows").alias("data")).repartition(16).write.option("maxRecordsPerFile", 1).json(path)
    return A.read_json(t.spark, path, array_path="data.rows", schema="data struct<rows: array<struct<k: long, name: string>>>")


@query("read_csv_options", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name || ' é' AS c_name FROM customer WHERE c_custkey > 0")
def _(t):
    # Latin-1 bytes, one line of notes before the header of the single file
    path = scratch_folder(t.spark)
    rows = t.customer.select(F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat("c_name", F.lit(" é"))).alias("value"), F.col("c_custkey").alias("k"))
    head = t.spark.createDataFrame([("notes", -2), ("c_custkey;c_name", -1)], "value string, k long")
    rows.union(head).coalesce(1).sortWithinPartitions("k").select("value").write.option("encoding", "ISO-8859-1").csv(path, sep="\x01", quote="")
    return A.read_csv(t.spark, path, encoding=None, skip_rows=1, dtypes={"c_custkey": "int"}).where("c_custkey > 0")


@query("json_flatten", 'SELECT event_id, CAST(json_extract(props, \'$.k\') AS INTEGER) AS "payload.k", event_type AS "payload.type.name" FROM events')
def _(t):
    props = F.from_json("props", "k int")
    nested = t.events.select("event_id", F.struct(props["k"].alias("k"), F.struct(F.col("event_type").alias("name")).alias("type")).alias("payload"))
    return A.json_flatten(nested)


@query("read_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(t):
    return A.read_parquet(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 45")


@query("read_feather", "SELECT c_custkey, c_name FROM customer")
def _(t):
    path = scratch_folder(t.spark)

    def arrow_file(batches):
        import pyarrow as pa

        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"content": [sink.getvalue().to_pybytes()]})

    # Arrow files kept as binary values, then read back through the same decoder
    files = t.customer.select("c_custkey", "c_name").mapInArrow(arrow_file, "content binary")
    files.write.parquet(path)

    return A.arrow_rows(t.spark.read.parquet(path), "c_custkey long, c_name string")


LINES = "(SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS p FROM documents)"


@query(
    "read_text_lines",
    rf"""SELECT count(*) AS lines, CAST(sum(length(p[i])) AS BIGINT) AS characters, CAST(sum(len(list_filter(regexp_split_to_array(p[i], '\s+'), lambda z: z <> ''))) AS BIGINT) AS words,
        count(*) AS numbers FROM {LINES} x""",
)
def _(t):
    path = scratch_folder(t.spark)
    t.documents.select(F.explode(F.split("text", "\n")).alias("value")).select(F.regexp_replace("value", "\r", " ").alias("value")).write.text(path)
    rows = A.read_text_lines(t.spark, path)
    return rows.agg(
        F.count(F.lit(1)).alias("lines"), F.sum("length").alias("characters"), F.sum("word_count").alias("words"), F.countDistinct("file", "line_number").alias("numbers")
    )


@query("read_by_extension", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return A.read_by_extension(t.spark, f"{t.folder}/nation.parquet")


@query(
    "read_many_files",
    "SELECT c_custkey % 2 AS part, count(*) AS n, sum(c_custkey) AS total, CAST(1 AS BIGINT) AS files, CAST(2 AS BIGINT) AS failures FROM customer GROUP BY 1",
)
def _(t):
    # two good folders, one of text that isn't Parquet, one that isn't there
    paths = [saved(t, "parquet", table=t.customer.where(F.col("c_custkey") % 2 == k).select("c_custkey").coalesce(1)) for k in (0, 1)]
    broken = scratch_folder(t.spark)
    t.customer.select("c_name").write.text(broken)
    df, failures = A.read_many_files(t.spark, [*paths, broken, scratch_folder(t.spark)])
    out = df.groupBy((F.col("c_custkey") % 2).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"), F.countDistinct("source_file").alias("files"))
    return out.crossJoin(failures.agg(F.count(F.lit(1)).alias("failures")))


@query("read_jdbc", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    url = f"jdbc:derby:memory:lodestat{abs(hash(t.folder))};create=true"
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    rows.write.format("jdbc").options(url=url, dbtable="customer").mode("overwrite").save()
    last = rows.agg(F.max("c_custkey")).first()[0] or 0
    return A.read_jdbc(t.spark, url, table="customer", partition_column="c_custkey", lower=0, upper=last + 1, partitions=4)


@query("read_write_uri", CUSTOMER)
def _(t):
    uri = scratch_folder(t.spark)
    uri = uri if ":" in uri else f"file://{uri}"
    A.write_csv(t.customer.select(*PICK), uri)
    return A.read_csv(t.spark, uri)


@query("list_objects")
def _(t):
    return A.list_objects(t.spark, saved(t, "parquet"), "*.parquet")


@query(
    "validate_csv",
    """SELECT 'blank header' AS "check", CAST(1 AS BIGINT) AS value, FALSE AS ok UNION ALL SELECT 'duplicate header', 1, FALSE
       UNION ALL SELECT 'row width', count(*) FILTER (c_custkey % 7 = 0), count(*) FILTER (c_custkey % 7 = 0) = 0 FROM customer""",
)
def _(t):
    # header with a blank and a repeated name; every seventh row has a column too many, every fifth repeats the header
    path = scratch_folder(t.spark)
    head = "key,,name,name"
    k = F.col("c_custkey")
    row = F.when(k % 7 == 0, F.concat_ws(",", k, F.lit("x"), "c_name", F.lit('"a,b"'), F.lit("more"))).when(k % 5 == 0, F.lit(head))
    rows = t.customer.select(row.otherwise(F.concat_ws(",", k, F.lit("x"), "c_name", F.lit('"a,b"'))).alias("value"), k.alias("k"))
    rows.union(t.spark.createDataFrame([(head, -1)], "value string, k long")).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return A.validate_csv(t.spark, path)


@query(
    "write_predictions",
    "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(CAST(l_quantity > 25 AS INTEGER) AS VARCHAR) AS prediction, CAST(l_linenumber AS VARCHAR) AS probability_no, CAST(l_linenumber + 1 AS VARCHAR) AS probability_yes FROM lineitem",
)
def _(t):
    path = scratch_folder(t.spark)
    n = F.col("l_linenumber")
    rows = t.lineitem.select("l_orderkey", (F.col("l_quantity") > 25).cast("int").alias("prediction"), F.array(n, n + 1).alias("probability"))
    A.write_predictions(rows, path, "probability", ["no", "yes"])
    return A.read_csv(t.spark, path)


# ---- user functions ----


@query(
    "groupby_apply",
    "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1",
    approx=("total",),
)
def _(t):
    def sums(pdf):
        import pandas as pd

        return pd.DataFrame({"o_orderstatus": [pdf["o_orderstatus"].iloc[0]], "n": [len(pdf)], "total": [pdf["o_totalprice"].sum()]})

    def merge(parts):
        return parts.groupBy("o_orderstatus").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return U.groupby_apply(rows, ["o_orderstatus"], sums, "o_orderstatus string, n long, total double", salt=16, combine=merge)


@query("chunk_apply", "SELECT sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem", approx=("revenue",))
def _(t):
    def part(pdf):
        import pandas as pd

        return pd.DataFrame({"revenue": [(pdf["l_extendedprice"] * (1 - pdf["l_discount"])).sum()], "n": [len(pdf)]})

    rows = t.lineitem.select("l_extendedprice", "l_discount")
    return U.chunk_apply(rows, part, "revenue double, n long", lambda d: d.agg(F.sum("revenue").alias("revenue"), F.sum("n").alias("n")))


@query("column_apply", "SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand FROM part")
def _(t):
    return U.column_apply(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"], F.upper)


@query("feature_functions", "SELECT o_orderkey, year(o_orderdate) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, o_totalprice > 100000 AS big FROM orders")
def _(t):
    steps = [
        lambda d: d.withColumns({"y": F.year("o_orderdate").cast("long"), "m": F.month("o_orderdate")}),
        lambda d: d.withColumn("big", F.col("o_totalprice") > 100000),
    ]
    return U.feature_functions(t.orders, steps).select("o_orderkey", "y", "m", "big")


@query(
    "stream_files",
    "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1",
    approx=("qty",),
)
def _(t):
    from lodestat.streaming import streams as M

    src, out, mark = (scratch_folder(t.spark) for _ in range(3))
    t.lineitem.select("l_returnflag", "l_quantity").repartition(6).write.parquet(src)
    stream = M.file_stream(t.spark, src, "l_returnflag string, l_quantity double", files_per_trigger=2)

    def fold(batch, batch_id):
        part = batch.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
        part.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a repeated batch replaces itself

    M.fold_batches(stream, fold, mark)
    return t.spark.read.parquet(out).groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))
