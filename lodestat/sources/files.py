"""Readers and writers for files, object-store URIs and relational databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions import ordering as O

DELIMITERS = [",", ";", "\t", "|"]  # fixed values, in the order that breaks ties
SPARK_NAMES = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1"}  # what the CSV reader decodes itself
ENCODINGS = ["utf-8", "utf-8-sig", "cp949", "euc-kr", "latin-1"]  # fixed values, tried in order


def detect_delimiter(spark: SparkSession, path: str) -> DataFrame:
    """``(delimiter, cnt)`` of the most frequent delimiter of the header line."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1)
    counts = F.array(
        *[
            F.struct((-(F.length("value") - F.length(F.replace("value", F.lit(d))))).alias("neg"), F.lit(i).alias("i"), F.lit(d).alias("delimiter"))
            for i, d in enumerate(DELIMITERS)
        ]
    )
    best = head.select(F.element_at(F.array_sort(counts), 1).alias("b"))
    return best.select(F.when(F.col("b.neg") < 0, F.col("b.delimiter")).otherwise(",").alias("delimiter"), (-F.col("b.neg")).alias("cnt"))


def read_csv(
    spark: SparkSession, path: str, sep: str = "auto", header: bool = True, columns: list[str] | None = None,
    schema: T.StructType | str | None = None, encoding: str | None = "utf-8", max_rows: int | None = None, skip_rows: int = 0,
    dtypes: dict[str, str] | None = None,
) -> DataFrame:
    """CSV as strings unless a schema is given; short rows are padded with null.

    ``encoding=None`` takes the first of ``ENCODINGS`` in which every line decodes. ``skip_rows`` leaves out lines at the head of each
    file, before the header. ``dtypes`` casts named columns; a value that doesn't cast becomes null.
    """
    if encoding is None:
        encoding = fitting_encoding(spark, path)
    if skip_rows or encoding.lower() in ENCODINGS and encoding.lower() not in SPARK_NAMES:
        return _cast(_csv_after(spark, path, sep, header, columns, skip_rows, encoding, max_rows), dtypes)
    if sep == "auto":
        got = detect_delimiter(spark, path).first()
        sep = got["delimiter"] if got else ","
    reader = spark.read.options(sep=sep, header=str(header).lower(), quote='"', escape='"', encoding=SPARK_NAMES.get(encoding, encoding))
    reader = reader.option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true")
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    df = df.select(*columns) if columns else df
    return _cast(df.limit(max_rows) if max_rows else df, dtypes)


def _cast(df: DataFrame, dtypes: dict[str, str] | None) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in (dtypes or {}).items()})


def fitting_encoding(spark: SparkSession, path: str) -> str:
    """The first of ``ENCODINGS`` in which all lines decode; the last one decodes anything."""

    def undecodable(batches):
        import pyarrow as pa

        for batch in batches:
            bad = [0] * len(ENCODINGS)
            for line in batch.column("value"):
                for i, name in enumerate(ENCODINGS):
                    try:
                        line.as_py().decode(name)
                    except UnicodeDecodeError:
                        bad[i] += 1
            yield pa.RecordBatch.from_pydict({"encoding": pa.array(range(len(ENCODINGS)), pa.int32()), "bad": pa.array(bad, pa.int64())})

    # read as Latin-1, where every byte is a character, and turn back into bytes
    lines = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\x01", quote="", schema="value string")
    lines = lines.select(F.encode("value", "ISO-8859-1").alias("value")).where("value IS NOT NULL")
    bad = {r["encoding"]: r["bad"] for r in lines.mapInArrow(undecodable, "encoding int, bad long").groupBy("encoding").agg(F.sum("bad").alias("bad")).collect()}
    return ENCODINGS[min(i for i in range(len(ENCODINGS)) if not bad.get(i))]


def _csv_after(spark: SparkSession, path: str, sep: str, header: bool, columns: list[str] | None, skip_rows: int, encoding: str, max_rows: int | None) -> DataFrame:
    """CSV whose first ``skip_rows`` lines per file are no data, in any encoding. Lines are numbered in file order, so quoted fields can't span lines here."""
    import pandas as pd

    lines = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\x01", quote="", schema="value string")
    raw = F.encode("value", "ISO-8859-1")
    if encoding in SPARK_NAMES:
        value = F.decode(raw, SPARK_NAMES[encoding])
    else:
        value = F.pandas_udf(lambda s: pd.Series([b.decode(encoding, "replace") for b in s]), "string")(raw)
    lines = lines.where("value IS NOT NULL").select(
        value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")
    )
    lines = O.with_position(lines, ["_start", "_id"], ["file"], "_pos", None).where(F.col("_pos") >= skip_rows)
    head = lines.orderBy("file", "_pos").select("value").first()
    if head is None:
        return spark.createDataFrame([], "value string").limit(0)
    if sep == "auto":
        counts = [(-head[0].count(d), i) for i, d in enumerate(DELIMITERS)]
        sep = DELIMITERS[min(counts)[1]] if min(counts)[0] < 0 else ","
    import csv

    first = [c.strip() for c in next(csv.reader([head[0]], delimiter=sep))]
    names = first if header else [f"_c{i}" for i in range(len(first))]
    body = lines.where(F.col("_pos") > skip_rows) if header else lines
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    row = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), options)
    df = body.select(row.alias("r")).select("r.*")
    df = df.select(*columns) if columns else df
    return df.limit(max_rows) if max_rows else df


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_json(spark: SparkSession, path: str, array_path: str | None = None, lines: bool = False, schema=None) -> DataFrame:
    """Array, object or line documents; ``array_path`` walks a dotted path to the record array."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.json(path, multiLine=not lines)
    return df.select(F.inline(F.col(array_path))) if array_path else df


def json_flatten(df: DataFrame, max_depth: int = 10) -> DataFrame:
    """Nested structs to ``a.b.c`` columns; arrays stay."""

    def walk(schema, prefix, depth):
        for f in schema.fields:
            path = [*prefix, f.name]
            if isinstance(f.dataType, T.StructType) and depth < max_depth:
                yield from walk(f.dataType, path, depth + 1)
            else:
                yield F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path))

    return df.select(*walk(df.schema, [], 0))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow IPC files, one file per task step, batches streamed out."""
    return arrow_rows(spark.read.format("binaryFile").load(path), schema)


def arrow_rows(files: DataFrame, schema: str) -> DataFrame:
    """Rows of Arrow IPC files held in the binary column ``content``, one record batch at a time."""

    def load(batches):
        import pyarrow as pa
        from pyarrow import ipc

        for batch in batches:
            for content in batch.column("content"):
                reader = ipc.open_file(pa.BufferReader(content.as_buffer()))
                for i in range(reader.num_record_batches):
                    yield from pa.Table.from_batches([reader.get_batch(i)]).to_batches(max_chunksize=10_000)

    return files.select("content").mapInArrow(load, schema)


def read_text_lines(spark: SparkSession, path: str, skip_empty: bool = False) -> DataFrame:
    """``(file, line_number, content, length, word_count)``; numbers start at 1 in each file.

    Line numbers come from the file's own order: the reader keeps rows of a
    split in order, and splits of a file follow their block start.
    """
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")
    )
    pos = O.with_position(rows, ["_start", "_id"], ["file"], "_pos", None)
    words = F.size(F.filter(F.split("value", r"\s+"), lambda w: w != ""))
    out = pos.select("file", (F.col("_pos") + 1).alias("line_number"), F.col("value").alias("content"), F.length("value").alias("length"), words.alias("word_count"))
    return out.where(F.trim("content") != "") if skip_empty else out


READERS = {".csv": read_csv, ".txt": read_text_lines, ".tsv": read_tsv, ".json": read_json, ".parquet": read_parquet, ".feather": read_feather}


def read_by_extension(spark: SparkSession, path: str, **options) -> DataFrame:
    """Dispatch on the suffix; an unsupported suffix gives one error row."""
    for suffix, reader in READERS.items():
        if path.rstrip("/").lower().endswith(suffix):
            return reader(spark, path, **options)
    return spark.createDataFrame([(path, f"unsupported file type: {path.rpartition('.')[2]}")], "path string, error string")


def check_files(spark: SparkSession, paths: list[str], fmt: str = "parquet", **options) -> dict[str, str]:
    """Path to error for each path that is missing or can't be opened (its footer or first record doesn't parse)."""
    failed = {}
    for path in paths:
        try:
            spark.read.format(fmt).options(**options).load(path).limit(1).collect()
        except Exception as e:  # the reader's own error is what is reported
            failed[path] = f"{type(e).__name__}: {str(e).strip().splitlines()[0][:300]}"
    return failed


def read_many_files(spark: SparkSession, paths: list[str], fmt: str = "parquet", schema=None, **options) -> tuple[DataFrame, DataFrame]:
    """``(rows, failures)``: one frame over the readable files with the file name kept, and ``(file, error)`` of the others.

    Readable files are then read strictly: one that breaks later fails the job instead of losing rows.
    """
    failed = check_files(spark, paths, fmt, **options)
    failures = spark.createDataFrame(sorted(failed.items()), "file string, error string")
    good = [p for p in paths if p not in failed]
    if not good:
        raise ValueError(f"no readable file: {failed}")
    reader = spark.read.format(fmt).options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load(good).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)), failures


def list_objects(spark: SparkSession, prefix: str, pattern: str = "*") -> DataFrame:
    """``(path, length, modified)`` below a URI prefix; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(prefix)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def read_jdbc(
    spark: SparkSession, url: str, query: str | None = None, table: str | None = None, partition_column: str | None = None,
    lower: int = 0, upper: int = 0, partitions: int = 8, **options,
) -> DataFrame:
    """A query or table of a relational store, read in parallel ranges of ``partition_column``."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if query is not None and partition_column is None:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table if query is None else f"({query}) q")
    if partition_column is not None:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return reader.load()


def list_tables(spark: SparkSession, url: str, **options) -> DataFrame:
    query = "SELECT table_schema, table_name FROM information_schema.tables"
    if url.startswith("jdbc:derby"):
        query = "SELECT tablename AS table_name FROM sys.systables WHERE tabletype = 'T'"
    return read_jdbc(spark, url, query=query, **options)


def write_csv(df: DataFrame, uri: str, mode: str = "overwrite", **options) -> None:
    df.write.mode(mode).options(header="true", **options).csv(uri)


def write_predictions(df: DataFrame, uri: str, probability: str | None = None, classes: list | None = None, fmt: str = "csv") -> None:
    """Input rows with the prediction, and one probability column per class when asked."""
    if probability is not None:
        df = df.withColumns({f"probability_{c}": F.col(probability)[i] for i, c in enumerate(classes)}).drop(probability)
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(uri) if fmt == "csv" else writer.parquet(uri)


def validate_csv(spark: SparkSession, path: str, sep: str = ",", limit: int | None = None) -> DataFrame:
    """``(check, value, ok)``: header names blank or repeated, rows whose width differs from the header.

    All rows are checked unless ``limit`` asks for the leading ones only.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    # the header is the first line of each file by position: a later line with the same text is a row
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    first = lines.groupBy("file").agg(F.min_by("id", F.struct("start", "id")).alias("first_id"), F.min_by("value", F.struct("start", "id")).alias("header"))
    head = first.orderBy("file").select("header").first()
    names = [h.strip().strip('"') for h in (head[0].split(sep) if head else [])]
    blank, again = sum(1 for h in names if not h), len(names) - len(set(names))
    # a separator inside quotes is no column break
    bare = F.regexp_replace("value", '"[^"]*"', "")
    body = lines.join(first, "file").where(F.col("id") != F.col("first_id"))
    body = body.limit(limit) if limit else body
    width = F.size(F.split(bare, f"[{sep}]", -1))
    rows = body.agg(F.count_if(width != len(names)).alias("bad")).select(F.lit("row width").alias("check"), F.col("bad").alias("value"), (F.col("bad") == 0).alias("ok"))
    fixed = spark.createDataFrame([("blank header", blank, blank == 0), ("duplicate header", again, again == 0)], "check string, value long, ok boolean")
    return fixed.unionByName(rows)
