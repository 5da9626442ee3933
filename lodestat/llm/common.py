"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.session import scratch_folder

#: Texts handed to numpy at a time, in bytes.
BLOCK_BYTES = 1 << 21


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs and lost executors start from the files."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def unit_hash(*parts: Column | str, seed: str) -> Column:
    """Uniform number in [0, 1) from the md5 of the seed and the parts, 52 bits."""
    cols = [F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *cols))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def each_text(docs: DataFrame, keys: list[str], fn: Callable[[str], tuple], schema: str, text: str = "text") -> DataFrame:
    """``keys`` and the fields of ``fn(text)`` for every row, in Arrow batches; a missing text counts as empty."""
    source = docs.select(*[F.col(k) for k in keys], whole_text(text).alias("__text"))
    kinds = [f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys]
    full = ", ".join([*kinds, schema])
    out_schema = source.select(keys).sparkSession.createDataFrame([], full).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(t) for t in text_values(batch.column(len(keys)))]
            columns = list(zip(*rows)) if rows else [[] for _ in range(len(arrow_schema) - len(keys))]
            arrays = [batch.column(i).cast(arrow_schema.field(i).type) for i in range(len(keys))]
            arrays += [pa.array(c, type=arrow_schema.field(len(keys) + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    return source.mapInArrow(run, out_schema)


def text_values(column: pa.Array) -> Iterator[str]:
    """The texts one by one, so that a batch is never held twice."""
    for value in column:
        yield value.as_py()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch and the n + 1 offsets, without copying; no nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text is a run of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def splitmix(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
