"""Readers on awkward files: encodings, lines before the header, broken and missing files."""

import pytest

from lodestat.sources import files as A


@pytest.mark.parametrize(("encoding", "name"), [("utf-8", "é한"), ("cp949", "한글"), ("latin-1", "é\xa0ÿ")])
def test_encoding_is_found(spark, tmp_path, encoding, name):
    path = tmp_path / "t.csv"
    path.write_bytes(f"id,name\n1,{name}\n2,b\n".encode(encoding))
    got = {r["id"]: r["name"] for r in A.read_csv(spark, str(path), encoding=None).collect()}
    assert got == {"1": name, "2": "b"}
    assert A.fitting_encoding(spark, str(path)) == encoding


def test_rows_before_the_header_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('made by hand\n\nid;x\n1;2.5\n2;"a;b"\n')
    df = A.read_csv(spark, str(tmp_path / "a.csv"), skip_rows=1, dtypes={"id": "int", "x": "double"})
    assert df.dtypes == [("id", "int"), ("x", "double")]
    assert sorted(map(tuple, df.collect())) == [(1, 2.5), (2, None)]


def test_many_files_report_failures(spark, tmp_path):
    good, bad = str(tmp_path / "good.parquet"), str(tmp_path / "bad.parquet")
    spark.range(5).write.parquet(good)
    (tmp_path / "bad.parquet").write_text("not parquet")
    rows, failures = A.read_many_files(spark, [good, bad, str(tmp_path / "none.parquet")])
    assert rows.count() == 5
    assert {r["file"] for r in failures.collect()} == {bad, str(tmp_path / "none.parquet")}
    with pytest.raises(ValueError, match="no readable file"):
        A.read_many_files(spark, [bad])


def test_feather_by_extension(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    feather.write_feather(pa.table({"a": list(range(25_000))}), str(tmp_path / "t.feather"), compression="uncompressed")
    assert A.read_by_extension(spark, str(tmp_path / "t.feather"), schema="a long").selectExpr("sum(a)").first()[0] == sum(range(25_000))


def test_positions_of_names_with_a_long_common_head(spark):
    from pyspark.sql import functions as F

    from lodestat.functions import ordering as O

    df = spark.range(3000).select(F.concat(F.lit("https://example.com/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("u"), "id").repartition(5)
    got = O.with_position(df, ["u"], None, "p", None)
    assert got.where("p <> id").count() == 0
    skip = df.agg(O.common_bytes(F.min("u"), F.max("u"))).first()[0]
    assert df.select(O.string_number(F.col("u"), F.lit(skip))).distinct().count() == 3000
