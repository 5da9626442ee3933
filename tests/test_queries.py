"""Every registered query against its SQL on the smallest tables; rows-only where there is no SQL."""

import os

import duckdb
import pytest

import check
from lodestat import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, con, name):
    verdict = check.compare(spark, con, FOLDER, name, plans.QUERIES[name], plans.SQL[name])
    assert verdict.startswith("ok"), verdict


FAST_ROWS_ONLY = [
    "corr_test", "normality", "dagostino_pearson", "shapiro_wilk", "fisher_exact", "qq_points", "qq_grid", "data_profile",
    "pca_variance", "kmeans_centers", "acf_pacf", "list_objects", "read_jdbc",
]


@pytest.mark.parametrize("name", FAST_ROWS_ONLY)
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(plans.SQL) <= set(plans.QUERIES)
