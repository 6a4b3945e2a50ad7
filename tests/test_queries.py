"""Queries against their oracle SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from arealis.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each family; the driver compares all of them.
SAMPLE = ["c03_invert", "c08_standardized", "c09_shuffle", "c12_power", "r03_empirical_bayes", "r05_spatial_empirical_bayes", "t12_merge_key", "t17_time_alignment", "d06_hinges", "d07_hazen_percentiles", "s06_add_neighbours", "s12_line", "w02_rook", "w04_order_3", "w06_distance_band", "w08_knn_irregular", "w09_arc_distance", "w09_arc_knn", "w09_arc_knn_globe", "l01_spatial_lag", "a05_moran_permutations", "flagship_lisa_revenue", "a17_save_g", "m02_quantile_5", "m04_box_15", "v01_histogram", "v12_conditional_cells", "g02_centroid", "o03_fit", "o09_lm_error", "a15_g_pseudo_p", "a18_g_by_period", "io01_dbf_round_trip", "io06_polygon_round_trip", "io08_csv_round_trip", "io12_gal_round_trip", "io13_gwt_round_trip"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


def rows(pdf):
    columns = sorted(pdf.columns)
    return sorted((tuple("~" if x is None or x != x else round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in pdf[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
