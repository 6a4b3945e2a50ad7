"""Queries against their SQL in DuckDB: on the smallest driver tables and on edge rows."""

import os
from collections import Counter

import duckdb
import pytest

from arealis.llm import oracles, queries

DATA = "/root/testdata/sf0.001"


def _compare(spark, name, path):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{path}/{t}.parquet') else ''}'")
    want = con.execute(oracles.SQL[name])
    columns = sorted(c[0] for c in want.description)
    got = queries.queries()[name](spark, path)
    assert sorted(got.columns) == columns
    names = [c[0] for c in want.description]
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter(want.fetchall())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_driver_tables(spark, name):
    _compare(spark, name, DATA)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_edges(spark, tmp_path, name):
    item = " ".join(f"k{i}" for i in range(20))
    texts = [None, "", " \t ", "a", "A b", "a B", item, item.upper() + ".", "x " + item[:-4] + " y", " ".join(f"u{i % 7}" for i in range(90)), " ".join(f"u{i % 7}" for i in range(90)), "k3 é k5 K6", "b\x0bc\x1cd"]
    rows = [(i, t, [None, "en", "", "fr", "é"][i % 5], [None, "s1", "s2"][i % 3], None if i == 4 else len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(0, 13, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "k3"), (3, None), (4, "--"), (1, item), (5, "K5 k6 zz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _compare(spark, name, str(tmp_path))


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_filter_audit"])
def test_ties_and_clashing_names(spark, tmp_path, name):
    """Ids that repeat or are null, equal rows, labels that contradict each other, a text of a megabyte, and columns named like the operators' own."""
    long = " ".join(f"w{i}" for i in range(150_000))
    same = (3, "Same TEXT", "en", "s", 9)
    rows = [same, same, (3, "Same TEXT", "en", "t", 9), (3, "other", None, "s", None), (None, "Same TEXT", "en", "s", 1), (None, None, None, None, None), (1, "Same TEXT", "de", "", 2), (7, long, "en", "s", 5), (8, long, "en", None, 5), (9, "", "", "", 0)]
    wide = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS words", "'x' AS g", "2 AS at", "true AS good", "'y' AS leaf", "0L AS n")
    wide.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 0, 1), (3, 1, 0), (7, 1, None), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    _compare(spark, name, str(tmp_path))


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_filter_audit"])
def test_no_rows(spark, tmp_path, name):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0
