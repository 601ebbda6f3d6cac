"""Queries whose relations take in whole tables, against their SQL on larger tables than test_entry's."""

import os

import duckdb
import pytest

from sparkloom.plans import catalogue
from tests.test_entry import plain

FOLDER = os.environ.get("TEST_WHOLE_DIR", "/root/testdata/sf0.01")
USAGES = ["dependency_edges", "external_coupling", "coupling_scores", "cohesion_scores", "dead_exports", "file_linkage", "symbol_routes", "exported_symbols", "imported_symbols", "external_packages", "inline_types"]
WHOLE = ["import_statements", "barrel", "barrel_additions", "reexport_hop", "merge_suggestions", "class_cohesion", *USAGES]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", WHOLE)
def test_all_rows_count(spark, sql, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = sql.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    want = sorted(tuple(map(plain, r)) for r in want.project(",".join(f'"{c}"' for c in columns)).fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(columns).collect()) == want


def test_class_cohesion_counts_all_lines(spark, tmp_path):
    spark.createDataFrame([(s, 0) for s in range(3)], "s_suppkey bigint, s_nationkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 1), (1, 1), (2, 20)], "l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.QUERIES["class_cohesion"](spark, str(tmp_path)).select("cls", "methods", "lcom4", "tcc", "lcc").collect()
    assert [tuple(r) for r in found] == [(0, 3, 2, 0.333, 0.333)]
