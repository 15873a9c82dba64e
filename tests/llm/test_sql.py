"""Every query of this subpackage that has SQL gives DuckDB's rows, on the smallest tables and on those of edge cases."""

import glob
import os

import duckdb
import pytest
from test_oracles import DATA, rows

from barloom.llm import registry


@pytest.mark.parametrize("folder", [DATA, 0, 1], ids=["smallest", "edges", "empty"])
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query(spark, tables, name, folder):
    folder = tables[folder] if isinstance(folder, int) else folder
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' * os.path.isdir(path)}'")
    got, want = registry.queries()[name](spark, folder).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
