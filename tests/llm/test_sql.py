"""Every query of this subpackage with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from readloom.llm import queries

#: Rules get certified cutoffs only where there are labels enough.
CASES = [(name, "sf0.001") for name in sorted(queries.SQL)] + [("op7_quality_rules", "sf0.1")]


@pytest.mark.parametrize(("name", "size"), CASES)
def test_equal(spark, name, size):
    import duckdb

    data = f"/root/testdata/{size}"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{data}/{file}'")
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == Counter(result.fetchall())
    if size != "sf0.001":
        assert any(r[columns.index("rule")] not in (None, "base") for r in got)
