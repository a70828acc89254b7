from pathlib import Path

import duckdb
import pytest

from paperloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, SF)
    got = c.execute(registry.oracles()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in got.fetchall())


def test_names():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
