import duckdb
import pytest

import __spark_entry__
from tessera.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, data).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    flat = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).itertuples(index=False)))
    assert flat(got) == flat(want) and len(got)


def test_registered():
    known = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in known if q.startswith("op")} and "pipeline" in known
