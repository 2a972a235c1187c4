"""Every query of the catalogue against its SQL, and the plans one would want."""

import os
import subprocess
import sys

import duckdb
import pytest

from tessera.operators import joins
from tessera.plans import catalogue


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for name in ("embeddings",):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return sorted(map(tuple, frame.itertuples(index=False)))


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_against_sql(spark, data, duck, name):
    got, want = catalogue.QUERIES[name](spark, data).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


def test_balanced_assignment_fills_clusters_evenly(spark, data):
    sizes = [r["count"] for r in catalogue.balanced_assignment(spark, data).groupBy("cluster").count().collect()]
    assert sum(sizes) == 500 and max(sizes) <= 50


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    for df in (joins.threshold_join(v, None, 1.0), joins.knn_join(v, None, 3)):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
        assert "label" not in p[p.index("== Physical Plan =="):]  # only the columns needed are read
        assert "FlatMapCoGroupsInArrow" in p


def test_runs_without_the_optional_part(tmp_path):
    """The engine imports nothing of the training-data operators."""
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tessera.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e, bench\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and 'threshold_self_join' in e.queries() and 'pipeline' not in e.queries()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
