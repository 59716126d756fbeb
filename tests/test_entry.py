import duckdb
import pytest

import __spark_entry__ as E
from cohortkit.sources.tables import DRIVER_TABLES

SMOKE = "/root/testdata/sf0.001"
SLOW = {"cv_table", "training_summary", "model_test_metrics", "tree_importance", "linear_importance",
        "run_summary", "scored", "scored_external"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMOKE}/{t}.parquet')")
    return con


def _norm(rows):
    import math
    out = []
    for r in rows:
        vals = []
        for v in r:
            if isinstance(v, float):
                v = None if math.isnan(v) else float(f"{v:.9g}")
            elif isinstance(v, bool):
                pass
            elif isinstance(v, int):
                v = float(v)
            elif hasattr(v, "isoformat"):
                v = v.isoformat()
            vals.append(v)
        out.append(tuple(vals))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SMOKE)
    cols = sorted(sdf.columns)
    spark_rows = _norm(tuple(r[c] for c in cols) for r in sdf.collect())
    rel = duck.sql(E.oracle_sql()[key])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    duck_rows = _norm(tuple(r[i] for i in idx) for r in rel.fetchall())
    assert spark_rows == duck_rows
