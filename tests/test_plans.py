import duckdb
import pytest

from interfacet.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", plans.SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    got, want = plans.QUERIES[name](spark, SF), con.sql(plans.SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    one = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    assert one and one == sorted(map(str, want.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_distance_join_is_an_equi_join(spark):
    plan = plans.QUERIES["j4_typed_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
