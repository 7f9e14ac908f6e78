"""Driver contract and plan shape checks."""

import __spark_entry__ as E
from foldwise.operators import features as fx
from foldwise.plans.inputs import prepared

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"seg", "fold", "n_val", "te", "single_auc", "leak_flag"}
    assert len(rows) > 0


def test_every_oracle_has_a_query():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 100


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_features_have_no_python_node(spark):
    p = prepared(spark, SF)
    out = fx.GroupStat(name="v", key="seg", value="price").oof(p)
    plan = _plan(out)
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "MapInPandas" not in plan


def test_oof_plan_has_no_unpartitioned_window(spark):
    import re
    plan = E.queries()["oof_group_mean"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # a Window with an empty partition spec would pull every row into one task
    assert not re.search(r"Window \[.*\], \[\],", plan)


def test_scan_prunes_columns(spark):
    q = E.queries()["scan_parquet"](spark, SF)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan
