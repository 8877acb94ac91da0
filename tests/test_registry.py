"""The registered queries: same columns as their SQL, same values on small data, and sound plans."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from proofline.plans.catalog import registered  # noqa: E402
from proofline.plans.fixtures import TABLES  # noqa: E402
from proofline.plans.oracle import oracles  # noqa: E402

SF = "/root/testdata/sf0.001"
QUICK = (
    "run_summary", "reconcile_period", "nearest_date_match", "evidence_view", "coverage", "project_grid", "rebuild_cases",
    "followup_dataset", "apply_reviews", "frame_state", "import_ledger", "normalize_id", "parse_report_date",
    "sync_text_status", "fuzzy_id_match", "attach_media", "reminder_digest", "retention_plan", "stream_route",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(oracles()) <= set(registered())
    assert len(set(registered()) - set(oracles())) <= 4


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    df = registered()[name](spark, SF)
    cursor = db.execute(oracles()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.table(df.columns, df.collect()) == check.table(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(registered()))
def test_plan_has_no_pairwise_join_and_no_row_python(spark, name):
    if name.startswith(("stream_", "read_tabular", "read_chat", "incremental", "attach", "tumbling", "safe_csv")):
        pytest.skip("runs jobs while it is built")
    df = registered()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # attempts of the fixture are one cross join with two literal rows
    joins = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    fixture_only = "attempts" in _views(name) or "pairs" in _views(name)
    assert not joins or fixture_only, plan
    assert "BatchEvalPython" not in plan


def _views(name):
    import inspect

    from proofline.plans import catalog

    source = inspect.getsource(catalog._QUERIES[name])
    return source + ("attempts" if "operations()" in source else "")


def test_scan_reads_only_what_is_needed(spark):
    df = registered()["period_filter"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", plan)
