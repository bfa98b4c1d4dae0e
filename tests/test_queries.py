from __future__ import annotations

import __spark_entry__ as contract
import pytest
from compare import connect, differences
from conftest import plan_of

from skyfold.plans.registered import QUERIES as REGISTERED

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in contract.queries().items() if name in REGISTERED}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in REGISTERED}


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_an_expected_result():
    assert set(QUERIES) == set(ORACLES) == set(REGISTERED)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    assert differences(QUERIES[name](spark, SF_DIR), connection, ORACLES[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("catalog_stream", "catalog_format_", "log_", "csv_"))])
def test_plan_stays_in_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "Python" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = plan_of(QUERIES["min_observations_verdicts"](spark, SF_DIR))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_binning_parses_the_catalogue_once(spark):
    assert "from_json" not in plan_of(QUERIES["catalog_binned"](spark, SF_DIR))
