"""How often ordered queries read a table, and how often they shuffle, as planned."""

import os
import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

from loamstream.catalog.all import QUERIES  # noqa: E402

# most scans of one table, most exchanges
LIMITS = {
    "MGT-08": (2, 12), "DQ-01": (1, 4), "DQ-04": (1, 26), "DQ-09": (1, 4), "DQ-11": (2, 8), "DQ-12": (2, 10), "DQ-13": (1, 4), "BAT-02": (1, 4),
    "CLK-01": (1, 4), "CLK-02": (2, 8), "CLK-03": (2, 8), "CLK-04": (2, 6), "EVT-11": (0, 24), "EVT-14": (4, 12), "MGT-13": (2, 8), "EVT-15": (4, 16),
}


@pytest.mark.parametrize("name", sorted(LIMITS))
def test_scans_and_exchanges(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = Counter(re.findall(r"sf0\.001/(\w+)\.parquet", plan))
    most, exchanges = LIMITS[name]
    assert max(scans.values(), default=0) <= most and len(re.findall(r"\bExchange ", plan)) <= exchanges
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["SRC-09", "SRC-10"])
def test_ranges_come_from_footers(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedAggregation: \[(MIN|COUNT)", plan) and "PushedGroupBy: [kind, granularity, year]" in plan
