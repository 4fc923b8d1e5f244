"""Rows that are exploded from few must not be collected in the driver to be broadcast."""

import os

import pytest

from plansieve import queries

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")
CONF = {"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.maxBroadcastTableSize": "1100000"}


@pytest.fixture
def small_broadcasts(spark):
    """Broadcasts are those Spark plans from file sizes, and one of all plans' nodes (30,000 rows) fails; one of the map's (1,500) doesn't."""
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k in CONF:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", ["boundary_edges", "plan_from_array", "efficiency_gap", "mean_median", "seats_votes", "modularity", "polsby_popper", "district_connected"])
def test_no_broadcast_of_exploded_rows(small_broadcasts, name):
    queries.QUERIES[name](small_broadcasts, DIR).write.format("noop").mode("overwrite").save()
