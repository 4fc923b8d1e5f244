"""Broadcasts hold few rows: never rows that are exploded from few."""

import os

import pytest

from plansieve import queries

DIR = "/root/testdata/sf0.01"
FEW = 2000  # nodes of the map are 1,500, resamples of all metrics 2,000; rows of all plans are 30,000
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


@pytest.fixture
def by_file_size(spark):
    """Broadcasts are those Spark plans from file sizes, as on large tables."""
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.unset(key)


def broadcast_rows(spark, run):
    """Rows of each broadcast made meanwhile, from the metrics of the plans as they were executed."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    out, each = [], store.executionsList()
    for i in range(before, each.size()):
        e = each.apply(i).executionId()
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for k in range(nodes.size()):
            if nodes.apply(k).name() != "BroadcastExchange":
                continue
            metrics = nodes.apply(k).metrics()
            for m in map(metrics.apply, range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def test_broadcasts_are_seen(by_file_size):
    few, many = by_file_size.range(70), by_file_size.range(5000)
    assert broadcast_rows(by_file_size, lambda: many.join(few.hint("broadcast"), "id").write.format("noop").mode("overwrite").save()) == [70]


@pytest.mark.parametrize("name", [
    "all_metrics",
    "all_metrics_relational",
    "connected_after_flip",
    "diameter_two_bfs",
    "direction",
    "flip_log_totals",
    "mean_and_std",
    "mst_diameter",
    "mst_tree_diameter",
    "outlier_table",
    "plan_outliers",
    "reock",
    "repair_contiguity",
    "severity",
    "mcmc_samples",
])
def test_no_broadcast_of_exploded_rows(by_file_size, name):
    rows = broadcast_rows(by_file_size, lambda: queries.QUERIES[name](by_file_size, DIR).write.format("noop").mode("overwrite").save())
    assert max(rows, default=0) <= FEW
