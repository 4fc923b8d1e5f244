import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


class Maps:
    """Small graphs as (nodes, edges)."""

    def __init__(self, spark):
        self.spark = spark

    def graph(self, attrs, edges):
        """attrs: {node: (pop, d, r)} or a count of nodes with pop 1."""
        if isinstance(attrs, int):
            attrs = {i: (1.0, 0.0, 0.0) for i in range(attrs)}
        n = self.spark.createDataFrame([(i, *map(float, a)) for i, a in attrs.items()], "node_id long, pop double, votes_d double, votes_r double")
        e = self.spark.createDataFrame([(min(a, b), max(a, b), 1.0, False) for a, b in edges], "u long, v long, weight double, synthetic boolean")
        return n, e

    def plan(self, district, plan_id=0):
        items = district.items() if isinstance(district, dict) else enumerate(district)
        return self.spark.createDataFrame([(plan_id, n, d) for n, d in items], "plan_id long, node_id long, district int")

    def cycle4(self, pop=100, d=50, r=50):
        return self.graph({i: (pop, d, r) for i in range(4)}, [(0, 1), (1, 2), (2, 3), (0, 3)])

    def path(self, n):
        return self.graph(n, [(i, i + 1) for i in range(n - 1)])

    def grid(self, size, seed=0, votes=(300, 500)):
        from plansieve.sources.synthetic import lattice_edges

        rng = np.random.default_rng(seed)
        a = {i: (rng.integers(900, 1100), rng.uniform(*votes), rng.uniform(*votes)) for i in range(size * size)}
        return self.graph(a, [e[:2] for e in lattice_edges(size, size)])


@pytest.fixture(scope="session")
def maps(spark):
    return Maps(spark)


@pytest.fixture(scope="session")
def grid10(maps):
    n, e = maps.grid(10)
    return n.cache(), e.cache()
