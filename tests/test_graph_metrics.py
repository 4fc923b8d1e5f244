import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansieve.operators import graph, metrics
from plansieve.operators.partition import district_totals
from plansieve.plans import kernels as k


# fixed values: the small graphs below and what is expected of them


def value(df, name, plan=0):
    return df.where(f"plan_id = {plan}").first()[name]


def test_cut_and_modularity(maps):
    _, e = maps.cycle4()
    half, one = maps.plan([0, 0, 1, 1]), maps.plan([0] * 4, 1)
    both = half.unionByName(one)
    cut, q = metrics.cut_edge_ratio(e, both), metrics.modularity(e, both)
    assert value(cut, "cut_edge_ratio") == 0.5 and value(cut, "cut_edge_ratio", 1) == 0.0
    assert value(q, "modularity") == pytest.approx(0.0) and value(q, "modularity", 1) == pytest.approx(0.0)
    _, none = maps.graph(2, [])
    assert value(metrics.cut_edge_ratio(none, maps.plan([0, 1])), "cut_edge_ratio") == 0.0


def test_two_triangles(maps):
    _, e = maps.graph(6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)])
    assert value(metrics.modularity(e, maps.plan([0, 0, 0, 1, 1, 1])), "modularity") == pytest.approx(5 / 14)


@pytest.mark.parametrize(
    "edges, sweep, tree",
    [
        ([(i, i + 1) for i in range(4)], 4, 4),
        ([(0, i) for i in range(1, 5)], 2, 2),
        ([(0, 1), (1, 2), (2, 3), (0, 3)], 2, 3),
        ([(0, 3), (0, 6), (1, 3), (1, 4), (1, 6), (2, 3), (2, 6), (3, 4), (3, 5), (4, 5)], 2, None),
    ],
)
def test_diameters(maps, edges, sweep, tree):
    n = max(map(max, edges)) + 1
    _, e = maps.graph(n, edges)
    p = maps.plan([0] * n)
    assert value(metrics.mst_diameter(e, p), "mst_diameter") == sweep
    if tree:
        assert value(metrics.mst_tree_diameter(e, p), "mst_tree_diameter") == tree


def test_only_the_start_component_counts():
    g = k.Graph(range(6), [0, 2, 3, 4], [1, 3, 4, 5])
    assert k.double_sweep(g) == 1


def test_efficiency_gap_signs_and_ties(maps):
    n, _ = maps.cycle4(d=60, r=40)
    totals = district_totals(n, maps.plan([0, 0, 1, 1]))
    assert value(metrics.efficiency_gap(totals), "efficiency_gap") == pytest.approx(0.30)
    n, _ = maps.cycle4()
    totals = district_totals(n, maps.plan([0, 0, 1, 1]))
    assert value(metrics.efficiency_gap(totals), "efficiency_gap") == pytest.approx(-0.5)
    assert value(metrics.mean_median(totals), "mean_median") == 0.0
    n, _ = maps.cycle4(d=0, r=0)
    totals = district_totals(n, maps.plan([0, 0, 1, 1]))
    assert value(metrics.efficiency_gap(totals), "efficiency_gap") == 0.0 and value(metrics.mean_median(totals), "mean_median") == 0.0
    assert metrics.seats_votes_curve(totals).where("statewide_d_share between 0.49 and 0.51").count() > 0


def test_seats_path(maps):
    n, _ = maps.graph({i: (1, 30 + 10 * i, 60 - 5 * i) for i in range(6)}, [(i, i + 1) for i in range(5)])
    totals = district_totals(n, maps.plan([0, 0, 1, 1, 2, 2]))
    seats = [r["expected_d_seats"] for r in metrics.seats_votes_curve(totals, 0.3, 11).orderBy("point_idx").collect()]
    assert seats == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3, 3]
    assert value(metrics.mean_median(totals), "mean_median") == pytest.approx(-0.0093752289)
    assert value(metrics.efficiency_gap(totals), "efficiency_gap") == pytest.approx(0.1260162602)


def test_grid_goldens(maps, grid10):
    n, e = grid10
    p = maps.plan([2 * (i // 10 // 5) + (i % 10) // 5 for i in range(100)])
    m = metrics.all_metrics(n, e, p).first()
    assert m["cut_edge_ratio"] == pytest.approx(0.1111111111) and m["modularity"] == pytest.approx(0.6388888889)
    assert m["efficiency_gap"] == pytest.approx(-0.2407277211) and m["mean_median"] == pytest.approx(0.0043439498)
    assert m["mst_diameter"] == 8.0
    assert list(m.asDict()) == ["plan_id", "cut_edge_ratio", "mst_diameter", "modularity", "efficiency_gap", "mean_median"]
    seats = [r["expected_d_seats"] for r in metrics.seats_votes_curve(district_totals(n, p), 0.2, 9).orderBy("point_idx").collect()]
    assert seats == [0, 0, 0, 0, 1, 4, 4, 4, 4]


def test_registered_metric(maps):
    n, e = maps.cycle4()
    metrics.register_metric("districts", lambda nodes, edges, a: a.groupBy("plan_id").agg(F.countDistinct("district").cast("double").alias("value")))
    assert metrics.metric("districts", n, e, maps.plan([0, 1, 2, 2])).first()["value"] == 3.0


def test_components_and_contiguity(maps):
    n, e = maps.graph(7, [(0, 1), (1, 2), (4, 5)])
    assert {r["node_id"]: r["component"] for r in graph.components(n, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    _, e = maps.path(5)
    ok = {(r["plan_id"], r["district"]): r["connected"] for r in k.connectivity(e, maps.plan([0, 0, 1, 0, 0]).unionByName(maps.plan([0, 0, 0, 1, 1], 1))).collect()}
    assert ok == {(0, 0): False, (0, 1): True, (1, 0): True, (1, 1): True}


def test_contiguity_after_flip():
    g = k.Graph(range(5), range(4), range(1, 5))
    assert g.connected(set()) and g.connected({3}) and g.connected({0, 1, 2, 3, 4}) and not g.connected({0, 1, 3, 4})
    plan = {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}
    assert not k.connected_after_flip(g, plan, 1, 1)
    assert k.connected_after_flip(g, plan, 2, 1) and k.connected_after_flip(g, plan, 2, 0)
    g = k.Graph(range(3), range(2), range(1, 3))
    assert not k.connected_after_flip(g, {0: 1, 1: 0, 2: 1}, 1, 1)


def test_label_propagation_agrees_with_search(maps):
    import numpy as np

    rng = np.random.default_rng(5)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (45, 2)) if a != b})
    n, e = maps.graph(60, edges)
    g = k.Graph(range(60), *zip(*edges, strict=True))
    want = {p: min(part) for part in g.parts(set(range(60))) for p in part}
    for way in (graph._components_at_once, graph._components_in_rounds):
        assert {r["node_id"]: r["component"] for r in way(n, e).collect()} == want


def box(x1, y1, x2, y2):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))]]


def precincts(spark, *boxes):
    rows = [(i, 100.0, 50.0, 50.0, int(i > 1), b) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "node_id long, pop double, votes_d double, votes_r double, district int, rings array<array<struct<x:double,y:double>>>")


def test_squares(spark, maps):
    p = precincts(spark, box(0, 0, 1, 1), box(1, 0, 2, 1), box(2, 0, 3, 1))
    n, e = graph.build_graph(p, district="district")
    assert sorted((r["u"], r["v"], round(r["weight"], 9)) for r in e.collect()) == [(0, 1, 1.0), (1, 2, 1.0)]
    assert {"pop", "votes_d", "votes_r", "district"} <= set(n.columns) and n.count() == 3
    plan = maps.plan([0, 0, 1])
    assert value(metrics.polsby_popper(p, None, plan), "polsby_popper") == pytest.approx(0.7417649321)
    assert value(metrics.reock(p, plan), "reock") == pytest.approx(0.5729577951)


def test_island_and_corner(spark):
    n, e = graph.build_graph(precincts(spark, box(0, 0, 1, 1), box(1, 0, 2, 1), box(10, 0, 11, 1)))
    assert [(r["u"], r["v"], r["weight"]) for r in e.where("synthetic").collect()] == [(1, 2, 9.0)]
    assert graph.graph_summary(n, e).first()["is_connected"]
    _, e = graph.build_graph(precincts(spark, box(0, 0, 1, 1), box(1, 1, 2, 2)), stitch=False)
    assert e.isEmpty()


def test_partial_and_slanted_borders(spark):
    slant = [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 2.0), (0.0, 4.0), (0.0, 0.0))]]
    other = [[{"x": x, "y": y} for x, y in ((2.0, 1.0), (6.0, 3.0), (6.0, 0.0), (2.0, 1.0))]]
    _, e = graph.build_graph(precincts(spark, box(0, 0, 2, 1), box(1, 1, 5, 3)), stitch=False)
    assert e.first()["weight"] == pytest.approx(1.0)
    _, e = graph.build_graph(precincts(spark, slant, other), stitch=False)
    assert e.first()["weight"] == pytest.approx(math.hypot(2, 1))


def test_holes_and_projection(spark):
    from plansieve.functions import geometry as geo

    rings = box(0, 0, 4, 4) + box(1, 1, 2, 2)
    df = precincts(spark, rings)
    c = geo.centroid(F.col("rings"))
    row = df.select(geo.area(F.col("rings")), geo.perimeter(F.col("rings")), c["x"], geo.contains(F.col("rings"), F.lit(1.5), F.lit(1.5)), geo.contains(F.col("rings"), F.lit(3.0), F.lit(3.0))).first()
    assert row[:2] == (15.0, 20.0) and row[2] == pytest.approx((32 - 1.5) / 15) and row[3:] == (False, True)
    x, y = geo.albers(F.lit(-96.0), F.lit(23.0))
    assert spark.range(1).select(x, y).first() == (pytest.approx(0.0, abs=1e-6), pytest.approx(0.0, abs=1e-6))
    x, y = geo.albers(F.lit(-75.0), F.lit(35.0))  # the published worked example is on another ellipsoid, about 1885 km by 1535 km from 23 N
    got = spark.range(1).select(x, y).first()
    assert got[0] == pytest.approx(1885.4e3, rel=1e-3) and 1.4e6 < got[1] < 1.6e6


def test_point_in_district(spark):
    p = precincts(spark, box(0, 0, 1, 1), box(1, 0, 2, 1), box(5, 5, 6, 6))
    d = spark.createDataFrame([(0, 7, box(0, 0, 1.6, 2)), (1, 8, box(0, 0, 3, 3))], "district_row int, district int, rings array<array<struct<x:double,y:double>>>")
    assert {r["node_id"]: r["district"] for r in graph.districts_by_centroid(p, d).collect()} == {0: 7, 1: 7, 2: None}


def test_nearest_nodes_equal_brute_force(spark):
    """Islands of several ranks, near and far, of every node and of the smallest only."""
    rng = np.random.default_rng(5)
    groups = [(60, (0.0, 0.0), 1.0), (12, (3.0, 0.5), 0.4), (5, (90.0, -40.0), 0.2), (5, (91.0, -40.0), 0.2), (1, (0.1, 50.0), 0.0)]
    pts, edges, at = [], [], 0
    for n, (x, y), spread in groups:
        pts += [(x + spread * a, y + spread * b) for a, b in rng.uniform(-1, 1, size=(n, 2))]
        edges += [(at + i, at + i + 1, 1.0, False) for i in range(n - 1)]
        at += n
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "node_id long, x double, y double")
    links = spark.createDataFrame(edges, "u long, v long, weight double, synthetic boolean")
    first = np.cumsum([0] + [g[0] for g in groups])
    for per_node in (True, False):
        want = set()
        for r in range(1, len(groups)):
            for i in range(first[r], first[r + 1] if per_node else first[r] + 1):
                d = [np.hypot(pts[i][0] - pts[j][0], pts[i][1] - pts[j][1]) for j in range(first[r])]
                want.add((int(np.argmin(d)), i, round(float(min(d)), 9)))
        got = graph.stitched(nodes, links, per_node).where("synthetic").collect()
        assert {(e["u"], e["v"], round(e["weight"], 9)) for e in got} == want
