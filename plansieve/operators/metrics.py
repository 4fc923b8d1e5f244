"""Plan metrics, each for all plans at once: one row (plan_id, metric column).

Signs and ties follow the code that is reproduced, not its prose: the efficiency gap is
(wasted R - wasted D) / votes, a tied district counts as won by R, districts without votes
are left out of vote shares.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.functions.geometry import area, perimeter
from plansieve.operators.graph import shared_boundary
from plansieve.operators.partition import district_totals, edge_districts
from plansieve.plans.kernels import diameters, enclosing_areas, tree_diameters
from plansieve.storage import by_shuffle, cut

MetricFn = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
_registered: dict[str, MetricFn] = {}


def register_metric(name: str, fn: MetricFn) -> None:
    """fn(nodes, edges, assignment) -> DataFrame(plan_id, value), usable by name in `metric`."""
    _registered[name] = fn


def metric(name: str, nodes: DataFrame, edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """plan_id, value of a built-in or registered metric."""
    if name in _registered:
        return _registered[name](nodes, edges, assignment)
    got = {
        "cut_edge_ratio": lambda: cut_edge_ratio(edges, assignment),
        "mst_diameter": lambda: mst_diameter(edges, assignment),
        "modularity": lambda: modularity(edges, assignment),
        "efficiency_gap": lambda: efficiency_gap(district_totals(nodes, assignment)),
        "mean_median": lambda: mean_median(district_totals(nodes, assignment)),
    }[name]()
    return got.select("plan_id", F.col(name).alias("value"))


def _all_plans(assignment: DataFrame, part: DataFrame, name: str) -> DataFrame:
    """Plans without a row in part get 0."""
    return assignment.select("plan_id").distinct().join(part, "plan_id", "left").select("plan_id", F.coalesce(name, F.lit(0.0)).alias(name))


def cut_edge_ratio(edges: DataFrame, assignment: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """ends: edge_districts of both, if it is at hand."""
    ed = edge_districts(edges, assignment) if ends is None else ends
    got = ed.groupBy("plan_id").agg(F.avg((F.col("du") != F.col("dv")).cast("int")).alias("cut_edge_ratio"))
    return _all_plans(assignment, got, "cut_edge_ratio")


def modularity(edges: DataFrame, assignment: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Unweighted; a district without inner edges still pays its degree term. One pass over the edges: each adds both its ends."""
    ed = edge_districts(edges, assignment) if ends is None else ends
    both = F.explode(F.array(F.struct(F.col("du").alias("d"), (F.col("du") == F.col("dv")).cast("int").alias("same")), F.struct(F.col("dv").alias("d"), F.lit(0).alias("same"))))
    at = ed.select("plan_id", both.alias("e")).groupBy("plan_id", F.col("e.d").alias("district")).agg(F.count("*").alias("deg"), F.sum("e.same").alias("inside"))
    # sum over districts of inside / m - (deg / 2m)^2, with 2m the sum of degrees
    m = F.sum("deg") / 2
    q = at.groupBy("plan_id").agg((F.sum("inside") / m - F.sum(F.col("deg").cast("double") * F.col("deg")) / (4 * m * m)).alias("modularity"))
    return _all_plans(assignment, q, "modularity")


def mst_diameter(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Mean over districts of the hop count found by two breadth-first searches.

    The first starts at a district's smallest node, the second at the smallest of the farthest
    nodes; only the start's component counts. No tree is built and weights are ignored.
    """
    d = diameters(edges, assignment).groupBy("plan_id").agg(F.avg(F.col("diameter").cast("double")).alias("mst_diameter"))
    return _all_plans(assignment, d, "mst_diameter")


def mst_tree_diameter(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Mean over districts of the exact hop diameter of a minimum spanning tree (ties by weight, u, v)."""
    d = tree_diameters(edges, assignment).groupBy("plan_id").agg(F.avg(F.col("diameter").cast("double")).alias("mst_tree_diameter"))
    return _all_plans(assignment, d, "mst_tree_diameter")


def d_share(totals: DataFrame) -> DataFrame:
    """plan_id, district, share of the two-party vote; districts without votes are left out."""
    v = F.col("votes_d") + F.col("votes_r")
    return totals.where(v > 0).select("plan_id", "district", (F.col("votes_d") / v).alias("share"))


def efficiency_gap(totals: DataFrame) -> DataFrame:
    d, r = F.col("votes_d"), F.col("votes_r")
    v = d + r
    gap = F.when(d > r, r - (d - v / 2)).otherwise((r - v / 2) - d)
    got = totals.where(v > 0).groupBy("plan_id").agg((F.sum(gap) / F.sum(v)).alias("efficiency_gap"))
    return _all_plans(totals, got, "efficiency_gap")


def mean_median(totals: DataFrame) -> DataFrame:
    got = d_share(totals).groupBy("plan_id").agg((F.avg("share") - F.median("share")).alias("mean_median"))
    return _all_plans(totals, got, "mean_median")


def swing_points(swing_range: float = 0.2, n_points: int = 41) -> list[float]:
    return [float(v) for v in np.linspace(-swing_range, swing_range, n_points)]


def seats_votes_curve(totals: DataFrame, swing_range: float = 0.2, n_points: int = 41) -> DataFrame:
    """plan_id, point_idx, delta, statewide_d_share, expected_d_seats under uniform swing."""
    deltas = F.array(*map(F.lit, swing_points(swing_range, n_points)))
    state = totals.groupBy("plan_id").agg(F.coalesce(F.try_divide(F.sum("votes_d"), F.sum(F.col("votes_d") + F.col("votes_r"))), F.lit(0.5)).alias("state"))
    shares = state.join(d_share(totals).groupBy("plan_id").agg(F.collect_list("share").alias("shares")), "plan_id", "left")
    points = shares.select("plan_id", "state", "shares", F.posexplode(deltas).alias("point_idx", "delta"))
    # each plan has a few districts; their shares travel with the plan's points
    seats = F.size(F.filter(F.coalesce("shares", F.array().cast("array<double>")), lambda s: s + F.col("delta") > 0.5))
    return points.select(
        "plan_id", "point_idx", "delta", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("state") + F.col("delta"))).alias("statewide_d_share"), seats.alias("expected_d_seats")
    )


def symmetric_ideal(curve: DataFrame, n_districts: DataFrame) -> DataFrame:
    """The straight line through half the votes and half the seats, clipped to what can be won."""
    n = F.col("n_districts")
    line = n * (F.col("statewide_d_share") - 0.5) + n / 2
    return curve.join(n_districts, "plan_id").withColumn("ideal_seats", F.greatest(F.lit(0.0), F.least(n.cast("double"), line)))


def polsby_popper(polygons: DataFrame, edges: DataFrame | None, assignment: DataFrame) -> DataFrame:
    """Mean 4 pi A / P^2 of dissolved districts; districts without perimeter are left out.

    Precincts cover the plane without overlaps, so a district's area is the sum of its
    precincts' and its perimeter their sum less twice the boundary shared inside. `edges`
    carries shared lengths (its synthetic ones don't count); None takes them from polygons.
    """
    sizes = polygons.select("node_id", area(F.col("rings")).alias("a"), perimeter(F.col("rings")).alias("p"))
    whole = by_shuffle(assignment).join(sizes, "node_id").groupBy("plan_id", "district").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    shared = shared_boundary(polygons) if edges is None else edges.where("not coalesce(synthetic, false)").select("u", "v", "weight")
    inside = edge_districts(shared, assignment).where("du = dv").groupBy("plan_id", F.col("du").alias("district")).agg(F.sum("weight").alias("w"))
    p = F.col("p") - 2 * F.coalesce("w", F.lit(0.0))
    got = (
        whole.join(inside, ["plan_id", "district"], "left").select("plan_id", "a", p.alias("p")).where("p > 0")
        .groupBy("plan_id").agg(F.avg(4 * F.pi() * F.col("a") / (F.col("p") * F.col("p"))).alias("polsby_popper"))
    )
    return _all_plans(assignment, got, "polsby_popper")


def reock(polygons: DataFrame, assignment: DataFrame) -> DataFrame:
    """Mean share of the smallest enclosing circle that a district fills; exact circles."""
    sizes = polygons.select("node_id", area(F.col("rings")).alias("a"), F.flatten("rings").alias("pts"))
    rows = by_shuffle(assignment).join(sizes, "node_id")
    total = rows.groupBy("plan_id", "district").agg(F.sum("a").alias("a"))
    circles = enclosing_areas(rows.select("plan_id", "district", F.explode("pts").alias("p")).select("plan_id", "district", "p.x", "p.y").distinct())
    got = (
        total.join(circles, ["plan_id", "district"]).where("circle > 0")
        .groupBy("plan_id").agg(F.avg(F.col("a") / F.col("circle")).alias("reock"))
    )
    return _all_plans(assignment, got, "reock")


def all_metrics(nodes: DataFrame, edges: DataFrame, assignment: DataFrame, polygons: DataFrame | None = None, diameter: bool = True) -> DataFrame:
    """One row a plan, a column a metric, in the bundle's order."""
    # each is read by several metrics
    totals, ends = cut(district_totals(nodes, assignment)), cut(edge_districts(edges, assignment).select("plan_id", "du", "dv"))
    parts = [cut_edge_ratio(edges, assignment, ends)]
    if diameter:
        parts.append(mst_diameter(edges, assignment))
    parts += [modularity(edges, assignment, ends), efficiency_gap(totals), mean_median(totals)]
    if polygons is not None:
        parts += [polsby_popper(polygons, None, assignment), reock(polygons, assignment)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "plan_id")
    return out


def long_metrics(wide: DataFrame, key: str = "plan_id") -> DataFrame:
    """(key, metric, value) of a wide metric table."""
    names = [c for c in wide.columns if c != key]
    return wide.unpivot(key, names, "metric", "value")

