"""Adjacency graphs: nodes(node_id, ...), edges(u < v, weight, synthetic)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansieve.functions.geometry import area, centroid, contains, segments
from plansieve.storage import by_shuffle, cut, row_numbers, ship


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: node_id, neighbor, weight."""
    return edges.select(F.col("u").alias("node_id"), F.col("v").alias("neighbor"), "weight").unionByName(
        edges.select(F.col("v").alias("node_id"), F.col("u").alias("neighbor"), "weight")
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = adjacency(edges).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(d, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def shared_boundary(polygons: DataFrame, epsilon: float = 1e-6, cell: float | None = None) -> DataFrame:
    """u, v, weight: length of common boundary of each pair of polygons that have epsilon of it.

    Segments meet by an equi-join on (supporting line, cell along the line): a long line
    spreads over cells, overlaps within cells add up to the whole. `cell` is the cell length,
    by default four times the mean segment's.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.hypot(dx, dy)
    s = segments(polygons)
    if cell is None:
        cell = 4.0 * (s.agg(F.avg(size)).first()[0] or 1.0)
    # a unit direction in the right half plane names the line's slope, its distance from the origin the line
    flip = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1.0).otherwise(1.0)
    s = s.withColumns({"ux": flip * dx / size, "uy": flip * dy / size})
    along = lambda x, y: F.col(x) * F.col("ux") + F.col(y) * F.col("uy")
    digits = 9
    s = s.select(
        "node_id",
        (F.round("ux", digits) + 0.0).alias("lx"),
        (F.round("uy", digits) + 0.0).alias("ly"),
        (F.round(F.col("x1") * F.col("uy") - F.col("y1") * F.col("ux"), 6) + 0.0).alias("off"),
        F.least(along("x1", "y1"), along("x2", "y2")).alias("t1"),
        F.greatest(along("x1", "y1"), along("x2", "y2")).alias("t2"),
    )
    first, last = F.floor(F.col("t1") / cell), F.floor(F.col("t2") / cell)
    s = s.withColumn("cell", F.explode(F.sequence(first, last)))
    s = s.select("node_id", "lx", "ly", "off", "cell", F.greatest("t1", F.col("cell") * cell).alias("t1"), F.least("t2", (F.col("cell") + 1) * cell).alias("t2"))
    a, b = s.alias("a"), s.alias("b")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("lx", "ly", "off", "cell")]
    both = by_shuffle(a).join(b, [*keys, F.col("a.node_id") < F.col("b.node_id")])
    overlap = F.least("a.t2", "b.t2") - F.greatest("a.t1", "b.t1")
    return (
        both.where(overlap > 0)
        .groupBy(F.col("a.node_id").alias("u"), F.col("b.node_id").alias("v"))
        .agg(F.sum(overlap).alias("weight"))
        .where(F.col("weight") >= epsilon)
    )


def build_graph(precincts: DataFrame, pop: str = "pop", votes_d: str = "votes_d", votes_r: str = "votes_r", district: str | None = None, epsilon: float = 1e-6, stitch: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of precincts(node_id, rings, ...); islands are stitched to the rest."""
    c = centroid(F.col("rings"))
    nodes = precincts.select(
        "node_id",
        *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(n) for k, n in ((pop, "pop"), (votes_d, "votes_d"), (votes_r, "votes_r"))],
        *([F.col(district).cast("int").alias("district")] if district else []),
        c["x"].alias("x"),
        c["y"].alias("y"),
    )
    edges = shared_boundary(precincts.select("node_id", "rings"), epsilon).withColumn("synthetic", F.lit(False))
    return nodes, stitched(nodes, cut(edges)) if stitch else edges


#: graphs of at most so many edges (and nodes) are labelled by one task; its Python worker then holds 55 MB of arrays beside the rows (measured). Larger ones take rounds of joins
ONE_TASK_EDGES = 1_000_000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component: the smallest node id that can be reached. Small maps take one task, others rounds of joins."""
    if edges.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES and nodes.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        return _components_at_once(nodes, edges)
    return _components_in_rounds(nodes, edges)


def _components_at_once(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ship()

    def label(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(n["node_id"].to_numpy(dtype=np.int64))
        e = e[e["u"].isin(ids) & e["v"].isin(ids)]
        u, v = np.searchsorted(ids, e["u"].to_numpy(dtype=np.int64)), np.searchsorted(ids, e["v"].to_numpy(dtype=np.int64))
        at = np.arange(len(ids))
        while True:
            low = np.minimum(at[u], at[v])
            new = at.copy()
            # an edge lowers its ends and the labels of its ends
            for ends in (u, v, at[u], at[v]):
                np.minimum.at(new, ends, low)
            while not (new[new] == new).all():
                new = new[new]
            if (new == at).all():
                return pd.DataFrame({"node_id": ids, "component": ids[at]})
            at = new

    one = F.lit(0).alias("one")
    return nodes.select(one, "node_id").groupBy("one").cogroup(edges.select(one, "u", "v").groupBy("one")).applyInPandas(label, "node_id long, component long")


def _components_in_rounds(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label propagation with pointer jumping: labels fall to the neighbourhood's least, then to
    their own label's label, so long paths shrink geometrically. Lineage is cut each round.
    """
    adj = cut(adjacency(edges).select("node_id", "neighbor"))
    labels = cut(nodes.select("node_id", F.col("node_id").alias("component")))
    for _ in range(rounds):
        near = adj.join(labels.withColumnRenamed("node_id", "neighbor"), "neighbor").groupBy("node_id").agg(F.min("component").alias("near"))
        fallen = labels.join(near, "node_id", "left").select("node_id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        # what the neighbourhood offers to a node holds for its label's node as well
        offers = fallen.groupBy("component").agg(F.min("low").alias("offer")).withColumnRenamed("component", "node_id")
        hooked = fallen.join(offers, "node_id", "left").select("node_id", F.col("component").alias("was"), F.least("low", F.coalesce("offer", "low")).alias("low"))
        up = hooked.select(F.col("node_id").alias("low"), F.col("low").alias("up"))
        new = cut(hooked.join(up, "low", "left").select("node_id", "was", F.least("low", F.coalesce("up", "low")).alias("component")))
        labels = new.select("node_id", "component")
        if new.where("was <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def stitched(nodes: DataFrame, edges: DataFrame, per_node: bool = True) -> DataFrame:
    """edges plus synthetic ones that tie every smaller component to larger ones.

    Components go by size, largest first, equal ones by smallest node. per_node: each node of a
    component but the first gets an edge to the nearest node of the components before its own;
    otherwise only the component's smallest node does. Equal distances go to the smaller id.
    Labels, sizes and points stay distributed; the number of components is not looked at.
    """
    label = cut(components(nodes, edges))
    sizes = label.groupBy("component").agg(F.count("*").alias("n"))
    if sizes.limit(2).count() < 2:
        return edges
    ranks = row_numbers(sizes.withColumn("less", -F.col("n")), ["less", "component"], "rank").select("component", "rank")
    points = cut(nodes.select("node_id", "x", "y").join(label, "node_id").join(ranks, "component"))
    asking = points.where("rank > 0")
    if not per_node:
        asking = asking.where("node_id = component")
    near = nearest_before(asking, points)
    return edges.withColumn("synthetic", F.coalesce("synthetic", F.lit(False))).unionByName(
        near.select(F.least("node_id", "near").alias("u"), F.greatest("node_id", "near").alias("v"), F.col("distance").alias("weight"), F.lit(True).alias("synthetic"))
    )


def nearest_before(asking: DataFrame, points: DataFrame) -> DataFrame:
    """node_id, near, distance: for rows of asking the nearest of points with a smaller rank, the smallest id of equals.

    Both have (node_id, x, y, rank). A square grid over the points: a node is compared with those of
    its own and the eight cells around, by an equi-join; what it finds within a cell's width is the
    nearest. Nodes without such a find go on to a grid of twice the width, so dense surroundings are
    settled on small cells and the number of rounds is logarithmic in the map's extent.
    """
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    span = max(box[1] - box[0], box[3] - box[2])
    cell = max(2.0 * ((box[1] - box[0]) * (box[3] - box[2]) / box[4]) ** 0.5, span / max(1, box[4]), 1e-12)
    left, done = cut(asking), None
    while True:
        place = lambda c, w=cell: F.floor(F.col(c) / w)
        base = points.select(place("x").alias("cx"), place("y").alias("cy"), F.col("node_id").alias("m"), F.col("x").alias("mx"), F.col("y").alias("my"), F.col("rank").alias("mr"))
        steps = F.array(*map(F.lit, (-1, 0, 1)))
        around = left.select("node_id", "x", "y", "rank", F.explode(steps).alias("i"), place("y").alias("cy0")).select("*", F.explode(steps).alias("j"))
        around = around.select("node_id", "x", "y", "rank", (place("x") + F.col("i")).alias("cx"), (F.col("cy0") + F.col("j")).alias("cy"))
        d = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))
        found = around.join(base, ["cx", "cy"]).where("mr < rank").groupBy("node_id").agg(F.min(F.struct(d.alias("d"), F.col("m"))).alias("b"))
        found = cut(found.where(F.lit(cell > 2 * span) | (F.col("b.d") <= cell)).select("node_id", F.col("b.m").alias("near"), F.col("b.d").alias("distance")))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found.select("node_id"), "node_id", "left_anti"))
        if cell > 2 * span or left.isEmpty():
            return done
        cell *= 2


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, total_pop, mean_pop, is_connected."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("pop"), F.lit(0)).alias("total_pop"), F.coalesce(F.avg("pop"), F.lit(0.0)).alias("mean_pop"))
    e = edges.agg(F.count("*").alias("n_edges"))
    c = components(nodes, edges).agg((F.countDistinct("component") == 1).alias("is_connected"))
    return n.join(e).join(c).select("n_nodes", "n_edges", "total_pop", "mean_pop", "is_connected")


def districts_by_centroid(precincts: DataFrame, districts: DataFrame, cell: float | None = None) -> DataFrame:
    """node_id, district: first district polygon (by district_row) that holds a precinct's centroid; null if none does.

    districts(district_row, district, rings). Bounding boxes are cut into grid cells, so that the
    join is an equi-join on cells with ray casting behind it.
    """
    xs = lambda f: lambda a: f(F.transform(F.flatten("rings"), lambda p: p[a]))
    box = districts.select("*", xs(F.array_min)("x").alias("x1"), xs(F.array_min)("y").alias("y1"), xs(F.array_max)("x").alias("x2"), xs(F.array_max)("y").alias("y2"))
    if cell is None:
        wide = box.agg(F.avg(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0]
        cell = (wide or 1.0) / 4
    at = lambda v: F.floor(F.col(v) / cell)
    cells = box.withColumn("cx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("cy", F.explode(F.sequence(at("y1"), at("y2"))))
    c = centroid(F.col("rings"))
    points = precincts.select("node_id", c["x"].alias("px"), c["y"].alias("py")).withColumns({"cx": at("px"), "cy": at("py")})
    hit = points.join(cells, ["cx", "cy"]).where(contains(F.col("rings"), F.col("px"), F.col("py")))
    first = hit.groupBy("node_id").agg(F.min(F.struct("district_row", "district")).alias("d"))
    return precincts.select("node_id").join(first, "node_id", "left").select("node_id", F.col("d.district").alias("district"))


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an order column."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def polygon_table(polygons: DataFrame) -> DataFrame:
    """node_id, area, perimeter, cx, cy."""
    from plansieve.functions.geometry import perimeter

    c = centroid(F.col("rings"))
    return polygons.select("node_id", area(F.col("rings")).alias("area"), perimeter(F.col("rings")).alias("perimeter"), c["x"].alias("cx"), c["y"].alias("cy"))
