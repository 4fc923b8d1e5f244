"""Kernels for what is inherently iterative, run as grouped maps: a group is one district of
one plan, or one chain. None needs more than one district, or one map, in memory."""

from __future__ import annotations

import heapq
import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.operators.partition import edge_districts
from plansieve.storage import by_shuffle, ship


class Graph:
    """Neighbour lists over positions 0..n-1 of sorted node ids."""

    def __init__(self, ids, u, v, w=None):
        self.ids = np.array(sorted(set(int(i) for i in ids)), dtype=np.int64)
        at = {int(i): p for p, i in enumerate(self.ids)}
        self.at = at
        self.near: list[list[int]] = [[] for _ in self.ids]
        self.weight: dict[tuple[int, int], float] = {}
        w = np.ones(len(u)) if w is None else w
        for a, b, x in zip(u, v, w, strict=True):
            if int(a) in at and int(b) in at and a != b:
                p, q = at[int(a)], at[int(b)]
                self.near[p].append(q)
                self.near[q].append(p)
                self.weight[min(p, q), max(p, q)] = 1.0 if x is None or x != x else float(x)
        for n in self.near:
            n.sort()

    def __len__(self) -> int:
        return len(self.ids)

    def hops(self, start: int, inside: set[int] | None = None) -> dict[int, int]:
        """Hop counts of what start reaches, within a set of positions if given."""
        seen, todo = {start: 0}, deque([start])
        while todo:
            p = todo.popleft()
            for q in self.near[p]:
                if q not in seen and (inside is None or q in inside):
                    seen[q] = seen[p] + 1
                    todo.append(q)
        return seen

    def parts(self, inside: set[int]) -> list[list[int]]:
        """Connected components of a set, largest first, equal ones by smallest member."""
        left, out = set(inside), []
        while left:
            found = self.hops(min(left), left)
            out.append(sorted(found))
            left -= found.keys()
        return sorted(out, key=lambda c: (-len(c), c[0]))

    def connected(self, inside: set[int]) -> bool:
        return not inside or len(self.hops(next(iter(inside)), inside)) == len(inside)

    def pieces_without(self) -> list[int]:
        """For each position, how many connected pieces are left when it is taken out: one depth-first search answers for all.

        low: the earliest turn that the edges of a subtree reach; one that does not reach above its parent comes off with the parent.
        """
        turn, low, off = [-1] * len(self), [0] * len(self), [0] * len(self)
        seen = trees = 0
        for root in range(len(self)):
            if turn[root] >= 0:
                continue
            turn[root] = low[root] = seen
            seen, trees = seen + 1, trees + 1
            path = [(root, iter(self.near[root]))]
            while path:
                p, rest = path[-1]
                for q in rest:
                    if turn[q] < 0:
                        turn[q] = low[q] = seen
                        seen += 1
                        path.append((q, iter(self.near[q])))
                        break
                    low[p] = min(low[p], turn[q])
                else:
                    path.pop()
                    if path:
                        up = path[-1][0]
                        low[up] = min(low[up], low[p])
                        off[up] += low[p] >= turn[up]
            off[root] -= 1  # nothing is above it
        return [trees + n for n in off]


def double_sweep(g: Graph) -> int:
    """Hop count from the smallest node's farthest node (smallest of equals) to what is farthest from it."""
    if len(g) < 2:
        return 0

    def far(start: int) -> tuple[int, int]:
        d = g.hops(start)
        most = max(d.values())
        return min(p for p, x in d.items() if x == most), most

    return far(far(0)[0])[1]


def spanning_tree(g: Graph) -> list[tuple[int, int]]:
    """Minimum spanning forest by growing from each component's smallest node; ties by (weight, u, v)."""
    seen: set[int] = set()
    out = []
    for start in range(len(g)):
        if start in seen:
            continue
        seen.add(start)
        heap = [(g.weight[min(start, q), max(start, q)], min(start, q), max(start, q), q) for q in g.near[start]]
        heapq.heapify(heap)
        while heap:
            _, a, b, q = heapq.heappop(heap)
            if q in seen:
                continue
            seen.add(q)
            out.append((a, b))
            for r in g.near[q]:
                if r not in seen:
                    heapq.heappush(heap, (g.weight[min(q, r), max(q, r)], min(q, r), max(q, r), r))
    return out


def tree_diameter(g: Graph) -> int:
    """Exact hop diameter of the spanning forest, the largest over its trees."""
    tree = spanning_tree(g)
    if not tree:
        return 0
    t, seen, most = Graph(range(len(g)), *zip(*tree, strict=True)), set(), 0
    for start in range(len(t)):
        if start not in seen and t.near[start]:
            a = t.hops(start)
            seen.update(a)
            most = max(most, max(t.hops(max(a, key=lambda p: (a[p], -p))).values()))
    return most


def _district_graphs(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows (plan_id, district, a, b, w): each node as (a, null), each inner edge as (a, b)."""
    nodes = assignment.select("plan_id", "district", F.col("node_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"))
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    inner = edge_districts(edges, assignment).where("du = dv").select("plan_id", F.col("du").alias("district"), F.col("u").alias("a"), F.col("v").alias("b"), weight.alias("w"))
    return nodes.unionByName(inner)


def _per_district(edges: DataFrame, assignment: DataFrame, fn, column: str, kind: str) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf["b"].notna()]
        g = Graph(pdf.loc[pdf["b"].isna(), "a"], e["a"].astype("int64"), e["b"].astype("int64"), e["w"])
        return pd.DataFrame({"plan_id": [pdf["plan_id"].iloc[0]], "district": [int(pdf["district"].iloc[0])], column: [fn(g)]})

    ship()
    return _district_graphs(edges, assignment).groupBy("plan_id", "district").applyInPandas(one, f"plan_id long, district int, {column} {kind}")


def diameters(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """plan_id, district, diameter by double sweep."""
    return _per_district(edges, assignment, double_sweep, "diameter", "int")


def tree_diameters(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    return _per_district(edges, assignment, tree_diameter, "diameter", "int")


def connectivity(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """plan_id, district, connected."""
    return _per_district(edges, assignment, lambda g: bool(g.connected(set(range(len(g))))), "connected", "boolean")


def fragment_rows(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """plan_id, district, head, less, root, node_id: members of every connected piece of a district but its largest.

    head: the district's smallest node, root: the piece's, less: minus the piece's size. A group is one district of one plan.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf["b"].notna()]
        g = Graph(pdf.loc[pdf["b"].isna(), "a"], e["a"].astype("int64"), e["b"].astype("int64"))
        pieces = g.parts(set(range(len(g))))[1:]
        plan, district = pdf["plan_id"].iloc[0], int(pdf["district"].iloc[0])
        sizes = [len(p) for p in pieces]
        columns = {"head": [int(g.ids[0])] * len(pieces), "less": [-n for n in sizes], "root": [int(g.ids[p[0]]) for p in pieces]}
        rows = {"plan_id": plan, "district": district, **{k: np.repeat(np.array(v, dtype=np.int64), sizes) for k, v in columns.items()}}
        return pd.DataFrame(rows | {"node_id": g.ids[np.array([q for p in pieces for q in p], dtype=np.int64)]})

    ship()
    return _district_graphs(edges, assignment).groupBy("plan_id", "district").applyInPandas(one, "plan_id long, district int, head long, less long, root long, node_id long")


def flips_keep_connected(edges: DataFrame, assignment: DataFrame, flips: DataFrame) -> DataFrame:
    """flips(plan_id, node_id, district) and connected: whether the district that the node leaves stays in one piece and is not empty.

    A move to the node's own district changes nothing, so it is connected. A group is one district of one plan, searched once for all moves.
    """
    own = assignment.select("plan_id", "node_id", F.col("district").alias("src"))
    asked = flips.select("plan_id", "node_id", F.col("district").alias("to")).join(by_shuffle(own), ["plan_id", "node_id"])

    def one(key, rows: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        e = rows[rows["b"].notna()]
        g = Graph(rows.loc[rows["b"].isna(), "a"], e["a"].astype("int64"), e["b"].astype("int64"), e["w"])
        left = g.pieces_without() if len(moves) else []
        known = {i: left[g.at[i]] == 1 for i in moves["node_id"].unique().tolist()}
        ok = [True if t == key[1] else known[i] for i, t in zip(moves["node_id"].tolist(), moves["to"].tolist(), strict=True)]
        return pd.DataFrame({"plan_id": moves["plan_id"], "node_id": moves["node_id"], "district": moves["to"], "connected": ok})

    ship()
    graphs = _district_graphs(edges, assignment).groupBy("plan_id", "district")
    return graphs.cogroup(asked.groupBy("plan_id", "src")).applyInPandas(one, "plan_id long, node_id long, district int, connected boolean")


def connected_after_flip(g: Graph, member: dict[int, int], node: int, district: int) -> bool:
    """Whether the district that a node leaves stays connected and not empty; True for a move to itself."""
    src = member[node]
    if src == district:
        return True
    rest = {p for p, d in member.items() if d == src and p != node}
    return bool(rest) and g.connected(rest)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counterclockwise, by monotone chains."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)))


def _circle(*pts) -> tuple[float, float, float]:
    """Centre and squared radius through two or three points."""
    if len(pts) == 2:
        (ax, ay), (bx, by) = pts
        return (ax + bx) / 2, (ay + by) / 2, ((ax - bx) ** 2 + (ay - by) ** 2) / 4
    (ax, ay), (bx, by), (cx, cy) = pts
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    d = 2 * (bx * cy - by * cx)
    if d == 0:
        return max((_circle(p, q) for p, q in ((pts[0], pts[1]), (pts[0], pts[2]), (pts[1], pts[2]))), key=lambda c: c[2])
    x = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
    y = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return ax + x, ay + y, x * x + y * y


def enclosing_circle(points: np.ndarray) -> tuple[float, float, float]:
    """x, y, squared radius of the smallest circle around points: incremental construction on the hull in fixed random order."""
    pts = hull(np.asarray(points, dtype=float))
    if len(pts) == 1:
        return float(pts[0][0]), float(pts[0][1]), 0.0
    pts = [tuple(p) for p in pts[np.random.default_rng(0).permutation(len(pts))]]

    def out(c, p) -> bool:
        return (p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2 > c[2] * (1 + 1e-12) + 1e-18

    c = (pts[0][0], pts[0][1], 0.0)
    for i, p in enumerate(pts):
        if out(c, p):
            c = (p[0], p[1], 0.0)
            for j, q in enumerate(pts[:i]):
                if out(c, q):
                    c = _circle(p, q)
                    for r in pts[:j]:
                        if out(c, r):
                            c = _circle(p, q, r)
    return c


def enclosing_areas(points: DataFrame) -> DataFrame:
    """plan_id, district, circle: area of the smallest circle around points(plan_id, district, x, y)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r2 = enclosing_circle(pdf[["x", "y"]].to_numpy())[2]
        return pd.DataFrame({"plan_id": [pdf["plan_id"].iloc[0]], "district": [int(pdf["district"].iloc[0])], "circle": [math.pi * r2]})

    ship()
    return points.groupBy("plan_id", "district").applyInPandas(one, "plan_id long, district int, circle double")
