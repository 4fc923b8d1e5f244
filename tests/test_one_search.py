"""What a district's nodes leave behind is found by one search of the district, not by one a node."""

import numpy as np

from plansieve.plans import kernels as k


class Counted(list):
    """A list that counts how often an entry is read."""

    reads = 0

    def __getitem__(self, i):
        self.reads += 1
        return super().__getitem__(i)


def test_pieces_without_each_node_by_one_search():
    rng = np.random.default_rng(5)
    for n in [*range(6), *rng.integers(6, 25, 150)]:
        m = int(rng.integers(0, 2 * n + 1))
        u, v = rng.integers(0, max(n, 1), m), rng.integers(0, max(n, 1), m)  # parallel edges and loops as well
        g = k.Graph(range(n), u, v)
        wanted = [len(g.parts(set(range(n)) - {p})) for p in range(n)]
        g.near = Counted(g.near)
        assert g.pieces_without() == wanted
        assert g.near.reads == n


def test_a_long_path_is_searched_without_recursion():
    n = 50_000
    assert k.Graph(range(n), range(n - 1), range(1, n)).pieces_without() == [1, *[2] * (n - 2), 1]


def test_flips_of_all_nodes_agree_with_a_search_each(spark, maps):
    rng = np.random.default_rng(8)
    _, e = maps.grid(6)
    e = e.where("u <> 35 and v <> 35")  # a node without edges
    pairs = [tuple(r) for r in e.select("u", "v").collect()]
    g = k.Graph(range(36), [u for u, _ in pairs], [v for _, v in pairs])
    plans = [rng.integers(0, 3, 36), np.arange(36) // 12, np.append(np.zeros(35, dtype=int), 1), np.append(np.ones(34, dtype=int), [0, 0])]
    a = maps.plan([int(d) for d in plans[0]])
    for i, plan in enumerate(plans[1:], 1):
        a = a.unionByName(maps.plan([int(d) for d in plan], i))
    moves = [(i, p, d) for i in range(len(plans)) for p in range(36) for d in range(3)]
    flips = spark.createDataFrame(moves, "plan_id long, node_id long, district int")
    got = {(r["plan_id"], r["node_id"], r["district"]): r["connected"] for r in k.flips_keep_connected(e, a, flips).collect()}
    assert got == {(i, p, d): k.connected_after_flip(g, {q: int(x) for q, x in enumerate(plans[i])}, p, d) for i, p, d in moves}


def test_one_spanning_forest_a_district(monkeypatch):
    rng = np.random.default_rng(9)
    calls, real = [], k.spanning_tree
    monkeypatch.setattr(k, "spanning_tree", lambda g: calls.append(g) or real(g))
    for n in rng.integers(0, 20, 100):
        m = int(rng.integers(0, 2 * n + 1))
        u, v, w = rng.integers(0, max(n, 1), m), rng.integers(0, max(n, 1), m), rng.integers(1, 4, m).astype(float)
        g = k.Graph(range(n), u, v, w)
        root, far = list(range(n)), np.full((n, n), np.inf)
        np.fill_diagonal(far, 0)
        for _, p, q in sorted((x, p, q) for (p, q), x in g.weight.items()):  # Kruskal's way to the same forest
            if root[p] != root[q]:
                root = [root[q] if r == root[p] else r for r in root]
                far[p, q] = far[q, p] = 1
        for i in range(n):
            far = np.minimum(far, far[:, [i]] + far[[i], :])
        calls.clear()
        assert k.tree_diameter(g) == int(max(far[np.isfinite(far)], default=0))
        assert len(calls) == 1


def test_a_forest_of_many_trees():
    n = 30_000
    assert k.tree_diameter(k.Graph(range(3 * n), range(0, 3 * n, 3), range(1, 3 * n, 3))) == 1
