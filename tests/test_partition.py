import pytest

from plansieve.operators import partition as pt


def sums(df, column="pop"):
    return {r["district"]: r[column] for r in df.collect()}


def test_totals_and_cut(maps):
    n, e = maps.cycle4()
    p = maps.plan([0, 0, 1, 1])
    assert sums(pt.district_totals(n, p)) == {0: 200.0, 1: 200.0}
    assert pt.boundary_edges(e, p).count() == 2
    assert pt.num_districts(p).first()["n_districts"] == 2
    assert {r["district"]: r["nodes"] for r in pt.districts(p).collect()} == {0: [0, 1], 1: [2, 3]}


def test_flip_is_pure(maps):
    p = maps.plan([0, 0, 1, 1])
    q = pt.flip(p, 0, 1)
    assert [r["district"] for r in q.orderBy("node_id").collect()] == [1, 0, 1, 1]
    assert [r["district"] for r in p.orderBy("node_id").collect()] == [0, 0, 1, 1]
    assert pt.flip(p, 0, 0).exceptAll(p).isEmpty()


def test_missing_node_raises_extra_is_allowed(maps):
    n, _ = maps.cycle4()
    with pytest.raises(ValueError):
        pt.validated(n, maps.plan([0, 0, 1]))
    pt.validated(n, maps.plan([0, 0, 1, 1, 1]))


def test_array_round_trip(maps):
    n, _ = maps.cycle4()
    p = maps.plan([3, 0, 1, 1])
    back = pt.from_array(pt.to_array(p), n)
    assert back.exceptAll(p).isEmpty() and back.count() == 4
    with pytest.raises(Exception, match="differ in length"):
        pt.from_array(pt.to_array(maps.plan([0, 1])), n).collect()


def test_deltas_equal_recomputation(maps):
    from plansieve.operators.graph import graph_summary

    n, e = maps.graph({i: (100, 60, 40) for i in range(6)}, [(0, 1), (1, 2), (3, 4), (4, 5), (0, 3), (1, 4), (2, 5)])
    start = maps.plan([0, 0, 0, 1, 1, 1])
    flips = maps.spark.createDataFrame([(0, 0, 2, 1), (0, 1, 1, 1), (0, 2, 4, 0)], "plan_id long, step long, node_id long, district int")
    run = {(r["step"], r["district"]): r["pop"] for r in pt.pop_deltas(n, start, flips).collect()}
    assert run[2, 0] == run[1, 0] + 100
    last = sums(pt.district_totals(n, pt.replay(start, flips)))
    assert last == {0: run[2, 0], 1: run[2, 1]} and sum(last.values()) == 600
    assert graph_summary(n, e).first()["total_pop"] == 600


def test_mutable_plan_keeps_its_cut(maps):
    from plansieve.plans.chain import MutablePlan
    from plansieve.plans.kernels import Graph

    g = Graph(range(6), [0, 1, 3, 4, 0, 1, 2], [1, 2, 4, 5, 3, 4, 5])
    m = MutablePlan(g, [0, 0, 0, 1, 1, 1], [100] * 6)
    for p, d in ((2, 1), (1, 1), (4, 0)):
        m.flip(p, d)
        assert m.cut == {x for x in g.weight if m.of[x[0]] != m.of[x[1]]}
        assert sum(m.sums.values()) == 600 and sum(map(len, m.members.values())) == 6
    m.flip(0, 0)
    assert m.of == [0, 1, 1, 1, 0, 1]


def test_relabel_and_balance(maps):
    n, _ = maps.cycle4()
    p = pt.dense_relabel(maps.plan([7, 7, 3, 11]))
    assert [r["district"] for r in p.orderBy("node_id").collect()] == [1, 1, 0, 2]
    ok = {r["district"]: r["within"] for r in pt.pop_balance(n, maps.plan([0, 0, 0, 1]), 0.5).collect()}
    assert ok == {0: True, 1: True}
    assert not any(r["within"] for r in pt.pop_balance(n, maps.plan([0, 0, 0, 1]), 0.4).collect())
