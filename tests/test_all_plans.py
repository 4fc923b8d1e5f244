import os

import pytest
from against_sql import DIR

from plansieve import queries
from plansieve.sources.bridge import PLANS, WIDTH, Bridge

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def parts(spark):
    """{(plan, district): components, each a set of nodes}, and neighbours inside the district, by plain search."""
    b = Bridge(spark, DIR)
    n, of = b.n(), {}
    for r in b.assignment().collect():
        of.setdefault(r["plan_id"], {})[r["node_id"]] = r["district"]
    assert len(of) == PLANS
    out, near = {}, {}
    for p, member in of.items():
        for i in member:
            around = [i - WIDTH, i + WIDTH, *([i - 1] if i % WIDTH else []), *([i + 1] if i % WIDTH < WIDTH - 1 else [])]
            near[p, i] = [j for j in around if 0 <= j < n and member[j] == member[i]]
        left = set(member)
        while left:
            found = set(hops(near, p, min(left)))
            out.setdefault((p, member[min(left)]), []).append(found)
            left -= found
    return out, near


def hops(near, p, start):
    seen, todo = {start: 0}, [start]
    for i in todo:
        for j in near[p, i]:
            if j not in seen:
                seen[j] = seen[i] + 1
                todo.append(j)
    return seen


def rows(spark, name):
    return queries.QUERIES[name](spark, DIR).collect()


def test_connected(spark, parts):
    got = {(r["plan_id"], r["district"]): r["connected"] for r in rows(spark, "district_connected")}
    assert got == {k: len(v) == 1 for k, v in parts[0].items()} and not all(got.values())


def test_components(spark, parts):
    got = sorted(tuple(r) for r in rows(spark, "components"))
    assert got == sorted((p, i, min(c)) for (p, _), v in parts[0].items() for c in v for i in c)


def test_diameters(spark, parts):
    want = {}
    for (p, d), v in parts[0].items():
        near = hops(parts[1], p, min(map(min, v)))
        want[p, d] = max(hops(parts[1], p, min(near, key=lambda i: (-near[i], i))).values())
    assert {(r["plan_id"], r["district"]): r["diameter"] for r in rows(spark, "diameter_two_bfs")} == want


@pytest.mark.parametrize("name", ["shared_boundary", "dense_relabel", "plan_validate_anti", "flip_plan", "plan_from_array", "flip_log_totals"])
def test_every_plan_has_rows(spark, name):
    """Values are compared with SQL in test_queries_sql.py."""
    incomplete = {0} if name == "plan_validate_anti" else set()
    assert {r["plan_id"] for r in rows(spark, f"{name}")} == set(range(PLANS)) - incomplete
