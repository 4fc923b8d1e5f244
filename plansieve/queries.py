"""One query for each operator over the driver's tables, and its SQL. Doubles are rounded to 9 digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansieve.operators import diagnostics, ensemble, graph, metrics, partition
from plansieve.plans import chain, kernels, spectral
from plansieve.sources import loaders, synthetic
from plansieve.sources.bridge import K, PLANS, WIDTH, Bridge

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: the bridge in SQL
_BASE = f"""
WITH RECURSIVE cnt AS (SELECT count(*) AS nn FROM customer),
nodes AS (SELECT c_custkey AS node_id, c_custkey % {WIDTH} AS x, c_custkey // {WIDTH} AS y, count(o_orderkey) AS pop,
  coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN cast(round(o_totalprice * 100) AS BIGINT) END), 0)::BIGINT AS votes_d,
  coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN cast(round(o_totalprice * 100) AS BIGINT) END), 0)::BIGINT AS votes_r
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
edges AS (SELECT c_custkey AS u, c_custkey + 1 AS v FROM customer, cnt WHERE c_custkey % {WIDTH} < {WIDTH - 1} AND c_custkey + 1 < nn
  UNION ALL SELECT c_custkey, c_custkey + {WIDTH} FROM customer, cnt WHERE c_custkey + {WIDTH} < nn),
asg AS (SELECT p.plan_id, c_custkey AS node_id, ((((c_custkey + 37 * p.plan_id) * {K}) // nn) % {K})::INT AS district
  FROM customer, cnt, (SELECT unnest(range({PLANS}))::BIGINT AS plan_id) p),
tot AS (SELECT plan_id, district, count(*) AS n_nodes, sum(pop)::BIGINT AS pop, sum(votes_d)::BIGINT AS votes_d, sum(votes_r)::BIGINT AS votes_r
  FROM asg JOIN nodes USING (node_id) GROUP BY plan_id, district),
ed AS (SELECT a.plan_id, u, v, a.district AS du, b.district AS dv FROM edges JOIN asg a ON a.node_id = u JOIN asg b ON b.node_id = v AND b.plan_id = a.plan_id),
adj AS (SELECT u AS node_id, v AS neighbor FROM edges UNION ALL SELECT v, u FROM edges),
cer AS (SELECT plan_id, avg((du <> dv)::INT) AS cut_edge_ratio FROM ed GROUP BY plan_id),
ends AS (SELECT plan_id, d AS district, count(*) AS deg FROM (SELECT plan_id, du AS d FROM ed UNION ALL SELECT plan_id, dv FROM ed) GROUP BY plan_id, d),
ins AS (SELECT plan_id, du AS district, count(*) AS inside FROM ed WHERE du = dv GROUP BY plan_id, du),
mod_ AS (SELECT plan_id, sum(coalesce(inside, 0) / m - (deg / (2 * m)) ** 2) AS modularity
  FROM ends LEFT JOIN ins USING (plan_id, district) JOIN (SELECT plan_id, sum(deg) / 2.0 AS m FROM ends GROUP BY plan_id) USING (plan_id) GROUP BY plan_id),
eg AS (SELECT plan_id, sum(CASE WHEN votes_d > votes_r THEN votes_r - (votes_d - (votes_d + votes_r) / 2.0) ELSE (votes_r - (votes_d + votes_r) / 2.0) - votes_d END)
  / sum(votes_d + votes_r) AS efficiency_gap FROM tot WHERE votes_d + votes_r > 0 GROUP BY plan_id),
sh AS (SELECT plan_id, district, votes_d / (votes_d + votes_r) AS share FROM tot WHERE votes_d + votes_r > 0),
mm AS (SELECT plan_id, avg(share) - median(share) AS mean_median FROM sh GROUP BY plan_id),
wide AS (SELECT * FROM cer JOIN mod_ USING (plan_id) JOIN eg USING (plan_id) JOIN mm USING (plan_id)),
long_ AS (UNPIVOT wide ON cut_edge_ratio, modularity, efficiency_gap, mean_median INTO NAME metric VALUE value),
ens AS (SELECT metric, plan_id, value FROM long_), ena AS (SELECT metric, value AS v FROM long_ WHERE plan_id = 0),
med AS (SELECT metric, median(value) AS m FROM ens GROUP BY metric),
outl AS (SELECT metric, max(v) AS enacted_value, avg(value) AS ensemble_mean, stddev_pop(value) AS ensemble_std,
  (count(*) FILTER (value < v) + 0.5 * count(*) FILTER (value = v)) / count(*) * 100 AS percentile,
  avg((abs(value - m) >= abs(v - m))::INT) AS p_value_two_sided FROM ens JOIN ena USING (metric) JOIN med USING (metric) GROUP BY metric),
dir AS (SELECT *, CASE WHEN metric IN ('cut_edge_ratio', 'mst_diameter') THEN CASE WHEN percentile > 95 THEN 'less_compact' WHEN percentile < 5 THEN 'more_compact' ELSE 'neutral' END
  WHEN metric IN ('modularity', 'polsby_popper', 'reock') THEN CASE WHEN percentile > 95 THEN 'more_compact' WHEN percentile < 5 THEN 'less_compact' ELSE 'neutral' END
  ELSE CASE WHEN percentile > 95 THEN 'republican_favoring' WHEN percentile < 5 THEN 'democratic_favoring' ELSE 'neutral' END END AS direction FROM outl),
prices AS (SELECT o_orderpriority AS metric, o_orderkey AS plan_id, o_totalprice AS value FROM orders),
pena AS (SELECT metric, value AS v FROM prices WHERE plan_id IN (SELECT min(plan_id) FROM prices GROUP BY metric)),
tra AS (SELECT (user_id % 4)::INT AS chain_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS sample_idx, round(value * 100) AS value FROM events),
len AS (SELECT min(n) AS n FROM (SELECT chain_id, count(*) AS n FROM tra GROUP BY chain_id)),
trj AS (SELECT chain_id, sample_idx, value FROM tra, len WHERE sample_idx < n)
"""


def query(sql: str | None = None, base: bool = True):
    """Registers a function of a Bridge as a query under its name."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Bridge(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = (_BASE if base else "") + sql
        return fn

    return add


def r9(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) + 0.0 for c in columns})


def _long(b: Bridge) -> DataFrame:
    return metrics.long_metrics(metrics.all_metrics(b.nodes(), b.edges(), b.assignment(), diameter=False))


def _split(b: Bridge) -> tuple[DataFrame, DataFrame]:
    from plansieve.storage import cut

    rows = cut(_long(b))
    return rows, rows.where("plan_id = 0").select("metric", "value")


def _prices(b: Bridge) -> tuple[DataFrame, DataFrame]:
    p = b.prices()
    return p, p.groupBy("metric").agg(F.min_by("value", "plan_id").alias("value"))


def _walks(b: Bridge) -> DataFrame:
    return diagnostics.common_length(b.trajectory())


# --- graph ---------------------------------------------------------------------------------


@query(
    """, found AS (SELECT 0::BIGINT AS node_id UNION SELECT neighbor FROM found JOIN adj USING (node_id))
SELECT count(*) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, sum(pop)::BIGINT AS total_pop, round(avg(pop), 9) AS mean_pop, (SELECT count(*) FROM found) = count(*) AS is_connected FROM nodes"""
)
def graph_summary(b):
    return r9(graph.graph_summary(b.nodes(), b.edges()), "mean_pop")


@query("SELECT node_id, (SELECT count(*) FROM adj WHERE adj.node_id = nodes.node_id) AS degree FROM nodes")
def degree(b):
    return graph.degrees(b.nodes(), b.edges())


@query("SELECT u, v, 1.0::DOUBLE AS weight FROM edges")
def adjacency_from_segments(b):
    return r9(graph.shared_boundary(b.polygons()), "weight")


@query("SELECT plan_id, du AS district, dv AS neighbor, count(*)::DOUBLE AS boundary FROM ed WHERE du <> dv GROUP BY plan_id, du, dv")
def shared_boundary(b):
    ed = partition.edge_districts(graph.shared_boundary(b.polygons()), b.assignment()).where("du <> dv")
    return r9(ed.groupBy("plan_id", F.col("du").alias("district"), F.col("dv").alias("neighbor")).agg(F.sum("weight").alias("boundary")), "boundary")


@query("SELECT node_id, 1.0::DOUBLE AS area, 4.0::DOUBLE AS perimeter, x + 0.5 AS cx, y + 0.5 AS cy FROM nodes", base=True)
def polygon_measures(b):
    return r9(graph.polygon_table(b.polygons()), "area", "perimeter", "cx", "cy")


def _boxes(b: Bridge) -> DataFrame:
    """Districts as overlapping bands of rows: first match by row wins."""
    top = b.n() // WIDTH + 1
    rows = []
    for i in range(4):
        lo, hi = float(i * top // 4), float((i + 1) * top // 4 + (1 if i < 2 else 0))
        if hi > lo:
            rows.append((i, i + 10, [[{"x": x, "y": y} for x, y in ((0.0, lo), (25.0, lo), (25.0, hi), (0.0, hi), (0.0, lo))]]))
    return b.spark.createDataFrame(rows, "district_row int, district int, rings array<array<struct<x:double,y:double>>>")


@query(
    """, bands AS (SELECT i, (i * (nn // 25 + 1)) // 4 AS lo, ((i + 1) * (nn // 25 + 1)) // 4 + CASE WHEN i < 2 THEN 1 ELSE 0 END AS hi FROM cnt, (SELECT unnest(range(4)) AS i))
SELECT node_id, (SELECT min(i) + 10 FROM bands WHERE y + 0.5 > lo AND y + 0.5 < hi)::INT AS district FROM nodes"""
)
def point_in_district_join(b):
    return graph.districts_by_centroid(b.polygons(), _boxes(b))


@query("SELECT o_custkey AS node_id, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey", base=False)
def dedupe_keep_first(b):
    o = b.table("orders").select(F.col("o_custkey").alias("node_id"), "o_orderkey")
    return graph.keep_first(o, "node_id", "o_orderkey")


#: edges inside districts, both ways; the smallest node that each node reaches along them
_COMP = """, inner_ AS (SELECT a.plan_id, a.district, a.node_id, neighbor FROM adj JOIN asg a ON a.node_id = adj.node_id JOIN asg c ON c.plan_id = a.plan_id AND c.node_id = neighbor AND c.district = a.district),
comp(plan_id, node_id, root) USING KEY (plan_id, node_id) AS (SELECT plan_id, node_id, node_id FROM asg UNION
  SELECT i.plan_id, neighbor, min(comp.root) FROM comp JOIN inner_ i ON i.plan_id = comp.plan_id AND i.node_id = comp.node_id
  JOIN recurring.comp s ON s.plan_id = i.plan_id AND s.node_id = neighbor WHERE comp.root < s.root GROUP BY i.plan_id, neighbor)
"""


@query(_COMP + "SELECT plan_id, node_id, root AS component FROM comp")
def components(b):
    """plan_id, node_id, component: a node of a plan is one vertex, numbered plan by plan."""
    n, a = b.n(), b.assignment()
    at = F.col("plan_id") * n
    inner = partition.edge_districts(b.edges(), a).where("du = dv").select((at + F.col("u")).alias("u"), (at + F.col("v")).alias("v"), "weight")
    found = graph.components(a.select((at + F.col("node_id")).alias("node_id")), inner)
    return found.select(F.expr(f"node_id div {n}").alias("plan_id"), (F.col("node_id") % n).alias("node_id"), (F.col("component") % n).alias("component"))


@query(
    "SELECT 'island' AS kind, m.node_id AS u, i.id::BIGINT AS v, round(sqrt((m.x - i.x) ** 2 + (m.y - i.y) ** 2), 9) AS weight FROM "
    "(SELECT 1000000 AS id, -2.25 AS x, 1.5 AS y UNION ALL SELECT 1000001, -3.25, 2.5) i, LATERAL "
    "(SELECT node_id, x, y FROM nodes ORDER BY (nodes.x - i.x) ** 2 + (nodes.y - i.y) ** 2, node_id LIMIT 1) m"
)
def nearest_stitch(b):
    """Two nodes off the coast are tied to their nearest nodes."""
    island = b.spark.createDataFrame([(1000000, -2.25, 1.5), (1000001, -3.25, 2.5)], "node_id long, x double, y double")
    nodes = b.nodes().select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).unionByName(island)
    link = b.spark.createDataFrame([(1000000, 1000001, 1.0, False)], "u long, v long, weight double, synthetic boolean")
    out = graph.stitched(nodes, b.edges().unionByName(link)).where("synthetic")
    return r9(out.select(F.lit("island").alias("kind"), "u", "v", "weight"), "weight")


@query(
    """, isl AS (SELECT 1000000 AS id, -2.25 AS x, 1.5 AS y)
SELECT m.node_id AS u, isl.id::BIGINT AS v, round(sqrt((m.x - isl.x) ** 2 + (m.y - isl.y) ** 2), 9) AS weight FROM isl, LATERAL (SELECT node_id, x, y FROM nodes ORDER BY (nodes.x - isl.x) ** 2 + (nodes.y - isl.y) ** 2, node_id LIMIT 1) m"""
)
def stitch_per_component(b):
    """An island of two nodes is tied by its smallest node only."""
    island = b.spark.createDataFrame([(1000000, -2.25, 1.5), (1000001, -3.25, 2.5)], "node_id long, x double, y double")
    nodes = b.nodes().select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).unionByName(island)
    link = b.spark.createDataFrame([(1000000, 1000001, 1.0, False)], "u long, v long, weight double, synthetic boolean")
    return r9(graph.stitched(nodes, b.edges().unionByName(link), per_node=False).where("synthetic").select("u", "v", "weight"), "weight")


@query("SELECT node_id, pop::DOUBLE AS pop, votes_d::DOUBLE AS votes_d, votes_r::DOUBLE AS votes_r, y::INT AS district, x + 0.5 AS x, y + 0.5 AS y, (SELECT count(*) FROM adj WHERE adj.node_id = nodes.node_id) AS degree, (SELECT count(*) FROM adj WHERE adj.node_id = nodes.node_id)::DOUBLE AS border FROM nodes")
def build_graph(b):
    """Nodes of the graph built from polygons, with their edges' number and shared length."""
    raw = b.polygons().join(b.nodes().select("node_id", "pop", "votes_d", "votes_r", F.col("y").alias("band")), "node_id")
    nodes, edges = graph.build_graph(raw, district="band")
    around = graph.adjacency(edges).groupBy("node_id").agg(F.count("*").alias("degree"), F.sum("weight").alias("border"))
    return r9(nodes.join(around, "node_id", "left").fillna(0, ["degree", "border"]), "x", "y", "border")


@query("SELECT node_id, 1.0::DOUBLE AS area, 4.0::DOUBLE AS perimeter, 93 AS n_bytes FROM nodes")
def wkb_round_trip(b):
    """Polygons as a binary column, as geoparquet holds them, read back."""
    from plansieve.functions.geometry import area, perimeter
    from plansieve.sources import geopackage

    binary = b.polygons().select("node_id", geopackage.wkb_of_rings(F.col("rings")).alias("wkb"))
    back = binary.select("node_id", F.octet_length("wkb").alias("n_bytes"), geopackage.rings_of_wkb(F.col("wkb")).alias("rings"))
    return r9(back.select("node_id", area(F.col("rings")).alias("area"), perimeter(F.col("rings")).alias("perimeter"), "n_bytes"), "area", "perimeter")


# --- cleaning ------------------------------------------------------------------------------


@query(
    "SELECT p_partkey AS src_row, coalesce(try_cast(p_size AS DOUBLE), 0.0) AS pop, coalesce(try_cast(p_brand AS DOUBLE), 0.0) AS votes_d, coalesce(try_cast(p_retailprice AS DOUBLE), 0.0) AS votes_r FROM part", base=False
)
def rename_coerce_clean(b):
    raw = b.table("part").select(F.col("p_partkey").alias("src_row"), F.col("p_size").cast("string").alias("TOTPOP"), F.col("p_brand").alias("G20PREDBID"), F.col("p_retailprice").cast("string").alias("G20PRERTRU"))
    return loaders.coerce_numeric(loaders.rename_first_hit(raw, loaders.VEST_PA))


@query("SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_id, pop::DOUBLE AS pop, votes_d::DOUBLE AS votes_d, votes_r::DOUBLE AS votes_r, y::INT AS district FROM nodes WHERE pop > 0")
def pop_filter(b):
    """The generic loader over the bridge's precincts."""
    raw = b.nodes().select(F.col("node_id").alias("src_row"), F.col("pop").alias("TOTPOP"), F.col("votes_d").alias("EL16G_PR_D"), F.col("votes_r").alias("EL16G_PR_R"), F.col("y").alias("CD"))
    return loaders.load_mggg(raw, loaders.MGGG["nc"]).select("node_id", "pop", "votes_d", "votes_r", "district")


@query(
    """, bands AS (SELECT i, (i * (nn // 25 + 1)) // 4 AS lo, ((i + 1) * (nn // 25 + 1)) // 4 + CASE WHEN i < 2 THEN 1 ELSE 0 END AS hi FROM cnt, (SELECT unnest(range(4)) AS i)),
has AS (SELECT *, (SELECT min(i) + 10 FROM bands WHERE y + 0.5 > lo AND y + 0.5 < hi)::INT AS district FROM nodes)
SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_id, pop::DOUBLE AS pop, votes_d::DOUBLE AS votes_d, votes_r::DOUBLE AS votes_r, district FROM has WHERE district IS NOT NULL"""
)
def overlay_loader(b):
    """A source whose districts are all zero takes them from the polygons of an overlay; unpopulated precincts stay."""
    raw = b.polygons().join(b.nodes().select("node_id", F.col("pop").alias("TOTPOP"), F.col("votes_d").alias("G20PREDBID"), F.col("votes_r").alias("G20PRERTRU"), F.lit("0").alias("CD")), "node_id")
    return loaders.load_vest(raw.withColumnRenamed("node_id", "src_row"), overlay=_boxes(b), crs="EPSG:5070").select("node_id", "pop", "votes_d", "votes_r", "district")


def _albers_sql(lon: str, lat: str) -> str:
    from plansieve.functions import geometry as g

    s = f"sin(radians({lat}))"
    q = f"{1 - g._E2!r} * ({s} / (1 - {g._E2!r} * {s} * {s}) - ln((1 - {g._E!r} * {s}) / (1 + {g._E!r} * {s})) / {2 * g._E!r})"
    rho, theta = f"{g._A!r} * sqrt({g._C!r} - {g._N!r} * ({q})) / {g._N!r}", f"{g._N!r} * radians({lon} + 96)"
    return f"round(({rho}) * sin({theta}), 3) AS x, round({g._RHO0!r} - ({rho}) * cos({theta}), 3) AS y"


@query(f"SELECT node_id, {_albers_sql('(-100 + x / 10.0)', '(30 + y / 100.0)')}, round(-100 + x / 10.0, 7) AS lon, round(30 + y / 100.0, 7) AS lat FROM nodes")
def reproject(b):
    """Degrees to the common plane, and back from it."""
    from plansieve.functions import geometry, projections

    at = b.nodes().select("node_id", (F.col("x") / 10.0 - 100).alias("lon"), (F.col("y") / 100.0 + 30).alias("lat"))
    x, y = geometry.albers(F.col("lon"), F.col("lat"))
    plane = at.select("node_id", x.alias("x"), y.alias("y"))
    lon, lat = projections.to_degrees(projections.parse("EPSG:5070"), F.col("x"), F.col("y"))
    return plane.select("node_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("SELECT plan_id, node_id, (dense_rank() OVER (PARTITION BY plan_id ORDER BY d) - 1)::INT AS district FROM (SELECT plan_id, node_id, district * 3 + 5 AS d FROM asg)")
def dense_relabel(b):
    return partition.dense_relabel(b.assignment().withColumn("district", F.col("district") * 3 + 5))


@query("SELECT plan_id, count(*) AS n_missing FROM asg WHERE node_id % (plan_id + 5) = 0 AND plan_id > 0 GROUP BY plan_id")
def plan_validate_anti(b):
    holes = b.assignment().where("not (plan_id > 0 and node_id % (plan_id + 5) = 0)")
    return partition.incomplete_plans(b.nodes(), holes)


# --- plans ---------------------------------------------------------------------------------


@query("SELECT plan_id, district, n_nodes, pop, votes_d, votes_r FROM tot")
def district_totals(b):
    return partition.district_totals(b.nodes(), b.assignment())


@query("SELECT plan_id, count(DISTINCT district) AS n_districts FROM asg GROUP BY plan_id")
def num_districts(b):
    return partition.num_districts(b.assignment())


@query("SELECT plan_id, district, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS nodes FROM asg GROUP BY plan_id, district")
def districts(b):
    return partition.districts(b.assignment()).select("plan_id", "district", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


@query("SELECT plan_id, district, pop, round(ideal, 9) AS ideal, pop BETWEEN ideal * 0.95 AND ideal * 1.05 AS within FROM tot JOIN (SELECT plan_id, sum(pop) / count(*) AS ideal FROM tot GROUP BY plan_id) USING (plan_id)")
def pop_balance_tol(b):
    return r9(partition.pop_balance(b.nodes(), b.assignment(), 0.05), "ideal")


@query("SELECT plan_id, u, v, du, dv FROM ed WHERE du <> dv")
def boundary_edges(b):
    return partition.boundary_edges(b.edges(), b.assignment())


@query("SELECT plan_id, node_id, CASE WHEN plan_id = 1 AND node_id = 7 THEN 5 ELSE district END AS district FROM asg")
def flip_plan(b):
    return partition.flip(b.assignment(), 7, 5, 1)


@query("SELECT plan_id, string_agg(district::VARCHAR, ',' ORDER BY node_id) AS plan FROM asg GROUP BY plan_id")
def plan_to_array(b):
    return partition.to_array(b.assignment()).select("plan_id", F.array_join(F.transform("plan", lambda d: d.cast("string")), ",").alias("plan"))


@query("SELECT plan_id, node_id, district FROM asg")
def plan_from_array(b):
    return partition.from_array(partition.to_array(b.assignment()), b.nodes()).select("plan_id", "node_id", "district")


@query(
    """, last_ AS (SELECT o_custkey AS node_id, (max(o_orderkey) % 8)::INT AS district FROM orders GROUP BY o_custkey)
SELECT plan_id, coalesce(last_.district, asg.district) AS district, sum(pop)::BIGINT AS pop FROM asg JOIN nodes USING (node_id) LEFT JOIN last_ USING (node_id) GROUP BY ALL"""
)
def flip_log_totals(b):
    """Populations after a log of flips replayed on every plan, from the signed deltas' running sums."""
    plan = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PLANS - 1).cast("long")))
    flips = b.table("orders").select(plan.alias("plan_id"), F.col("o_orderkey").alias("step"), F.col("o_custkey").alias("node_id"), (F.col("o_orderkey") % 8).cast("int").alias("district"))
    run = partition.pop_deltas(b.nodes(), b.assignment(), flips)
    return run.groupBy("plan_id", "district").agg(F.max_by("pop", "step").alias("pop"))


@query(
    """, pos AS (SELECT node_id, ((node_id * 7919) % nn)::DOUBLE AS fiedler, pop FROM nodes, cnt),
cum AS (SELECT *, sum(pop) OVER (ORDER BY fiedler, node_id ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (ORDER BY fiedler, node_id) - 1 AS rk FROM pos),
at_ AS (SELECT least(greatest((SELECT rk FROM cum ORDER BY abs(c - (SELECT sum(pop) FROM pos) * 0.375), rk LIMIT 1), 1), nn - 2) AS k FROM cnt)
SELECT node_id, rk <= k AS "left" FROM cum, at_"""
)
def balanced_split(b):
    n = b.n()
    rows = b.nodes().select(F.lit(0).alias("piece"), "node_id", ((F.col("node_id") * 7919) % n).cast("double").alias("fiedler"), "pop")
    return spectral.balanced_split(rows, 0.375).select("node_id", "left")


# --- metrics -------------------------------------------------------------------------------


@query("SELECT plan_id, round(cut_edge_ratio, 9) AS cut_edge_ratio FROM cer")
def cut_edge_ratio(b):
    return r9(metrics.cut_edge_ratio(b.edges(), b.assignment()), "cut_edge_ratio")


@query("SELECT plan_id, round(modularity, 9) AS modularity FROM mod_")
def modularity(b):
    return r9(metrics.modularity(b.edges(), b.assignment()), "modularity")


@query("SELECT plan_id, district, round(share, 9) AS share FROM sh")
def d_share(b):
    return r9(metrics.d_share(partition.district_totals(b.nodes(), b.assignment())), "share")


@query("SELECT plan_id, round(efficiency_gap, 9) AS efficiency_gap FROM eg")
def efficiency_gap(b):
    return r9(metrics.efficiency_gap(partition.district_totals(b.nodes(), b.assignment())), "efficiency_gap")


@query("SELECT plan_id, round(mean_median, 9) AS mean_median FROM mm")
def mean_median(b):
    return r9(metrics.mean_median(partition.district_totals(b.nodes(), b.assignment())), "mean_median")


_POINTS = ", ".join(f"({i}, {d!r}::DOUBLE)" for i, d in enumerate(metrics.swing_points()))
_CURVE = f""", pts AS (SELECT * FROM (VALUES {_POINTS}) t(point_idx, delta)),
st AS (SELECT plan_id, coalesce(sum(votes_d) / nullif(sum(votes_d + votes_r), 0), 0.5) AS state FROM tot GROUP BY plan_id),
curve AS (SELECT plan_id, point_idx, greatest(0.0, least(1.0, state + delta)) AS statewide_d_share,
  (SELECT count(*) FROM sh WHERE sh.plan_id = st.plan_id AND share + delta > 0.5)::INT AS expected_d_seats FROM st, pts)
"""


@query(_CURVE + "SELECT plan_id, point_idx, round(statewide_d_share, 9) AS statewide_d_share, expected_d_seats FROM curve")
def seats_votes(b):
    return r9(metrics.seats_votes_curve(partition.district_totals(b.nodes(), b.assignment())), "statewide_d_share").drop("delta")


@query(_CURVE + "SELECT plan_id, point_idx, round(greatest(0.0, least(8.0, 8 * (statewide_d_share - 0.5) + 4)), 9) AS ideal_seats FROM curve")
def symmetric_ideal(b):
    curve = metrics.seats_votes_curve(partition.district_totals(b.nodes(), b.assignment()))
    return r9(metrics.symmetric_ideal(curve, partition.num_districts(b.assignment())), "ideal_seats").select("plan_id", "point_idx", "ideal_seats")


@query(
    """SELECT plan_id, round(avg(4 * pi() * n_nodes / (4.0 * n_nodes - 2 * coalesce(inside, 0)) ** 2), 9) AS polsby_popper
FROM tot LEFT JOIN ins USING (plan_id, district) GROUP BY plan_id"""
)
def polsby_popper(b):
    return r9(metrics.polsby_popper(b.polygons(), None, b.assignment()), "polsby_popper")


#: a smallest enclosing circle goes through two or three of the outermost corners: the least of all such circles that hold every corner
_REOCK = """, cor AS (SELECT DISTINCT plan_id, district, cx, cy FROM (SELECT plan_id, district, x + dx AS cx, y + dy AS cy FROM asg JOIN nodes USING (node_id), (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) c(dx, dy))),
ext AS (SELECT DISTINCT plan_id, district, cx::DOUBLE AS x, cy::DOUBLE AS y FROM (SELECT plan_id, district, cy, unnest([min(cx), max(cx)]) AS cx FROM cor GROUP BY plan_id, district, cy)),
num AS (SELECT *, row_number() OVER (PARTITION BY plan_id, district ORDER BY x, y) AS i FROM ext),
two AS (SELECT plan_id, district, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4 AS r2 FROM num a JOIN num b USING (plan_id, district) WHERE a.i < b.i),
tri AS (SELECT plan_id, district, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS by_, c.x - a.x AS cx, c.y - a.y AS cy FROM num a JOIN num b USING (plan_id, district) JOIN num c USING (plan_id, district) WHERE a.i < b.i AND b.i < c.i),
cen AS (SELECT plan_id, district, ax, ay, (cy * (bx * bx + by_ * by_) - by_ * (cx * cx + cy * cy)) / (2 * (bx * cy - by_ * cx)) AS ux, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by_ * by_)) / (2 * (bx * cy - by_ * cx)) AS uy
  FROM tri WHERE bx * cy <> by_ * cx),
cir AS (SELECT plan_id, district, x, y, r2 FROM two UNION SELECT plan_id, district, ax + ux, ay + uy, ux * ux + uy * uy FROM cen),
mec AS (SELECT c.plan_id, c.district, min(r2) AS r2 FROM cir c WHERE NOT EXISTS (FROM ext e WHERE e.plan_id = c.plan_id AND e.district = c.district AND (e.x - c.x) ** 2 + (e.y - c.y) ** 2 > c.r2 * (1 + 1e-9)) GROUP BY c.plan_id, c.district),
reo AS (SELECT plan_id, avg(n_nodes / (pi() * r2)) AS reock FROM mec JOIN tot USING (plan_id, district) GROUP BY plan_id)
"""


@query(_REOCK + "SELECT plan_id, round(reock, 9) AS reock FROM reo")
def reock(b):
    return r9(metrics.reock(b.polygons(), b.assignment()), "reock")


def _sweeps(start: str, along: str, name: str) -> str:
    """Hops from (plan_id, node) rows of `start` along (plan_id, node_id, neighbor) rows of `along`, as {name}(plan_id, node, d)."""
    return f"""{name}(plan_id, node, d) USING KEY (plan_id, node) AS (SELECT plan_id, node, 0 FROM {start} UNION
  SELECT i.plan_id, neighbor, min({name}.d) + 1 FROM {name} JOIN {along} i ON i.plan_id = {name}.plan_id AND i.node_id = {name}.node
  LEFT JOIN recurring.{name} s ON s.plan_id = i.plan_id AND s.node = neighbor WHERE s.node IS NULL GROUP BY i.plan_id, neighbor)"""


_FAR = f""", inner_ AS (SELECT a.plan_id, a.district, a.node_id, neighbor FROM adj JOIN asg a ON a.node_id = adj.node_id JOIN asg c ON c.plan_id = a.plan_id AND c.node_id = neighbor AND c.district = a.district),
d0 AS (SELECT plan_id, min(node_id) AS node FROM asg GROUP BY plan_id, district),
{_sweeps("d0", "inner_", "b1")},
far AS (SELECT plan_id, arg_min(b1.node, (-b1.d, b1.node)) AS node FROM b1 JOIN asg a USING (plan_id) WHERE a.node_id = b1.node GROUP BY plan_id, a.district),
{_sweeps("far", "inner_", "b2")},
dia AS (SELECT plan_id, a.district, max(b2.d)::INT AS diameter FROM b2 JOIN asg a USING (plan_id) WHERE a.node_id = b2.node GROUP BY plan_id, a.district)
"""


@query(_FAR + "SELECT plan_id, district, diameter FROM dia")
def diameter_two_bfs(b):
    return kernels.diameters(b.edges(), b.assignment())


@query(_FAR + "SELECT plan_id, round(avg(diameter), 9) AS mst_diameter FROM dia GROUP BY plan_id")
def mst_diameter(b):
    return r9(metrics.mst_diameter(b.edges(), b.assignment()), "mst_diameter")


#: on a lattice whose districts are intervals of ids, every cycle bounds unit squares, and a square's greatest edge is its upper one:
#: the spanning tree is what is left without the upper edges of whole squares
_TREE = f"""{_COMP}, tre AS (SELECT i.* FROM inner_ i WHERE abs(i.node_id - neighbor) <> 1 OR NOT EXISTS (FROM asg p JOIN asg q ON q.plan_id = p.plan_id AND q.district = p.district AND q.node_id = p.node_id + 1
    WHERE p.plan_id = i.plan_id AND p.district = i.district AND p.node_id = least(i.node_id, neighbor) - {WIDTH})),
d0 AS (SELECT DISTINCT plan_id, root AS node FROM comp),
{_sweeps("d0", "tre", "b1")},
far AS (SELECT c.plan_id, arg_max(b1.node, b1.d) AS node FROM b1 JOIN comp c ON c.plan_id = b1.plan_id AND c.node_id = b1.node GROUP BY c.plan_id, c.root),
{_sweeps("far", "tre", "b2")},
dia AS (SELECT b2.plan_id, a.district, max(b2.d) AS diameter FROM b2 JOIN asg a ON a.plan_id = b2.plan_id AND a.node_id = b2.node GROUP BY b2.plan_id, a.district)
"""


@query(_TREE + "SELECT plan_id, round(avg(diameter), 9) AS mst_tree_diameter FROM dia GROUP BY plan_id")
def mst_tree_diameter(b):
    return r9(metrics.mst_tree_diameter(b.edges(), b.assignment()), "mst_tree_diameter")


@query(
    """, reach AS (SELECT plan_id, district, min(node_id) AS node_id FROM asg GROUP BY plan_id, district UNION
  SELECT r.plan_id, r.district, neighbor FROM reach r JOIN adj USING (node_id) JOIN asg c ON c.plan_id = r.plan_id AND c.node_id = neighbor AND c.district = r.district)
SELECT plan_id, district, (SELECT count(*) FROM reach r WHERE r.plan_id = tot.plan_id AND r.district = tot.district) = n_nodes AS connected FROM tot"""
)
def district_connected(b):
    return kernels.connectivity(b.edges(), b.assignment())


_WIDE = _FAR + _REOCK + """, pol AS (SELECT plan_id, avg(4 * pi() * n_nodes / (4.0 * n_nodes - 2 * coalesce(inside, 0)) ** 2) AS polsby_popper FROM tot LEFT JOIN ins USING (plan_id, district) GROUP BY plan_id),
mst AS (SELECT plan_id, avg(diameter) AS mst_diameter FROM dia GROUP BY plan_id),
wide7 AS (SELECT * FROM wide JOIN mst USING (plan_id) JOIN pol USING (plan_id) JOIN reo USING (plan_id)),
long7 AS (UNPIVOT wide7 ON cut_edge_ratio, mst_diameter, modularity, efficiency_gap, mean_median, polsby_popper, reock INTO NAME metric VALUE value),
ens7 AS (SELECT l.metric, round(l.value, 9) AS value, round(e.value, 9) AS v, median(round(l.value, 9)) OVER (PARTITION BY l.metric) AS m FROM long7 l JOIN long7 e ON e.metric = l.metric AND e.plan_id = 0),
out7 AS (SELECT metric, max(v) AS enacted_value, avg(value) AS ensemble_mean, stddev_pop(value) AS ensemble_std, (count(*) FILTER (value < v) + 0.5 * count(*) FILTER (value = v)) / count(*) * 100 AS percentile,
  avg((abs(value - m) >= abs(v - m))::INT) AS p_value_two_sided FROM ens7 GROUP BY metric)
"""


@query(
    _COMP + """, cand AS (SELECT plan_id, u AS node_id, dv AS district FROM ed WHERE du <> dv UNION SELECT plan_id, v, du FROM ed WHERE du <> dv),
gone AS (SELECT DISTINCT plan_id, node_id AS out, asg.district AS src FROM cand JOIN asg USING (plan_id, node_id)),
left_ AS (SELECT gone.plan_id, out, min(node_id) AS node_id FROM gone JOIN asg ON asg.plan_id = gone.plan_id AND asg.district = src AND node_id <> out GROUP BY gone.plan_id, out UNION
  SELECT l.plan_id, l.out, neighbor FROM left_ l JOIN inner_ i ON i.plan_id = l.plan_id AND i.node_id = l.node_id WHERE neighbor <> l.out),
ok AS (SELECT plan_id, out AS node_id, count(left_.node_id) AS n FROM left_ GROUP BY plan_id, out)
SELECT cand.plan_id, cand.node_id, cand.district, coalesce(ok.n = tot.n_nodes - 1, false) AND n_nodes > 1 AS connected FROM cand LEFT JOIN ok USING (plan_id, node_id) JOIN asg a ON a.plan_id = cand.plan_id AND a.node_id = cand.node_id
JOIN tot ON tot.plan_id = a.plan_id AND tot.district = a.district"""
)
def connected_after_flip(b):
    """Of every move of a node to a neighbour's district, whether what it leaves stays connected."""
    ed = partition.boundary_edges(b.edges(), b.assignment())
    moves = ed.select("plan_id", F.col("u").alias("node_id"), F.col("dv").alias("district")).union(ed.select("plan_id", "v", "du")).distinct()
    return kernels.flips_keep_connected(b.edges(), b.assignment(), moves)


@query(
    # fragments take their turns one by one; a plan is a list of districts by node
    _COMP + """, siz AS (SELECT plan_id, district, root, count(*) AS n, min(min(node_id)) OVER (PARTITION BY plan_id, district) AS head FROM comp JOIN asg USING (plan_id, node_id) GROUP BY plan_id, district, root),
frag AS (SELECT plan_id, district, root, row_number() OVER (PARTITION BY plan_id ORDER BY head, n DESC, root) AS turn FROM (SELECT * FROM siz QUALIFY row_number() OVER (PARTITION BY plan_id, district ORDER BY n DESC, root) > 1)),
mem AS (SELECT f.plan_id, turn, any_value(f.district) AS d, list(comp.node_id ORDER BY comp.node_id) AS own, flatten(list((SELECT list(neighbor ORDER BY neighbor) FROM adj WHERE adj.node_id = comp.node_id) ORDER BY comp.node_id)) AS near
  FROM frag f JOIN comp ON comp.plan_id = f.plan_id AND comp.root = f.root GROUP BY f.plan_id, turn),
rep AS (SELECT plan_id, 0::BIGINT AS turn, list(district ORDER BY node_id) AS a, max(district) AS top FROM asg GROUP BY plan_id UNION ALL
  SELECT plan_id, turn, [CASE WHEN list_contains(own, i - 1) THEN coalesce(to_, (d + 1) % top) ELSE a[i] END FOR i IN range(1, len(a) + 1)], top FROM (
    SELECT *, list_sort([{'n': -len(list_filter(acr, lambda y: y = x)), 'p': list_position(acr, x), 'x': x} FOR x IN list_distinct(acr)])[1].x AS to_ FROM (
      SELECT rep.plan_id, mem.turn, rep.a, rep.top, mem.d, mem.own, list_filter([rep.a[q + 1] FOR q IN near], lambda y: y <> d) AS acr FROM rep JOIN mem ON mem.plan_id = rep.plan_id AND mem.turn = rep.turn + 1))),
fin AS (SELECT plan_id, arg_max(a, turn) AS a FROM rep GROUP BY plan_id)
SELECT plan_id, i - 1 AS node_id, a[i] AS district FROM fin, unnest(range(1, len(a) + 1)) AS u(i)"""
)
def repair_contiguity(b):
    """Districts of the shifted plans that are in pieces give the smaller ones to the neighbours they border most."""
    return spectral.repair_plans(b.edges(), b.assignment())


@query(
    _WIDE + """SELECT plan_id, round(cut_edge_ratio, 9) AS cut_edge_ratio, round(mst_diameter, 9) AS mst_diameter, round(modularity, 9) AS modularity, round(efficiency_gap, 9) AS efficiency_gap, round(mean_median, 9) AS mean_median,
  round(polsby_popper, 9) AS polsby_popper, round(reock, 9) AS reock FROM wide7"""
)
def all_metrics(b):
    """The whole bundle."""
    m = metrics.all_metrics(b.nodes(), b.edges(), b.assignment(), b.polygons())
    return r9(m, *[c for c in m.columns if c != "plan_id"])


@query("SELECT plan_id, round(cut_edge_ratio, 9) AS cut_edge_ratio, round(modularity, 9) AS modularity, round(efficiency_gap, 9) AS efficiency_gap, round(mean_median, 9) AS mean_median FROM wide")
def all_metrics_relational(b):
    m = metrics.all_metrics(b.nodes(), b.edges(), b.assignment(), diameter=False)
    return r9(m, *[c for c in m.columns if c != "plan_id"])


@query("SELECT plan_id, metric, round(value, 9) AS value FROM long_")
def unpivot_metrics(b):
    return r9(_long(b), "value")


# --- ensemble statistics -------------------------------------------------------------------


@query("SELECT metric, round((count(*) FILTER (value < v) + 0.5 * count(*) FILTER (value = v)) / count(*) * 100, 9) AS percentile FROM prices JOIN pena USING (metric) GROUP BY metric")
def percentile_midrank(b):
    return r9(ensemble.percentile_midrank(*_prices(b)), "percentile")


@query("SELECT metric, round(avg((value <= v)::INT) * 100, 9) AS percentile FROM prices JOIN pena USING (metric) GROUP BY metric")
def percentile_weak(b):
    return r9(ensemble.percentile_weak(*_prices(b)), "percentile")


@query("SELECT metric, round(avg((abs(value - m) >= abs(v - m))::INT), 9) AS p_value_two_sided FROM prices JOIN pena USING (metric) JOIN (SELECT metric, median(value) AS m FROM prices GROUP BY metric) USING (metric) GROUP BY metric")
def p_two_sided(b):
    return r9(ensemble.two_sided_p_value(*_prices(b)), "p_value_two_sided")


_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in ("enacted_value", "ensemble_mean", "ensemble_std", "percentile", "p_value_two_sided"))


@query(f"SELECT metric, {_ROUNDED}, direction FROM dir")
def outlier_table(b):
    return r9(ensemble.outlier_analysis(*_split(b)), "enacted_value", "ensemble_mean", "ensemble_std", "percentile", "p_value_two_sided")


@query("SELECT metric, direction FROM dir")
def direction(b):
    return ensemble.outlier_analysis(*_split(b)).select("metric", "direction")


@query("SELECT round(avg(-log10(greatest(p_value_two_sided, 1e-4))), 9) AS severity FROM outl")
def severity(b):
    return r9(ensemble.severity(ensemble.outlier_analysis(*_split(b))), "severity")


@query(
    """SELECT 'XX' AS state, metric, round(enacted_value, 9) AS enacted, round(percentile, 9) AS percentile, direction FROM dir
UNION ALL SELECT 'XX', '_composite_severity', round(avg(-log10(greatest(p_value_two_sided, 1e-4))), 9), NULL, '' FROM outl"""
)
def summary_union_row(b):
    o = ensemble.outlier_analysis(*_split(b))
    s = ensemble.with_severity_row(ensemble.summary_table(o, "XX"), o, "XX").select("state", "metric", "enacted", F.nanvl("percentile", F.lit(None)).alias("percentile"), "direction")
    return r9(s, "enacted", "percentile")


@query(
    """, ends_ AS (SELECT metric, min(value) AS a, max(value) AS b FROM prices GROUP BY metric)
SELECT metric, bin, count(*) AS n FROM (SELECT metric, (CASE WHEN a = b THEN 0 ELSE least(floor((value - a) / ((b - a) / 30)), 29) END)::INT AS bin FROM prices JOIN ends_ USING (metric)) GROUP BY metric, bin"""
)
def histogram_bins(b):
    return ensemble.histogram(b.prices(), 30).select("metric", "bin", "n")


@query("SELECT metric, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std FROM ens GROUP BY metric")
def mean_and_std(b):
    return r9(ensemble.spread(_long(b)), "mean", "std")


@query(
    """, vals AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY plan_id) - 1 AS i FROM ens),
size_ AS (SELECT metric, count(*) AS n, max(v) AS v FROM ens JOIN ena USING (metric) GROUP BY metric),
drawn AS (SELECT metric, r, v, ('0x' || md5('42:' || r || ':' || j)[1:8])::BIGINT % n AS i FROM size_, unnest(range(500)) AS a(r), unnest(range(n)) AS b(j)),
got AS (SELECT metric, r, v, value FROM drawn JOIN vals USING (metric, i)),
each_ AS (SELECT metric, r, avg((abs(value - m) >= abs(v - m))::INT) AS p FROM got JOIN (SELECT metric, r, median(value) AS m FROM got GROUP BY metric, r) USING (metric, r) GROUP BY metric, r)
SELECT metric, round(any_value(p_value_two_sided), 9) AS p, round(quantile_cont(p, (1 - 0.95) / 2), 9) AS lo, round(quantile_cont(p, 1 - (1 - 0.95) / 2), 9) AS hi FROM each_ JOIN outl USING (metric) GROUP BY metric"""
)
def bootstrap_ci(b):
    return r9(ensemble.bootstrap_p_value(*_split(b), n_boot=500, seed=42), "p", "lo", "hi")


@query(
    """SELECT state, round(avg(-log10(greatest(p, 1e-4))), 9) AS severity, round(max(rhat), 9) AS max_rhat, min(ess)::DOUBLE AS min_ess, count(*) AS n_metrics FROM
(SELECT n_name AS state, c_mktsegment, count(*) FILTER (c_acctbal > 5000) / count(*) AS p, CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 + stddev_pop(c_acctbal) / 1e5 END AS rhat, CASE WHEN c_mktsegment <> 'BUILDING' THEN count(*) END AS ess
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, c_mktsegment) GROUP BY state""", base=False
)
def cross_state(b):
    """The cross-state table of tables per region: a nation is a state, a market segment a metric, one of them without convergence figures."""
    from plansieve import pipeline

    c = b.table("customer").join(b.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    judged = lambda v: F.when(F.col("c_mktsegment") != "BUILDING", v).otherwise(float("nan"))
    p = c.groupBy("n_regionkey", F.col("n_name").alias("state"), "c_mktsegment").agg(
        (F.count_if(F.col("c_acctbal") > 5000) / F.count("*")).alias("p_value"), F.stddev_pop("c_acctbal").alias("sd"), F.count("*").cast("double").alias("n")
    )
    p = p.select("n_regionkey", "state", F.col("c_mktsegment").alias("metric"), "p_value", judged(1 + F.col("sd") / 1e5).alias("rhat"), judged(F.col("n")).alias("ess"))
    tables = {str(r): p.where(F.col("n_regionkey") == r).drop("n_regionkey") for r in range(5)}
    return r9(pipeline.cross_state(tables)[1], "severity", "max_rhat").select("state", "severity", "max_rhat", "min_ess", "n_metrics")


# --- diagnostics ---------------------------------------------------------------------------


@query("SELECT 'value' AS metric, round(sqrt((avg(v) + var_samp(m)) / avg(v)), 9) AS rhat FROM (SELECT chain_id, avg(value) AS m, var_samp(value) AS v FROM trj GROUP BY chain_id)")
def rhat(b):
    return r9(diagnostics.gelman_rubin(_walks(b)), "rhat")


_ACF = """, c AS (SELECT chain_id, sample_idx, value - avg(value) OVER (PARTITION BY chain_id) AS x FROM trj),
lag_ AS (SELECT unnest(range({0} + 1)) AS lag),
s AS (SELECT a.chain_id, lag, sum(a.x * b.x) AS s FROM c a, lag_ JOIN c b ON b.chain_id = a.chain_id AND b.sample_idx = a.sample_idx + lag GROUP BY a.chain_id, lag),
rho AS (SELECT chain_id, lag, s / (SELECT s FROM s z WHERE z.chain_id = s.chain_id AND z.lag = 0) AS rho FROM s)
"""


@query(_ACF.format(10) + "SELECT 'value' AS metric, chain_id, lag::INT AS lag, round(rho, 9) AS rho FROM rho")
def autocorrelation(b):
    return r9(diagnostics.autocorrelation(_walks(b), 10), "rho")


@query(
    _ACF.format(60)
    + """, pairs AS (SELECT a.chain_id, a.lag AS k, a.rho + b.rho AS v FROM rho a JOIN rho b ON b.chain_id = a.chain_id AND b.lag = a.lag + 1 WHERE a.lag % 2 = 1)
SELECT 'value' AS metric, chain_id, round((SELECT n FROM len) / (1 + 2 * coalesce((SELECT sum(v) FROM pairs q WHERE q.chain_id = p.chain_id AND q.k < (SELECT min(k) FROM pairs z WHERE z.chain_id = p.chain_id AND z.v <= 0)), 0)), 6) AS ess
FROM (SELECT DISTINCT chain_id FROM trj) p"""
)
def ess(b):
    return diagnostics.effective_sample_size(_walks(b)).withColumn("ess", F.round("ess", 6) + 0.0)


@query(
    _ACF.format(60)
    + """, pairs AS (SELECT a.chain_id, a.lag AS k, a.rho + b.rho AS v FROM rho a JOIN rho b ON b.chain_id = a.chain_id AND b.lag = a.lag + 1 WHERE a.lag % 2 = 1),
ess_ AS (SELECT chain_id, (SELECT n FROM len) / (1 + 2 * coalesce((SELECT sum(v) FROM pairs q WHERE q.chain_id = p.chain_id AND q.k < (SELECT min(k) FROM pairs z WHERE z.chain_id = p.chain_id AND z.v <= 0)), 0)) AS ess FROM (SELECT DISTINCT chain_id FROM trj) p)
SELECT (SELECT round(sqrt((avg(v) + var_samp(m)) / avg(v)), 9) FROM (SELECT chain_id, avg(value) AS m, var_samp(value) AS v FROM trj GROUP BY chain_id)) AS max_rhat, (SELECT round(sum(ess), 6) FROM ess_) AS min_ess"""
)
def worst_convergence(b):
    walks = _walks(b)
    return diagnostics.worst(diagnostics.gelman_rubin(walks), diagnostics.pooled_ess(walks)).select((F.round("max_rhat", 9) + 0.0).alias("max_rhat"), (F.round("min_ess", 6) + 0.0).alias("min_ess"))


@query("SELECT chain_id, sample_idx, value FROM tra WHERE sample_idx % 20 = 0")
def every_nth_sample(b):
    return chain.every_nth(b.trajectory(), 20).select("chain_id", "sample_idx", "value")


@query("SELECT chain_id, sample_idx AS step, ((sample_idx - 50) // 7)::INT AS sample_idx, value FROM tra WHERE sample_idx >= 50 AND (sample_idx - 50) % 7 = 0")
def burnin_thin(b):
    steps = b.trajectory().select("chain_id", F.col("sample_idx").cast("long").alias("step"), "value")
    return diagnostics.burn_and_thin(steps, 50, 7)


# --- generators ----------------------------------------------------------------------------
# Random draws have no SQL; each query says of every plan that it makes what must hold of it, and SQL says the same of the tables.


def _facts(nodes: DataFrame, edges: DataFrame, plans: DataFrame, tol: float) -> DataFrame:
    """plan_id, n_nodes, pop, n_districts, connected, within: of every plan, over all its districts."""
    pops = partition.pop_balance(nodes, plans, tol).groupBy("plan_id").agg(F.sum("pop").cast("long").alias("pop"), F.min("within").alias("within"))
    whole = kernels.connectivity(edges, plans).groupBy("plan_id").agg(F.min("connected").alias("connected"), F.count("*").alias("n_districts"))
    count = plans.groupBy("plan_id").agg(F.countDistinct("node_id").alias("n_nodes"))
    return count.join(pops, "plan_id").join(whole, "plan_id").select("plan_id", "n_nodes", "pop", "n_districts", "connected", "within")


def _plan_facts(plans: str) -> str:
    return f"SELECT plan_id, nn AS n_nodes, (SELECT sum(pop) FROM nodes)::BIGINT AS pop, {K}::BIGINT AS n_districts, true AS connected, true AS within FROM cnt, ({plans})"


def _start(b: Bridge) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables' map and a plan of it to walk from."""
    from plansieve.storage import cut

    nodes, edges = cut(b.nodes()), cut(b.edges())
    return nodes, edges, cut(spectral.recursive_bisect(nodes, edges, K))


@query("SELECT 400::BIGINT AS n_nodes, 0::BIGINT AS n_bad_pops, 0::BIGINT AS n_bad_votes, 0::BIGINT AS n_outside, true AS is_connected, true AS is_planar, true AS cities_lean_d", base=False)
def synthetic_state(b):
    """What must hold of a generated state: sizes, ranges, one connected piece, and more D votes where people live densely."""
    nodes, edges, _ = synthetic.make_synthetic_state(b.spark, 400, 8, 5)
    one = graph.graph_summary(nodes, edges)
    votes = F.col("votes_d") + F.col("votes_r")
    rank = F.percent_rank().over(Window.orderBy("pop"))  # a state of 400 rows
    lean = lambda low, high: F.sum(F.when(F.col("rank").between(low, high), F.col("votes_d"))) / F.sum(F.when(F.col("rank").between(low, high), votes))
    checks = nodes.withColumn("rank", rank).agg(
        F.count_if(~(F.col("pop") > 0)).alias("n_bad_pops"), F.count_if(~((F.col("votes_d") >= 0) & (F.col("votes_r") >= 0) & (votes <= F.col("pop")))).alias("n_bad_votes"),
        F.count_if(~(F.col("y").between(0, synthetic.HEIGHT) & (F.col("x") <= synthetic.WIDTH))).alias("n_outside"), (lean(0.8, 1.0) > lean(0.0, 0.2)).alias("cities_lean_d"),
    )
    return one.join(checks).select("n_nodes", "n_bad_pops", "n_bad_votes", "n_outside", "is_connected", (F.col("n_edges") <= 3 * F.col("n_nodes") - 6).alias("is_planar"), "cities_lean_d")


@query(_plan_facts("SELECT 0::BIGINT AS plan_id"))
def spectral_bisect(b):
    nodes, edges, plan = _start(b)
    return _facts(nodes, edges, plan, 0.1)


#: steps, tolerance, lag, burn-in of the walks below
_WALK = (50, 0.15, 10, 200)


@query(_plan_facts(f"SELECT unnest(range({_WALK[0]}))::BIGINT AS plan_id"))
def mcmc_samples(b):
    """Facts of all samples of a chain on the tables' map."""
    nodes, edges, plan = _start(b)
    samples, _ = chain.run(nodes, edges, plan, *_WALK, 42)
    return _facts(nodes, edges, chain.pooled(samples).select("plan_id", "node_id", "district"), _WALK[1])


@query(
    f"""SELECT unnest(range(4))::INT AS chain_id, {_WALK[0]}::BIGINT AS n_samples, {_WALK[3] + (_WALK[0] - 1) * _WALK[2] + 1}::BIGINT AS proposed, true AS adds_up, true AS moved, true AS rate_fits,
  true AS of_its_own, nn AS n_nodes FROM cnt"""
)
def multichain(b):
    """Facts of four chains: their samples, counts of proposals, and that no two end alike."""
    nodes, edges, plan = _start(b)
    samples, stats = chain.run_multichain(nodes, edges, plan, 4, *_WALK)
    each = samples.groupBy("chain_id").agg(F.countDistinct("sample_idx").alias("n_samples"), F.countDistinct("node_id").alias("n_nodes"), F.sum(F.xxhash64("sample_idx", "node_id", "district") % 1_000_003).alias("print"))
    own = each.groupBy("print").agg(F.count("*").alias("alike"))
    s = chain.acceptance(stats).select(
        "chain_id", "proposed", (F.col("proposed") == F.col("accepted") + F.col("rejected_pop") + F.col("rejected_contig")).alias("adds_up"), (F.col("accepted") > 0).alias("moved"),
        (F.abs(F.col("acceptance_rate") * F.col("proposed") - F.col("accepted")) < 1e-6).alias("rate_fits"),
    )
    return s.join(each, "chain_id").join(own, "print").select("chain_id", "n_samples", "proposed", "adds_up", "moved", "rate_fits", (F.col("alike") == 1).alias("of_its_own"), "n_nodes")


@query(_plan_facts("SELECT 0::BIGINT AS plan_id").replace("true AS within", "true AS within, true AS packs_more"))
def gerrymander_walk(b):
    """Facts of the packed plan, and that its favoured party's safest district is as safe as before or safer."""
    nodes, edges, plan = _start(b)
    packed = chain.gerrymandered_plan(nodes, edges, plan, "r")
    top = lambda p: metrics.d_share(partition.district_totals(nodes, p)).agg(F.max("share")).first()[0]
    return _facts(nodes, edges, packed, 0.15).withColumn("packs_more", F.lit(top(packed) >= top(plan)))


@query(
    _WIDE + f"""SELECT metric, {_ROUNDED}, CASE WHEN percentile BETWEEN 5 AND 95 THEN 'neutral' WHEN metric IN ('cut_edge_ratio', 'mst_diameter') THEN CASE WHEN percentile > 95 THEN 'less_compact' ELSE 'more_compact' END
  WHEN metric IN ('modularity', 'polsby_popper', 'reock') THEN CASE WHEN percentile > 95 THEN 'more_compact' ELSE 'less_compact' END ELSE CASE WHEN percentile > 95 THEN 'republican_favoring' ELSE 'democratic_favoring' END END AS direction FROM out7"""
)
def plan_outliers(b):
    """The flagship: is plan 0 an outlier among the plans, by any metric of the bundle?"""
    from plansieve.storage import cut

    wide = metrics.all_metrics(b.nodes(), b.edges(), b.assignment(), b.polygons())
    rows = r9(cut(metrics.long_metrics(wide)), "value")
    return r9(ensemble.outlier_analysis(rows, rows.where("plan_id = 0").select("metric", "value")), "enacted_value", "ensemble_mean", "ensemble_std", "percentile", "p_value_two_sided")
