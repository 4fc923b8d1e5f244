"""Plans as assignment(plan_id, node_id, district); every operation works on all plans at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansieve.storage import by_shuffle, row_numbers


def validated(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    if not incomplete_plans(nodes, assignment).isEmpty():
        raise ValueError("a plan leaves graph nodes without a district")
    return assignment


def incomplete_plans(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """plan_id, n_missing of plans that leave nodes out; counts nodes instead of listing all (plan, node)."""
    n = nodes.count()
    known = assignment.join(nodes.select("node_id"), "node_id", "left_semi").groupBy("plan_id").agg(F.countDistinct("node_id").alias("n"))
    plans = assignment.select("plan_id").distinct()
    return plans.join(known, "plan_id", "left").select("plan_id", (F.lit(n) - F.coalesce("n", F.lit(0))).alias("n_missing")).where("n_missing > 0")


def districts(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("plan_id", "district").agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))


def num_districts(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("plan_id").agg(F.countDistinct("district").alias("n_districts"))


def district_totals(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """plan_id, district, n_nodes, pop, votes_d, votes_r."""
    sums = nodes.select("node_id", "pop", "votes_d", "votes_r")  # nodes may carry a district of their own
    return by_shuffle(assignment).join(sums, "node_id").groupBy("plan_id", "district").agg(
        F.count("*").alias("n_nodes"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pop", "votes_d", "votes_r")]
    )


def edge_districts(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """plan_id, u, v, weight, synthetic?, du, dv for each edge in each plan."""
    a = assignment.select("plan_id", F.col("node_id").alias("u"), F.col("district").alias("du"))
    b = assignment.select("plan_id", F.col("node_id").alias("v"), F.col("district").alias("dv"))
    return edges.join(by_shuffle(a), "u").join(by_shuffle(b), ["plan_id", "v"])


def boundary_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    return edge_districts(edges, assignment).where("du <> dv").select("plan_id", "u", "v", "du", "dv")


def flip(assignment: DataFrame, node: int, district: int, plan_id: int | None = None) -> DataFrame:
    """The plan (or all plans) with one node moved."""
    hit = F.col("node_id") == node
    if plan_id is not None:
        hit &= F.col("plan_id") == plan_id
    return assignment.withColumn("district", F.when(hit, F.lit(district).cast("int")).otherwise(F.col("district")))


def replay(start: DataFrame, flips: DataFrame) -> DataFrame:
    """State after a log of flips(plan_id, step, node_id, district): the last flip of a node wins."""
    last = flips.groupBy("plan_id", "node_id").agg(F.max_by("district", "step").alias("new"))
    return start.join(by_shuffle(last), ["plan_id", "node_id"], "left").select("plan_id", "node_id", F.coalesce("new", "district").alias("district"))


def pop_deltas(nodes: DataFrame, start: DataFrame, flips: DataFrame) -> DataFrame:
    """plan_id, step, district, pop: running population of the two districts each flip touches.

    A flip is a signed pair of deltas; a cumulative sum over steps replays an incrementally kept
    aggregate as a window.
    """
    w = Window.partitionBy("plan_id", "node_id").orderBy("step")
    # populations are joined to the start, not to the log, which has many more rows; the log meets them as its window deals it
    before = start.join(by_shuffle(nodes.select("node_id", "pop")), "node_id").select("plan_id", "node_id", F.col("district").alias("first"), "pop")
    f = flips.withColumn("prev", F.lag("district").over(w)).join(by_shuffle(before), ["plan_id", "node_id"])
    f = f.withColumn("src", F.coalesce("prev", "first")).where("src <> district")
    pair = F.inline(F.array(F.struct(F.col("src").alias("district"), (-F.col("pop")).alias("delta")), F.struct(F.col("district"), F.col("pop").alias("delta"))))
    signed = f.select("plan_id", "step", pair)
    base = district_totals(nodes, start).select("plan_id", "district", F.lit(-1).cast("long").alias("step"), F.col("pop").alias("delta"))
    run = Window.partitionBy("plan_id", "district").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return base.unionByName(signed.withColumn("step", F.col("step").cast("long"))).select("plan_id", "step", "district", F.sum("delta").over(run).alias("pop"))


def to_array(assignment: DataFrame) -> DataFrame:
    """plan_id, plan: districts in node order."""
    return assignment.groupBy("plan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("node_id", "district"))), lambda s: s["district"]).alias("plan")
    )


def from_array(plans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inverse of to_array over the nodes in id order; a plan of another length raises."""
    ranked = row_numbers(nodes.select("node_id"), "node_id", "pos")
    n = nodes.count()
    size_ok = F.when(F.size("plan") != n, F.raise_error(F.lit("plan and nodes differ in length"))).otherwise(F.col("plan"))
    return plans.select("plan_id", F.posexplode(size_ok).alias("pos", "district")).join(by_shuffle(ranked), "pos").select("plan_id", "node_id", "district")


def dense_relabel(assignment: DataFrame) -> DataFrame:
    """Districts renamed 0..k-1 in the order of their ids, by plan."""
    names = assignment.select("plan_id", "district").distinct()
    rank = F.dense_rank().over(Window.partitionBy("plan_id").orderBy("district")) - 1
    return assignment.join(names.withColumn("new", rank), ["plan_id", "district"]).select("plan_id", "node_id", F.col("new").cast("int").alias("district"))


def pop_balance(nodes: DataFrame, assignment: DataFrame, tol: float) -> DataFrame:
    """plan_id, district, pop, ideal, within: population in ideal * (1 -+ tol), borders included."""
    t = district_totals(nodes, assignment)
    ideal = t.groupBy("plan_id").agg((F.sum("pop") / F.count("*")).alias("ideal"))
    return t.join(ideal, "plan_id").select("plan_id", "district", "pop", "ideal", F.col("pop").between(F.col("ideal") * (1 - tol), F.col("ideal") * (1 + tol)).alias("within"))


def within(value: Column, ideal: Column, tol: float) -> Column:
    return value.between(ideal * (1 - tol), ideal * (1 + tol))
