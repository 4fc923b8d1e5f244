"""The star-schema tables read as a map, plans and chains, by fixed rules.

A customer is a precinct on a lattice 25 wide; its orders are its people, their cents in
state F and O its votes. Twenty plans are shifted bands of customers; plan 0 is the enacted
one. Users modulo four are chains of event values in cents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, PLANS, K = 25, 20, 8


@dataclass
class Bridge:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def n(self) -> int:
        return self.table("customer").count()

    def nodes(self) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        votes = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, cents)), F.lit(0))
        orders = self.table("orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.count("*").alias("pop"), votes("F").alias("votes_d"), votes("O").alias("votes_r"))
        ids = self.table("customer").select(F.col("c_custkey").alias("node_id"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return ids.join(orders, "node_id", "left").select(
            "node_id", *[zero(c) for c in ("pop", "votes_d", "votes_r")], (F.col("node_id") % WIDTH).alias("x"), F.expr(f"node_id div {WIDTH}").alias("y")
        )

    def edges(self) -> DataFrame:
        n, i = self.n(), F.col("c_custkey")
        ids = self.table("customer").select("c_custkey")
        ends = F.filter(F.array(F.when(i % WIDTH < WIDTH - 1, i + 1), i + WIDTH), lambda v: v < n)
        return ids.select(i.alias("u"), F.explode(ends).alias("v")).select("u", "v", F.lit(1.0).alias("weight"), F.lit(False).alias("synthetic"))

    def assignment(self, plans: int = PLANS) -> DataFrame:
        n = self.n()
        district = F.expr(f"cast(pmod(((node_id + 37 * plan_id) * {K}) div {n}, {K}) as int)")
        ids = self.table("customer").select(F.col("c_custkey").alias("node_id"))
        return ids.withColumn("plan_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(plans - 1).cast("long")))).select("plan_id", "node_id", district.alias("district"))

    def polygons(self) -> DataFrame:
        x, y = (F.col("node_id") % WIDTH).cast("double"), F.expr(f"cast(node_id div {WIDTH} as double)")
        pt = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
        ring = F.array(pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 1), pt(0, 0))
        return self.table("customer").select(F.col("c_custkey").alias("node_id")).select("node_id", F.array(ring).alias("rings"))

    def trajectory(self) -> DataFrame:
        e = self.table("events").select((F.col("user_id") % 4).cast("int").alias("chain_id"), "ts", "event_id", F.round(F.col("value") * 100).alias("value"))
        w = Window.partitionBy("chain_id").orderBy("ts", "event_id")
        return e.select(F.lit("value").alias("metric"), "chain_id", (F.row_number().over(w) - 1).alias("sample_idx"), "value")

    def prices(self) -> DataFrame:
        """ensemble(metric, plan_id, value) without a graph: order totals by priority."""
        return self.table("orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_orderkey").alias("plan_id"), F.col("o_totalprice").alias("value"))
