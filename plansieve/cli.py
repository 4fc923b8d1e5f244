"""python -m plansieve.cli build|ensemble|analyze|all ...: the staged runs over parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plansieve import pipeline
from plansieve.operators import ensemble, metrics
from plansieve.operators.graph import build_graph
from plansieve.plans import chain, spectral
from plansieve.sources import loaders, sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="plansieve")
    sub = p.add_subparsers(dest="stage", required=True)
    b = sub.add_parser("build")
    b.add_argument("state")
    b.add_argument("raw")
    b.add_argument("out")
    e = sub.add_parser("ensemble")
    e.add_argument("folder")
    e.add_argument("--samples", type=int, default=1000)
    e.add_argument("--lag", type=int, default=100)
    e.add_argument("--burn-in", type=int, default=10_000)
    e.add_argument("--pop-tol", type=float, default=0.02)
    e.add_argument("--seed", type=int, default=42)
    a = sub.add_parser("analyze")
    a.add_argument("state")
    a.add_argument("folder")
    r = sub.add_parser("all")
    r.add_argument("out")
    r.add_argument("--real", nargs="*", metavar="STATE=FOLDER", help="states read from folders of public files instead of generated ones")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.stage == "build":
        precincts = loaders.load_state(spark, args.state, args.raw)
        sinks.write_parquet(precincts, f"{args.out}/precincts")
        sinks.write_graph(*build_graph(spark.read.parquet(f"{args.out}/precincts"), district="district"), args.out)
    elif args.stage == "ensemble":
        nodes, edges = sinks.read_graph(spark, args.folder)
        k = nodes.select(F.countDistinct("district")).first()[0]
        base = spectral.recursive_bisect(nodes, edges, k, args.pop_tol)
        samples, stats = chain.run(nodes, edges, base, args.samples, args.pop_tol, args.lag, args.burn_in, args.seed)
        plans = chain.pooled(samples).select("plan_id", "node_id", "district")
        sinks.write_parquet(plans, f"{args.folder}/assignments")
        sinks.write_parquet(chain.acceptance(stats), f"{args.folder}/chain_stats")
        polygons = spark.read.parquet(f"{args.folder}/precincts").select("node_id", "rings")
        sinks.write_parquet(metrics.all_metrics(nodes, edges, spark.read.parquet(f"{args.folder}/assignments"), polygons), f"{args.folder}/metrics")
        enacted = nodes.select(F.lit(0).cast("long").alias("plan_id"), "node_id", "district")
        base_rows = [metrics.all_metrics(nodes, edges, x, polygons).drop("plan_id").withColumn("plan", F.lit(n)) for n, x in (("enacted", enacted), ("spectral", base))]
        sinks.write_parquet(base_rows[0].unionByName(base_rows[1]), f"{args.folder}/baselines")
    elif args.stage == "analyze":
        sampled = metrics.long_metrics(spark.read.parquet(f"{args.folder}/metrics"))
        mine = spark.createDataFrame(list(sinks.baseline_metrics(spark, f"{args.folder}/baselines").items()), "metric string, value double")
        out = ensemble.outlier_analysis(sampled, mine)
        sinks.write_csv(ensemble.with_severity_row(ensemble.summary_table(out, args.state), out, args.state), f"{args.folder}/{args.state}_summary")
    elif args.real:
        pipeline.run_all_real(spark, args.out, dict(x.split("=", 1) for x in args.real))
    else:
        pipeline.run_all(spark, args.out)


if __name__ == "__main__":
    main()
