"""End-to-end analyses: one state, or several side by side in tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansieve.operators import diagnostics, ensemble, graph, metrics, partition
from plansieve.plans import chain, spectral
from plansieve.sources import loaders, sinks, synthetic
from plansieve.storage import cut, scratch

log = logging.getLogger(__name__)


@dataclass
class RunConfig:
    n_chains: int = 3
    n_samples: int = 300
    lag: int = 30
    burn_in: int = 3000
    pop_tol: float = 0.05
    n_boot: int = 500
    first_seed: int = 42
    seed_step: int = 13
    diameter: bool = True
    #: metrics whose convergence is judged; the others show none
    diagnosed: tuple[str, ...] = ("cut_edge_ratio", "efficiency_gap", "mean_median")


#: nodes, districts, favoured party and seed of the synthetic states
STATES = {"PA": (1700, 17, "r", 1), "NC": (1400, 14, "r", 2), "WI": (800, 8, "r", 3), "OH": (1500, 15, "r", 4), "MD": (800, 8, "d", 5)}


def analyze_state(state: str, nodes: DataFrame, edges: DataFrame, enacted: DataFrame, cfg: RunConfig = RunConfig(), polygons: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """A row a metric: state, metric, enacted, spectral, ensemble_mean, ensemble_std, percentile, p_value, p_lo_95, p_hi_95, direction, rhat, ess.

    Metrics of all sampled plans are computed once and used for ranks and convergence alike.
    """
    enacted = cut(partition.dense_relabel(partition.validated(nodes, enacted)))
    k = enacted.select(F.countDistinct("district")).first()[0]
    base = cut(spectral.recursive_bisect(nodes, edges, k, cfg.pop_tol))
    seeds = [cfg.first_seed + cfg.seed_step * i for i in range(cfg.n_chains)]
    samples, _ = chain.run_multichain(nodes, edges, base, cfg.n_chains, cfg.n_samples, cfg.pop_tol, cfg.lag, cfg.burn_in, seeds)
    plans = cut(chain.pooled(samples))

    def of(assignment: DataFrame) -> DataFrame:
        return metrics.long_metrics(metrics.all_metrics(nodes, edges, assignment, polygons, cfg.diameter))

    sampled = cut(of(plans.select("plan_id", "node_id", "district")))
    mine, spectral_ = (cut(of(a).select("metric", "value")) for a in (enacted, base))
    out = ensemble.outlier_analysis(sampled, mine)
    boot = ensemble.bootstrap_p_value(sampled, mine, cfg.n_boot, seed=cfg.first_seed)
    walks = sampled.where(F.col("metric").isin(*cfg.diagnosed)).join(plans.select("plan_id", "chain_id", "sample_idx").distinct(), "plan_id")
    walks = cut(diagnostics.common_length(walks.select("metric", "chain_id", "sample_idx", "value")))
    rhat = diagnostics.gelman_rubin(walks)
    size = diagnostics.pooled_ess(walks)
    nan = F.lit(float("nan"))
    return (
        out.join(spectral_.withColumnRenamed("value", "spectral"), "metric").join(boot, "metric").join(rhat, "metric", "left").join(size, "metric", "left")
        .select(
            F.lit(state).alias("state"), *([F.lit(name).alias("name")] if name else []), "metric", F.col("enacted_value").alias("enacted"), "spectral", "ensemble_mean", "ensemble_std", "percentile",
            F.col("p_value_two_sided").alias("p_value"), F.col("lo").alias("p_lo_95"), F.col("hi").alias("p_hi_95"), "direction", F.coalesce("rhat", nan).alias("rhat"), F.coalesce("ess", nan).alias("ess"),
        )
    )


def synthetic_state(spark: SparkSession, state: str, cfg: RunConfig = RunConfig(lag=40, burn_in=4000, pop_tol=0.06), size: tuple[int, int, str, int] | None = None) -> DataFrame:
    """A generated state whose enacted plan is packed for a party."""
    n, k, party, seed = size or STATES[state]
    nodes, edges, _ = synthetic.make_synthetic_state(spark, n, k, seed)
    nodes, edges = cut(nodes), cut(edges)
    base = cut(spectral.recursive_bisect(nodes, edges, k, cfg.pop_tol))
    return analyze_state(state, nodes, edges, chain.gerrymandered_plan(nodes, edges, base, party, pop_tol=cfg.pop_tol), cfg)


def cross_state(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all rows, a row a state by falling severity with its worst convergence)."""
    rows = None
    for t in tables.values():
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    heads = rows.groupBy("state").agg(
        F.avg(-F.log10(F.greatest("p_value", F.lit(1e-4)))).alias("severity"), F.max(ok("rhat")).alias("max_rhat"), F.min(ok("ess")).alias("min_ess"), F.count("*").alias("n_metrics")
    )
    return rows, heads.orderBy(F.desc("severity"), "state")


def run_all(spark: SparkSession, out: str, states: dict[str, tuple[int, int, str, int]] | None = None, cfg: RunConfig = RunConfig(lag=40, burn_in=4000, pop_tol=0.06)) -> None:
    """Every state's table as CSV, the cross-state tables, and the settings; a state that fails is logged and left out."""
    states = states or STATES
    _run_states(spark, out, {s: lambda s=s, v=v: synthetic_state(spark, s, cfg, v) for s, v in states.items()}, cfg, {s: list(v) for s, v in states.items()})


def real_state(spark: SparkSession, state: str, folder: str, cfg: RunConfig = RunConfig()) -> DataFrame:
    """A state whose precincts and enacted plan are read from its folder of public files; polygons join the bundle."""
    load = loaders.MGGG_LOADERS.get(state.lower()) or loaders.STATE_LOADERS.get(state.lower())
    if load is None:
        raise ValueError(f"no loader for {state}")
    precincts = cut(load(spark, folder))
    nodes, edges = graph.build_graph(precincts, district="district")
    nodes, edges = cut(nodes), cut(edges)
    enacted = nodes.select(F.lit(0).cast("long").alias("plan_id"), "node_id", "district")
    return analyze_state(state, nodes, edges, enacted, cfg, precincts.select("node_id", "rings"))


def run_all_real(spark: SparkSession, out: str, folders: dict[str, str], cfg: RunConfig = RunConfig()) -> None:
    """As run_all, over states read from folders."""
    _run_states(spark, out, {s: lambda s=s, f=f: real_state(spark, s, f, cfg) for s, f in folders.items()}, cfg, folders)


def _run_states(spark: SparkSession, out: str, analyses: dict, cfg: RunConfig, states: dict) -> None:
    with scratch(spark):
        tables = {}
        for state, analyse in analyses.items():
            try:
                tables[state] = cut(analyse())
                sinks.write_csv(tables[state], f"{out}/{state}_summary")
            except Exception:
                log.exception("%s failed", state)
        if tables:
            rows, heads = cross_state(tables)
            sinks.write_csv(rows, f"{out}/all_metrics")
            sinks.write_csv(heads, f"{out}/cross_state")
    sinks.write_run_config(f"{out}/run_config.json", states=states, **cfg.__dict__ | {"diagnosed": list(cfg.diagnosed)})


def figure_data(
    nodes: DataFrame, edges: DataFrame, assignment: DataFrame, sampled: DataFrame, bins: int = 30, trajectory: DataFrame | None = None, max_lag: int = 30
) -> dict[str, DataFrame]:
    """What a state's figures are drawn from: histogram bins with the plan's own value, district map points and borders,
    seats-votes curves with their ideal line, vote shares by rank, and, of a trajectory, its trace and autocorrelation."""
    totals = partition.district_totals(nodes, assignment)
    curve = metrics.seats_votes_curve(totals)
    mine = metrics.long_metrics(metrics.all_metrics(nodes, edges, assignment)).select("metric", F.col("value").alias("enacted"))
    shares = metrics.d_share(totals)
    out = {
        "histogram": ensemble.histogram(sampled, bins).join(mine, "metric", "left"),
        "map": nodes.select("node_id", "x", "y").join(assignment, "node_id"),
        "borders": partition.boundary_edges(edges, assignment),
        "seats_votes": metrics.symmetric_ideal(curve, partition.num_districts(assignment)),
        "shares": shares.withColumn("rank", F.row_number().over(Window.partitionBy("plan_id").orderBy("share", "district"))),
    }
    if trajectory is not None:
        out |= {"trace": trajectory, "autocorrelation": diagnostics.autocorrelation(trajectory, max_lag)}
    return out


def ensemble_figures(nodes: DataFrame, edges: DataFrame, base: DataFrame, samples: DataFrame, every: int = 20, bins: int = 30) -> dict[str, DataFrame]:
    """What a baseline plan (plan_id 0) beside one chain's samples is drawn from.

    histogram: bins of each metric with the baseline's value; maps: the baseline (sample_idx -1) and the
    first, middle and last sample; seats_votes: curves of the baseline, with its ideal line, and of every
    `every`-th sample.
    """
    n = samples.agg(F.countDistinct("sample_idx")).first()[0]
    plans = samples.select(F.col("sample_idx").cast("long").alias("plan_id"), "node_id", "district")
    of = lambda a: metrics.long_metrics(metrics.all_metrics(nodes, edges, a))
    shown = samples.where(F.col("sample_idx").isin(0, n // 2, n - 1))
    maps = shown.select("sample_idx", "node_id", "district").unionByName(base.select(F.lit(-1).alias("sample_idx"), "node_id", "district"))
    curve = lambda a: metrics.seats_votes_curve(partition.district_totals(nodes, a))
    mine = metrics.symmetric_ideal(curve(base), partition.num_districts(base))
    some = curve(chain.every_nth(samples, every).select(F.col("sample_idx").cast("long").alias("plan_id"), "node_id", "district"))
    return {
        "histogram": ensemble.histogram(of(plans), bins).join(of(base).select("metric", F.col("value").alias("baseline")), "metric", "left"),
        "maps": nodes.select("node_id", "x", "y").join(maps, "node_id"),
        "seats_votes": mine.withColumn("plan_id", F.lit(-1).cast("long")).unionByName(some, allowMissingColumns=True),
    }
