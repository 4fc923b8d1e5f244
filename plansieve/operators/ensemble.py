"""Where an enacted value falls in an ensemble. ensemble(metric, value), enacted(metric, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.storage import cut, row_numbers

#: fixed sets of the direction labels
COMPACTNESS_HIGH_IS_LESS = ("cut_edge_ratio", "mst_diameter")
COMPACTNESS_HIGH_IS_MORE = ("modularity", "polsby_popper", "reock")
PARTISAN = ("efficiency_gap", "mean_median")


def _joined(ensemble: DataFrame, enacted: DataFrame) -> DataFrame:
    """Metrics that only one side has are left out; enacted is a handful of rows."""
    return ensemble.join(enacted.withColumnRenamed("value", "v"), "metric")


def percentile_midrank(ensemble: DataFrame, enacted: DataFrame) -> DataFrame:
    x, v = F.col("value"), F.col("v")
    return _joined(ensemble, enacted).groupBy("metric").agg(((F.count_if(x < v) + 0.5 * F.count_if(x == v)) / F.count("*") * 100).alias("percentile"))


def percentile_weak(ensemble: DataFrame, enacted: DataFrame) -> DataFrame:
    """Share at or below, in percent."""
    return _joined(ensemble, enacted).groupBy("metric").agg((F.avg((F.col("value") <= F.col("v")).cast("int")) * 100).alias("percentile"))


def medians(rows: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """key, m: exact medians by place in the order, so no task or buffer holds all values of a key."""
    placed = row_numbers(rows.where(F.col(value).isNotNull()).select(key, value), [key, value], "_at")
    ends = placed.groupBy(key).agg(F.min("_at").alias("_a"), F.count("*").alias("_n"))
    at = F.col("_at") - F.col("_a")
    middle = (at == F.expr("(_n - 1) div 2")) | (at == F.expr("_n div 2"))
    return placed.join(ends, key).where(middle).groupBy(key).agg(F.avg(value).alias("m"))


def two_sided_p_value(ensemble: DataFrame, enacted: DataFrame) -> DataFrame:
    """Share of the ensemble at least as far from its median as the enacted value; may be 0."""
    mid = medians(ensemble)
    far = F.abs(F.col("value") - F.col("m")) >= F.abs(F.col("v") - F.col("m"))
    return _joined(ensemble, enacted).join(mid, "metric").groupBy("metric").agg(F.avg(far.cast("int")).alias("p_value_two_sided"))


def direction(metric: Column, percentile: Column) -> Column:
    """Labels as they are reproduced: high is read as written for each metric, strictly beyond 95 or 5."""
    high, low = percentile > 95, percentile < 5
    neutral = F.lit("neutral")

    def pick(up: str, down: str) -> Column:
        return F.when(high, up).when(low, down).otherwise(neutral)

    return (
        F.when(metric.isin(*COMPACTNESS_HIGH_IS_LESS), pick("less_compact", "more_compact"))
        .when(metric.isin(*COMPACTNESS_HIGH_IS_MORE), pick("more_compact", "less_compact"))
        .when(metric.isin(*PARTISAN), pick("republican_favoring", "democratic_favoring"))
        .otherwise(neutral)
    )


def outlier_analysis(ensemble: DataFrame, enacted: DataFrame) -> DataFrame:
    """metric, enacted_value, ensemble_mean, ensemble_std (population), percentile, p_value_two_sided, direction."""
    mid = medians(ensemble)
    x, v = F.col("value"), F.col("v")
    far = F.abs(x - F.col("m")) >= F.abs(v - F.col("m"))
    out = _joined(ensemble, enacted).join(mid, "metric").groupBy("metric").agg(
        F.max("v").alias("enacted_value"),
        F.avg("value").alias("ensemble_mean"),
        F.stddev_pop("value").alias("ensemble_std"),
        ((F.count_if(x < v) + 0.5 * F.count_if(x == v)) / F.count("*") * 100).alias("percentile"),
        F.avg(far.cast("int")).alias("p_value_two_sided"),
    )
    return out.withColumn("direction", direction(F.col("metric"), F.col("percentile")))


def severity(outliers: DataFrame) -> DataFrame:
    """One row: mean of -log10 of the p-values, none taken below 1e-4; 0 without any."""
    return outliers.agg(F.coalesce(F.avg(-F.log10(F.greatest("p_value_two_sided", F.lit(1e-4)))), F.lit(0.0)).alias("severity"))


def summary_table(outliers: DataFrame, state: str) -> DataFrame:
    return outliers.select(
        F.lit(state).alias("state"), "metric", F.col("enacted_value").alias("enacted"), "ensemble_mean", "ensemble_std", "percentile", F.col("p_value_two_sided").alias("p_two_sided"), "direction"
    )


def with_severity_row(summary: DataFrame, outliers: DataFrame, state: str) -> DataFrame:
    """The summary and one more row that holds the severity."""
    nan = F.lit(float("nan"))
    row = severity(outliers).select(
        F.lit(state).alias("state"), F.lit("_composite_severity").alias("metric"), F.col("severity").alias("enacted"), nan.alias("ensemble_mean"), nan.alias("ensemble_std"), nan.alias("percentile"), nan.alias("p_two_sided"), F.lit("").alias("direction")
    )
    return summary.unionByName(row)


def bootstrap_interval(value: float, sample: np.ndarray, n_boot: int = 1000, ci: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """(p, lo, hi) of one local sample, with numpy's generator; NaN for an empty one."""
    x = np.asarray(sample, dtype=float)
    n = len(x)
    if n == 0:
        return (float("nan"),) * 3

    def p_of(rows: np.ndarray) -> np.ndarray:
        mid = np.median(rows, axis=-1, keepdims=True)
        return (np.abs(rows - mid) >= np.abs(value - mid)).mean(axis=-1)

    p = float(p_of(x[None, :])[0])
    if n < 2 or bool((x == x[0]).all()):
        return p, p, p
    rng = np.random.default_rng(seed)
    draws = np.concatenate([p_of(x[rng.integers(0, n, size=n)][None, :]) for _ in range(n_boot)])
    lo, hi = np.quantile(draws, [(1 - ci) / 2, 1 - (1 - ci) / 2])
    return p, float(lo), float(hi)


def bootstrap_p_value(ensemble: DataFrame, enacted: DataFrame, n_boot: int = 1000, ci: float = 0.95, seed: int = 0, order: str = "plan_id") -> DataFrame:
    """metric, p, lo, hi: p-value and its percentile interval over resamples, each about its own median.

    Draw j of resample r takes the value whose place in `order` is the first eight hexadecimal
    digits of md5("seed:r:j") modulo the sample's size, so resamples are rows of a join, dealt over
    all tasks and the same wherever they are computed; a task's unit is one resample.
    """
    rows = cut(row_numbers(_joined(ensemble, enacted).select("metric", order, "value", "v"), ["metric", order], "_at"))
    sizes = rows.groupBy("metric").agg(F.min("_at").alias("_a"), F.count("*").alias("n"), F.max("v").alias("v"))
    placed = rows.join(sizes.select("metric", "_a"), "metric").select("metric", (F.col("_at") - F.col("_a")).alias("i"), "value")
    resamples = sizes.select("metric", "n", "v", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("r")).repartition("metric", "r")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r"), F.col("j")).cast("binary"))
    drawn = resamples.select("metric", "n", "v", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")).withColumn("i", F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") % F.col("n"))
    drawn = cut(drawn.join(placed, ["metric", "i"]).select("metric", "r", "v", "value"))
    mid = drawn.groupBy("metric", "r").agg(F.median("value").alias("m"))
    far = F.abs(F.col("value") - F.col("m")) >= F.abs(F.col("v") - F.col("m"))
    each = drawn.join(mid, ["metric", "r"]).groupBy("metric", "r").agg(F.avg(far.cast("int")).alias("p"))
    edges = F.percentile("p", F.array(F.lit((1 - ci) / 2), F.lit(1 - (1 - ci) / 2)))
    interval = each.groupBy("metric").agg(edges.alias("e")).select("metric", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
    p = two_sided_p_value(rows.select("metric", "value"), enacted).withColumnRenamed("p_value_two_sided", "p")
    return p.join(interval, "metric").select("metric", "p", "lo", "hi")


def histogram(ensemble: DataFrame, bins: int = 30) -> DataFrame:
    """metric, bin, lo, hi, n: equal widths between the extremes; the top value is in the last bin, a constant in bin 0."""
    ends = ensemble.groupBy("metric").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    place = F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.least(F.floor((F.col("value") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)))
    width = (F.col("b") - F.col("a")) / bins
    return (
        ensemble.join(ends, "metric").groupBy("metric", "a", "b", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
        .select("metric", "bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "n")
    )


def spread(ensemble: DataFrame) -> DataFrame:
    """metric, mean, std (sample)."""
    return ensemble.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
