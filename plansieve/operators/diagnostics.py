"""Convergence diagnostics of trajectory(metric, chain_id, sample_idx, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansieve.storage import ship


def common_length(trajectory: DataFrame) -> DataFrame:
    """Rows of all chains of a metric up to the shortest one's length."""
    n = trajectory.groupBy("metric", "chain_id").agg(F.count("*").alias("n")).groupBy("metric").agg(F.min("n").alias("n"))
    return trajectory.join(n, "metric").where("sample_idx < n").drop("n")


def gelman_rubin(trajectory: DataFrame) -> DataFrame:
    """metric, rhat = sqrt((W + B/n) / W), 1 if W is 0. Fewer than two chains, samples, or unequal lengths raise."""
    chain = trajectory.groupBy("metric", "chain_id").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.count("*").alias("n"))
    out = chain.groupBy("metric").agg(F.avg("var").alias("w"), F.var_samp("mean").alias("b"), F.count("*").alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    bad = (F.col("m") < 2) | (F.col("lo") < 2) | (F.col("lo") != F.col("hi"))
    rhat = F.when(bad, F.raise_error(F.lit("R-hat needs two chains or more of one length, of two samples or more")).cast("double"))
    return out.select("metric", rhat.when(F.col("w") == 0, 1.0).otherwise(F.sqrt((F.col("w") + F.col("b")) / F.col("w"))).alias("rhat"))


def autocorrelation(trajectory: DataFrame, max_lag: int) -> DataFrame:
    """metric, chain_id, lag, rho for lags 0..max_lag; biased, about the series' mean; 0 past lag 0 for constants.

    An equi-join on (chain, index + lag): each row meets max_lag others. Raises if a chain has max_lag
    samples or fewer.
    """
    keys = ["metric", "chain_id"]
    stats = trajectory.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    ok = F.when(F.col("n") <= max_lag, F.raise_error(F.lit("max_lag must be smaller than the series")).cast("double")).otherwise(F.col("mean"))
    c = trajectory.join(stats.select(*keys, ok.alias("mean"), "n"), keys).select(*keys, "sample_idx", (F.col("value") - F.col("mean")).alias("x"), "n")
    lags = c.select(*keys, "x", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), "sample_idx").select(*keys, "lag", (F.col("sample_idx") - F.col("lag")).alias("sample_idx"), F.col("x").alias("y"))
    products = c.join(lags, [*keys, "sample_idx"]).groupBy(*keys, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    zero = products.where("lag = 0").select(*keys, F.col("s").alias("s0"))
    rho = F.when(F.col("lag") == 0, 1.0).when(F.col("s0") == 0, 0.0).otherwise(F.col("s") / F.col("s0"))
    return products.join(zero, keys).select(*keys, "lag", rho.alias("rho"))


def acf(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Biased autocorrelation by FFT, n log n in the series."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    if max_lag >= n:
        raise ValueError("max_lag must be smaller than the series")
    c = x - x.mean()
    top = float(c @ c)
    if top == 0:
        return np.concatenate([[1.0], np.zeros(max_lag)])
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(c, size)
    r = np.fft.irfft(f * np.conj(f), size)[: max_lag + 1] / top
    r[0] = 1.0
    return r


def ess(x: np.ndarray, max_lag: int | None = None) -> float:
    """n / tau with tau summed over initial positive pairs of lags (1, 2), (3, 4), ..."""
    n = len(x)
    if n < 2:
        return float(n)
    top = min(max(1, n // 4), n - 1) if max_lag is None else max_lag
    rho = acf(x, top)
    if not rho[1:].any():
        return float(n)
    tau = 1.0
    for k in range(1, top, 2):
        s = rho[k] + rho[k + 1]
        if s <= 0:
            break
        tau += 2 * s
    return n / tau if tau > 0 else float(n)


def effective_sample_size(trajectory: DataFrame) -> DataFrame:
    """metric, chain_id, ess. A chain is inherently one series, so it is one task's unit."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("sample_idx")["value"].to_numpy()
        return pd.DataFrame({"metric": [pdf["metric"].iloc[0]], "chain_id": [int(pdf["chain_id"].iloc[0])], "ess": [ess(x)]})

    ship()
    return trajectory.select("metric", F.col("chain_id").cast("int").alias("chain_id"), "sample_idx", "value").groupBy("metric", "chain_id").applyInPandas(one, "metric string, chain_id int, ess double")


def pooled_ess(trajectory: DataFrame) -> DataFrame:
    """metric, ess: the sum over chains."""
    return effective_sample_size(trajectory).groupBy("metric").agg(F.sum("ess").alias("ess"))


def burn_and_thin(steps: DataFrame, burn_in: int, lag: int) -> DataFrame:
    """Rows of a step log that a sampler keeps, numbered from 0."""
    due = steps.where((F.col("step") >= burn_in) & ((F.col("step") - burn_in) % lag == 0))
    return due.withColumn("sample_idx", ((F.col("step") - burn_in) / lag).cast("int"))


def worst(rhats: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: largest R-hat and smallest sample size, NaN left out."""
    return rhats.where(~F.isnan("rhat")).agg(F.max("rhat").alias("max_rhat")).join(sizes.where(~F.isnan("ess")).agg(F.min("ess").alias("min_ess")))


def indexed(rows: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """sample_idx from 0 in each chain."""
    return rows.withColumn("sample_idx", F.row_number().over(Window.partitionBy(chain).orderBy(*order)) - 1)
