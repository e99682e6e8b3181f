"""Significance tests and intervals over predictions and per-seed results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import rates
from riskloom.operators.ranking import seeded_hash

# 5 % critical value of chi-square with one degree, two-sided 95 % normal quantile.
CHI2_CRITICAL_5 = 3.841458820694124
Z_95 = 1.959963984540054

# Cumulative Poisson(1) probabilities, for bootstrap weights 0, 1, 2, ...
POISSON_1 = tuple(math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(statistic: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree; for result tables of a few rows."""
    return statistic.map(lambda x: math.erfc(math.sqrt(x / 2.0)))


def mcnemar(df: DataFrame, best: str, baseline: str, key: str = "key") -> DataFrame:
    """Discordant counts of two models on the same rows and the corrected statistic.

    The two predictions of a row meet in one grouped pass over the two models'
    rows; no self-join.
    """
    right = (F.col("pred") == F.col("truth")).cast("int")
    pairs = (
        df.where(F.col("model").isin(best, baseline)).groupBy(key)
        .agg(
            F.max(F.when(F.col("model") == best, right)).alias("a"),
            F.max(F.when(F.col("model") == baseline, right)).alias("z"),
        )
        .where(F.col("a").isNotNull() & F.col("z").isNotNull())
    )
    counts = pairs.agg(
        F.count("*").alias("n_pairs"),
        F.count_if((F.col("a") == 1) & (F.col("z") == 0)).alias("only_best_right"),
        F.count_if((F.col("a") == 0) & (F.col("z") == 1)).alias("only_baseline_right"),
    )
    b, c = F.col("only_best_right"), F.col("only_baseline_right")
    gap = F.abs(b - c) - 1
    value = rates.ratio((gap * gap).cast("double"), b + c)
    return counts.select("*", value.alias("chi_square"), (value > CHI2_CRITICAL_5).alias("significant"))


def across_seeds(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation of F1 and FNR per model."""
    return runs.groupBy("model").agg(
        F.count("*").alias("n_runs"),
        F.round(F.avg("f1"), 6).alias("f1_mean"), F.round(F.stddev_samp("f1"), 6).alias("f1_std"),
        F.round(F.avg("fnr"), 6).alias("fnr_mean"), F.round(F.stddev_samp("fnr"), 6).alias("fnr_std"),
    )


def paired_t(runs: DataFrame, first: str, second: str, measure: str = "f1") -> DataFrame:
    """Paired t statistic of two models over their common seeds (one row)."""
    per_seed = (
        runs.where(F.col("model").isin(first, second)).groupBy("seed").agg(
            F.max(F.when(F.col("model") == first, F.col(measure))).alias("a"),
            F.max(F.when(F.col("model") == second, F.col(measure))).alias("b"))
        .select((F.col("a") - F.col("b")).alias("d")).where(F.col("d").isNotNull())
    )
    mean, sd, n = F.avg("d"), F.stddev_samp("d"), F.count("*")
    return per_seed.agg(
        n.alias("n_pairs"),
        F.round(mean, 6).alias("mean_difference"),
        F.round(F.when(sd > 0, mean / (sd / F.sqrt(n))), 6).alias("t_statistic"),
        (n - 1).alias("degrees"),
    )


def wilson(hits: Column, total: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval of a rate, ``(0, 0)`` without trials."""
    p, n = hits / total, total.cast("double")
    z2 = z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    zero = F.lit(0.0)
    return (
        F.when(total > 0, F.round(centre - half, 6)).otherwise(zero),
        F.when(total > 0, F.round(centre + half, 6)).otherwise(zero),
    )


def rate_intervals(counts: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Wilson intervals of accuracy, FNR and FPR from confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    parts = [("accuracy", tp + tn, tp + tn + fp + fn), ("fnr", fn, fn + tp), ("fpr", fp, fp + tn)]
    rows = []
    for name, hits, total in parts:
        low, high = wilson(hits, total)
        rows.append(F.struct(
            F.lit(name).alias("measure"), F.round(rates.ratio(hits, total), 6).alias("value"),
            low.alias("low"), high.alias("high")))
    return counts.select(*by, F.inline(F.array(*rows)))


def poisson_weight(key: Column, replicate: Column, seed: int) -> Column:
    """Repeatable Poisson(1) draw for a row in a replicate, from its hash."""
    digits = F.substring(seeded_hash(F.concat_ws("|", replicate, key), seed), 1, 8)
    u = F.conv(digits, 16, 10).cast("double") / float(16**8)
    weight = F.lit(len(POISSON_1))
    for k in range(len(POISSON_1) - 1, -1, -1):
        weight = F.when(u < POISSON_1[k], F.lit(k)).otherwise(weight)
    return weight


def bootstrap_f1(df: DataFrame, replicates: int = 200, seed: int = 42, key: str = "key") -> DataFrame:
    """F1 per model and replicate under a Poisson bootstrap.

    Each row draws its own weight per replicate; the weighted cells are summed on
    the map side, so ``models * replicates`` short rows are all that is shuffled.
    """
    drawn = df.where((F.col("pred") == 1) | (F.col("truth") == 1)).select(
        "model", key, "pred", "truth",
        F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"),
    ).withColumn("w", poisson_weight(F.col(key).cast("string"), F.col("replicate").cast("string"), seed))
    w, t, p = F.col("w"), F.col("truth"), F.col("pred")
    sums = drawn.groupBy("model", "replicate").agg(
        F.sum(F.when((t == 1) & (p == 1), w).otherwise(0)).alias("tp"),
        F.sum(F.when(t != p, w).otherwise(0)).alias("wrong"),
    )
    return sums.select("model", "replicate", rates.ratio(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("wrong")).alias("f1"))


#: Up to this mean a Poisson draw inverts the exact distribution; beyond it, the normal one with a term for skewness.
EXACT_MEAN = 400


def poisson_draw(mean: Column, digest: Column) -> Column:
    """A repeatable Poisson draw from a digest's first sixteen hex digits, inside the row."""
    uniform = lambda start: (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 0.5) / float(16**8)
    u, v = uniform(1), uniform(9)
    z = F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)
    wide = F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * z + (z * z - 1) / 6)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("upto"), u.alias("u"), mean.cast("double").alias("m"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * acc["m"] / i
        return F.when(acc["u"] < acc["upto"], acc).otherwise(F.struct(
            i.cast("long").alias("k"), p.alias("p"), (acc["upto"] + p).alias("upto"), acc["u"].alias("u"), acc["m"].alias("m")))

    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    exact = F.aggregate(F.sequence(F.lit(1), F.least(most, F.lit(3 * EXACT_MEAN))), start, step)["k"]
    return F.when(mean <= EXACT_MEAN, exact).otherwise(wide)


def cell_bootstrap_f1(counts: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """F1 per model and replicate from confusion counts (``model, fp, fn, tp``) alone.

    The weights of n rows under a Poisson bootstrap sum to a Poisson draw with mean n, so a replicate needs one draw for
    the hits and one for the misses of a model, whatever the number of rows; none is copied.
    """
    drawn = counts.select("model", "tp", (F.col("fp") + F.col("fn")).alias("wrong"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    digest = lambda cell: seeded_hash(F.concat_ws("|", F.lit(cell), "model", F.col("replicate").cast("string")), seed)
    sums = drawn.select("model", "replicate", poisson_draw(F.col("tp"), digest("tp")).alias("tp"), poisson_draw(F.col("wrong"), digest("wrong")).alias("wrong"))
    return sums.select("model", "replicate", rates.ratio(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("wrong")).alias("f1"))


def bootstrap_interval(f1: DataFrame) -> DataFrame:
    """95 % percentile interval over the replicates."""
    return f1.groupBy("model").agg(
        F.count("*").alias("n_replicates"),
        F.round(F.avg("f1"), 6).alias("f1_mean"),
        F.round(F.percentile("f1", F.lit(0.025)), 6).alias("f1_low"),
        F.round(F.percentile("f1", F.lit(0.975)), 6).alias("f1_high"),
    )
