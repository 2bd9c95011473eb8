"""Selection statistics: Sharpe ratios and their significance, overfitting, bootstraps, ledgers."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rolling import div, finite
from ..staging import stage

EULER = 0.5772156649015329
_PHI = NormalDist()


def sharpe(x):
    """Mean over sample deviation of finite returns; 0 with fewer than two or none spread."""
    x = finite(x)
    return F.when(F.count(x) < 2, 0.0).otherwise(F.coalesce(div(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))), F.lit(0.0)))


def moments(returns: DataFrame, by: list[str], x: str = "ret") -> DataFrame:
    """n, Sharpe ratio, skewness and kurtosis, moments taken over n by the sample deviation."""
    v = finite(F.col(x))
    n = F.count(v)
    shrink = div(n - 1, n)
    few = (n < 3) | (F.coalesce(F.stddev_samp(v), F.lit(0.0)) == 0)
    return returns.groupBy(*by).agg(n.alias("n"), sharpe(F.col(x)).alias("sharpe"), F.when(few, 0.0).otherwise(F.skewness(v) * F.pow(shrink, 1.5)).alias("skew"), F.when(few, 3.0).otherwise((F.kurtosis(v) + 3) * F.pow(shrink, 2)).alias("kurt"))


def psr_statistic(benchmark=0.0):
    """The normal quantile whose probability is the probabilistic Sharpe ratio, over columns of ``moments``."""
    sr = F.col("sharpe")
    spread = F.greatest(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr, F.lit(1e-12))
    return F.when(F.col("n") >= 2, (sr - F.lit(benchmark)) * F.sqrt(F.col("n") - 1.0) / F.sqrt(spread))


def phi(x):
    """Normal distribution function by a series built-in functions can express, to about 1e-7."""
    # fixed values: Abramowitz and Stegun 26.2.17
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * sum((c * F.pow(t, i + 1) for i, c in enumerate(b)), F.lit(0.0))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def psr(sr: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    if n < 2:
        return 0.0
    return _PHI.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(max(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)))


def effective_trials(n: int, rho: float) -> float:
    rho = min(max(rho, 0.0), 1.0)
    return rho + (1 - rho) * n


def expected_max_sharpe(n: float, variance: float) -> float:
    if n < 2 or variance <= 0:
        return 0.0
    q = _PHI.inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * q(1 - 1 / n) + EULER * q(1 - 1 / (n * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, trials: float, variance: float) -> float:
    return psr(sr, n, skew, kurt, expected_max_sharpe(trials, variance))


def min_track_record(sr: float, skew: float, kurt: float, benchmark: float = 0.0, confidence: float = 0.95) -> float:
    if sr <= benchmark:
        return math.inf
    return 1 + max(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12) * (_PHI.inv_cdf(confidence) / (sr - benchmark)) ** 2


def promotion_gate(sr: float, n: int, skew: float, kurt: float, trials: int, variance: float, rho: float = 0.0, least: int = 100, confidence: float = 0.95) -> dict:
    """Verdict with reasons; it passes if there are none."""
    variance = max(variance, 1.0 / n) if n else variance
    bar = expected_max_sharpe(effective_trials(trials, rho), variance)
    dsr, need, why = psr(sr, n, skew, kurt, bar), min_track_record(sr, skew, kurt, bar, confidence), []
    if dsr < confidence:
        why.append(f"deflated Sharpe {dsr:.3f} is below {confidence}")
    if n < least:
        why.append(f"{n} observations are fewer than {least}")
    if need > n:
        why.append("the track record is too short")
    return {"dsr": dsr, "hurdle": bar, "min_track_record": need, "passed": not why, "reasons": why}


def balanced_splits(partitions: int, most: int) -> list[tuple[int, ...]]:
    """Halves of the blocks in lexicographic order; beyond ``most``, those at even steps through them."""
    total = math.comb(partitions, partitions // 2)
    halves = combinations(range(partitions), partitions // 2)
    if total <= most:
        return list(halves)
    wanted = {k * total // most for k in range(most)}
    return [half for k, half in enumerate(halves) if k in wanted]


def pbo(matrix: DataFrame, partitions: int = 16, max_splits: int = 5000) -> DataFrame:
    """A row for each split of (strategy, t, ret): in-sample best, its out-of-sample rank and logit.

    Returns are scanned once, into sums of each block and strategy; splits combine those. t counts from 0 without
    gaps, the tail beyond whole blocks is dropped, returns are centred on the strategy's mean before squares add up.
    Of equal in-sample bests the first by name counts. There must be two strategies or more, and two rows a block.
    """
    if partitions % 2 or partitions < 2:
        raise ValueError("an even number of partitions")
    spark = matrix.sparkSession
    rows = stage(matrix.select("strategy", "t", "ret"), "pbo-matrix")
    shape = rows.agg(F.max("t").alias("last"), F.countDistinct("strategy").alias("n")).first()
    size = ((shape["last"] if shape["last"] is not None else -1) + 1) // partitions
    if shape["n"] < 2:
        raise ValueError("at least two strategies")
    if size < 2:
        raise ValueError(f"{partitions} blocks of two rows or more don't fit into the series")
    centre = F.avg("ret").over(Window.partitionBy("strategy"))
    kept = rows.withColumn("_c", centre).where(F.col("t") < size * partitions).withColumn("_x", F.col("ret") - F.col("_c"))
    blocks = kept.groupBy("strategy", "_c", F.floor(F.col("t") / size).cast("int").alias("block")).agg(F.count("*").alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"))
    # sums of one half are those of all less those of the other, so a row for each block of the inner half does
    whole = blocks.groupBy("strategy").agg(*[F.sum(c).alias(f"all_{c}") for c in "nsq"])
    halves = spark.createDataFrame([(k, list(c)) for k, c in enumerate(balanced_splits(partitions, max_splits))], "split int, blocks array<int>")
    inner = halves.select("split", F.explode("blocks").alias("block"))
    sums = blocks.join(F.broadcast(inner), "block").groupBy("split", "strategy", "_c").agg(*[F.sum(c).alias(f"in_{c}") for c in "nsq"]).join(F.broadcast(whole) if shape["n"] <= 100_000 else whole, "strategy")

    def rate(n, s, q):
        var = (q - s * s / n) / (n - 1)
        return F.coalesce(div(F.col("_c") + s / n, F.sqrt(F.nullif(F.when(var > 0, var), F.lit(0.0)))), F.lit(0.0))

    mine, rest = [F.col(f"in_{c}") for c in "nsq"], [F.col(f"all_{c}") - F.col(f"in_{c}") for c in "nsq"]
    rated = stage(sums.select("split", "strategy", rate(*mine).alias("is_sr"), rate(*rest).alias("oos_sr")), "pbo-rated")
    high = rated.groupBy("split").agg(F.max("is_sr").alias("is_sr"))
    best = rated.join(high, ["split", "is_sr"]).groupBy("split", "is_sr").agg(F.min_by(F.struct("strategy", "oos_sr"), "strategy").alias("b"))
    best = best.select("split", "is_sr", F.col("b.strategy").alias("best"), F.col("b.oos_sr").alias("best_oos"))
    ranks = rated.join(F.broadcast(best), "split").groupBy("split").agg(F.count_if(F.col("oos_sr") <= F.col("best_oos")).alias("_below"))
    out = best.join(ranks, "split").withColumn("rank", F.col("_below") / F.lit(shape["n"] + 1))
    return out.select("split", "best", "is_sr", F.col("best_oos").alias("oos_sr"), "rank", F.ln(div(F.col("rank"), 1 - F.col("rank"))).alias("logit"))


def pbo_summary(splits: DataFrame) -> DataFrame:
    stable = splits.groupBy("best").count().agg(F.max("count").alias("_m"))
    got = splits.agg(F.count("*").alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.coalesce(F.regr_slope("oos_sr", "is_sr"), F.lit(0.0)).alias("slope"), F.avg((F.col("oos_sr") <= 0).cast("double")).alias("loss_probability"), F.median("oos_sr").alias("median_oos"))
    return got.join(F.broadcast(stable)).withColumn("stability", div(F.col("_m"), F.col("splits"))).drop("_m")


def block_size(n: int, lag1: float) -> int:
    """Cube root of n, wider with autocorrelation, at most a tenth of n."""
    if n < 20:
        return max(1, n // 2)
    base = round(n ** (1 / 3))
    rho = min(abs(lag1), 0.99)
    wide = round(base * math.sqrt(1 / (1 - rho)))
    return int(min(max(1, wide), max(2, n // 10)))


def block_bootstrap(series: DataFrame, starts: DataFrame, length: int, n: int, values: int | None = None) -> DataFrame:
    """Circular block bootstrap: ``starts`` (sample_id, block, start) laid over a series (t, ret) of n values.

    A sample has ``values`` values, n if not given.
    """
    place = starts.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    place = place.withColumns({"i": F.col("block") * length + F.col("_j"), "t": F.pmod(F.col("start") + F.col("_j"), F.lit(n)).cast("long")})
    return place.where(F.col("i") < (n if values is None else values)).join(series.select(F.col("t").cast("long").alias("t"), "ret"), "t").select("sample_id", "i", "t", "ret")


def random_starts(spark, samples: int, n: int, length: int, seed: int = 1) -> DataFrame:
    blocks = -(-n // length)
    ids = spark.range(samples).select(F.col("id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return ids.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "sample_id", "block"), F.lit(n)).cast("long"))


def null_cohort(series: DataFrame, samples: int, length: int, n: int, rho: float = 0.0, seed: int = 1, starts: DataFrame | None = None) -> DataFrame:
    """Bootstrapped, demeaned returns of strategies without skill; ``rho`` is what they share.

    ``starts`` (sample_id, block, start) takes the place of drawn ones.
    """
    mean = series.agg(F.avg("ret").alias("_mean"))  # one row
    spark = series.sparkSession
    centred = series.join(F.broadcast(mean)).select("t", (F.col("ret") - F.col("_mean")).alias("ret"))
    drawn = random_starts(spark, samples, n, length, seed) if starts is None else starts
    own = block_bootstrap(centred, drawn, length, n)
    if not rho:
        return own.select("sample_id", "i", "ret")
    common = block_bootstrap(centred, random_starts(spark, 1, n, length, seed + 1), length, n).select("i", F.col("ret").alias("_c"))
    return own.join(common, "i").select("sample_id", "i", (math.sqrt(rho) * F.col("_c") + math.sqrt(1 - rho) * F.col("ret")).alias("ret"))


def null_verdict(cohort: DataFrame, champion: float) -> DataFrame:
    """Best, 95th percentile and median Sharpe of the cohort, the share that reaches the champion."""
    rated = cohort.groupBy("sample_id").agg(sharpe(F.col("ret")).alias("sr"))
    return rated.agg(F.max("sr").alias("best"), F.percentile("sr", 0.95).alias("p95"), F.median("sr").alias("median"), F.avg((F.col("sr") >= champion).cast("double")).alias("p_value")).withColumn("beats_best", F.lit(champion) > F.col("best"))


def gate_calibration(series: DataFrame, repeats: int, trials: int, length: int, n: int, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """False promotions: in every repeat the best of ``trials`` null strategies goes through the gate."""
    cohort = null_cohort(series, repeats * trials, length, n, seed=seed)
    rated = moments(cohort, ["sample_id"]).withColumn("repeat", F.floor(F.col("sample_id") / trials))
    best = rated.groupBy("repeat").agg(F.max(F.struct("sharpe", "n", "skew", "kurt")).alias("b"), F.var_samp("sharpe").alias("v"))
    q = (1 - EULER) * _PHI.inv_cdf(1 - 1 / trials) + EULER * _PHI.inv_cdf(1 - 1 / (trials * math.e))
    flat = best.select("repeat", "b.*", (F.sqrt(F.greatest("v", 1.0 / F.col("b.n"))) * q).alias("hurdle"))
    spread = F.greatest(1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.pow("sharpe", 2), F.lit(1e-12))
    passed = phi((F.col("sharpe") - F.col("hurdle")) * F.sqrt(F.col("n") - 1.0) / F.sqrt(spread)) >= confidence
    return flat.agg(F.count("*").alias("repeats"), F.avg(passed.cast("double")).alias("false_promotions"))


def mean_pairwise_correlation(matrix: DataFrame) -> DataFrame:
    """Mean correlation over pairs of strategies with one return for each t.

    Standardised returns sum to S at each t; the sum of S^2 holds every pair twice, so no pairs are formed.
    """
    w = Window.partitionBy("strategy")
    z = matrix.withColumn("_z", div(F.col("ret") - F.avg("ret").over(w), F.nullif(F.stddev_pop("ret").over(w), F.lit(0.0)))).where("_z IS NOT NULL")
    at = z.groupBy("t").agg(F.sum("_z").alias("_s"), F.count("*").alias("_k"))
    return at.agg(div(F.avg(F.col("_s") * F.col("_s")) - F.max("_k"), F.max("_k") * (F.max("_k") - 1)).alias("mean_corr"))


def pairwise_correlation(matrix: DataFrame) -> DataFrame:
    """Correlation of each two strategies, over the times that both have."""
    a, b = matrix.select("t", F.col("strategy").alias("a"), F.col("ret").alias("ra")), matrix.select("t", F.col("strategy").alias("b"), F.col("ret").alias("rb"))
    return a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("corr"))


def ledger_metrics(trials: DataFrame) -> DataFrame:
    """Counts by kind, spread of the variants' Sharpe ratios, the best; few variants fall back on 1 / observations."""
    v = F.col("kind") == "variant"
    n = F.count_if(v)
    few = F.coalesce(div(F.lit(1.0), F.max(F.when(v, F.nullif(F.col("n_observations"), F.lit(0))))), F.lit(0.0))
    return trials.agg(F.count("*").alias("n_trials"), n.alias("n_variants"), F.count_if(F.col("kind") == "observation").alias("n_observations_kind"), F.count_if(F.col("kind") == "hypothesis").alias("n_hypotheses"), F.when(n < 10, few).otherwise(F.var_samp(F.when(v, F.col("sharpe")))).alias("sharpe_variance"), F.max(F.when(v, F.struct("sharpe", "variant_id"))).alias("_b")).select("*", F.col("_b.variant_id").alias("best_variant"), F.col("_b.sharpe").alias("best_sharpe")).drop("_b")
