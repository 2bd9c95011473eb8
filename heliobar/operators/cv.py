"""Purged cross-validation, leakage reports, causality audit and model quality."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rolling import div, finite
from ..staging import stage


def fold_bounds(n: int, folds: int) -> list[tuple[int, int, int]]:
    """(fold, first, last) of contiguous test blocks."""
    if folds < 2 or n < folds:
        raise ValueError("at least 2 folds and a row for each")
    cuts = [int(n * k / folds) for k in range(folds + 1)]
    return [(k, cuts[k], cuts[k + 1] - 1) for k in range(folds)]


def purged_roles(rows: DataFrame, folds: int = 5, embargo: float = 0.01, n: int | None = None) -> DataFrame:
    """A role for each fold and row (row_idx, t1_idx): test, purged, embargo or train. ``n`` saves a count of rows."""
    n = rows.count() if n is None else n
    wait = int(n * embargo)
    table = rows.sparkSession.createDataFrame(fold_bounds(n, folds), "fold int, lo long, hi long")  # a row a fold
    i, t1 = F.col("row_idx"), F.col("t1_idx")
    role = F.when(i.between(F.col("lo"), F.col("hi")), "test").when((i <= F.col("hi")) & (t1 >= F.col("lo")), "purged").when((i > F.col("hi")) & (i <= F.col("hi") + wait), "embargo").otherwise("train")
    return rows.join(F.broadcast(table)).withColumn("role", role)


def leakage_report(roles: DataFrame) -> DataFrame:
    """Training rows of a fold before and after purging, the share dropped and the mean span of a label."""
    naive = F.sum((F.col("role") != "test").cast("long"))
    kept = F.sum((F.col("role") == "train").cast("long"))
    return roles.groupBy("fold").agg(naive.alias("naive_train"), kept.alias("purged_train"), F.avg(F.col("t1_idx") - F.col("row_idx")).alias("mean_span")).withColumn("dropped", 1 - div(F.col("purged_train"), F.col("naive_train")))


def auc(rows: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums, ties shared; 0.5 with one class only."""
    by = by or []
    # equal scores are counted before they are ranked, so that the window holds distinct scores
    sums = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_q"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = sums.withColumn("_below", F.coalesce(F.sum("_q").over(w), F.lit(0)))
    got = below.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2)).alias("_u"), F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"))
    return got.select(*by, F.coalesce(div(F.col("_u"), F.nullif(F.col("_np") * F.col("_nq"), F.lit(0))), F.lit(0.5)).alias("auc"))


def average_rank(x: str, by: list[str]):
    """Rank from 1 with ties at their mean."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(w.partitionBy(*by, x) if by else Window.partitionBy(x)) - 1) / 2


def information_coefficient(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman correlation within each group; 0 for groups of fewer than 10."""
    ranked = rows.withColumns({"_rx": average_rank(x, by), "_ry": average_rank(y, by)})
    n = F.count("*")
    return ranked.groupBy(*by).agg(F.when(n < 10, 0.0).otherwise(F.coalesce(F.corr("_rx", "_ry"), F.lit(0.0))).alias("ic"), n.alias("n"))


def train_boosted_trees(rows: DataFrame, features: list[str], folds: int = 5, embargo: float = 0.01, rounds: int = 300, depth: int = 4, seed: int = 7):
    """Out-of-fold probabilities of gradient-boosted trees by purged folds: (row_idx, fold, y, oof).

    Folds with fewer than 100 training rows or one class are skipped.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    roles = stage(purged_roles(rows, folds, embargo).where("role IN ('train', 'test')").select("row_idx", "fold", "role", "y", *features), "boosted-roles")
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(roles).withColumn("label", F.col("y").cast("double"))
    sizes = ready.where("role = 'train'").groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()  # a row a fold
    usable = sorted(r["fold"] for r in sizes if r["n"] >= 100 and 0 < r["ones"] < r["n"])

    def one(fold: int) -> DataFrame:
        mine = ready.where(F.col("fold") == fold)
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.03, subsamplingRate=0.7, minInstancesPerNode=60, featureSubsetStrategy="0.7", seed=seed)
        model = trees.fit(mine.where("role = 'train'"))
        return model.transform(mine.where("role = 'test'")).select("row_idx", "fold", "y", vector_to_array("probability")[1].alias("oof"))

    # rounds are many short jobs, one after another; those of different folds fill the cluster together
    with ThreadPoolExecutor(max(len(usable), 1)) as pool:
        parts = list(pool.map(one, usable))
    return reduce(DataFrame.unionByName, parts) if parts else None


def signal_filter(bars: DataFrame, features: list, horizon: int = 24, least: float = 0.55, rounds: int = 300) -> DataFrame:
    """Whether each symbol's signal is let through: by the last out-of-fold probability of boosted trees.

    (symbol, allowed, confidence, reason). Symbols with fewer than 200 bars, or 100 labelled rows, or no fold to
    learn from, are let through at 0.5. Each symbol is fitted on its own.
    """
    from ..functions.indicators import feature_names
    from .labels import panel_dataset

    spark = bars.sparkSession
    sizes = bars.groupBy("symbol").count().collect()  # a row a symbol that is to be judged
    out = []
    for r in sorted(sizes, key=lambda r: r["symbol"]):
        name, fitted, reason = r["symbol"], None, "too few bars"
        if r["count"] >= 200:
            rows = panel_dataset(bars.where(F.col("symbol") == name), features, horizon)
            rows, reason = stage(rows, "filter-rows"), "too few rows"
            if rows.count() >= 100:
                fitted, reason = train_boosted_trees(rows, feature_names(features), rounds=rounds), "no fold to learn from"
        last = fitted.agg(F.max_by("oof", "row_idx")).first()[0] if fitted is not None else None
        if last is None:
            out.append((name, True, 0.5, reason))
        else:
            out.append((name, last >= least, float(last), f"{last:.1%} against {least:.1%}"))
    return spark.createDataFrame(out, "symbol string, allowed boolean, confidence double, reason string")


FeatureFn = Callable[[DataFrame], DataFrame]


def _close(a, b, tolerance: float = 1e-9):
    a, b = finite(a), finite(b)  # what isn't a number is missing here
    far = F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(~far)


def truncation_findings(bars: DataFrame, fn: FeatureFn, columns: list[str], probes: list[int]) -> DataFrame:
    """Columns whose last value over the first t bars differs from the one over all bars: they look ahead."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumn("_i", F.row_number().over(w))
    full = fn(rows)
    table = bars.sparkSession.createDataFrame([(p,) for p in probes], "_t int")  # a row a probe
    cut = rows.join(F.broadcast(table), F.col("_i") <= F.col("_t")).withColumn("symbol", F.concat_ws("@", "symbol", "_t"))
    part = fn(cut).where("_i = _t").withColumn("symbol", F.regexp_replace("symbol", "@[0-9]+$", ""))
    both = part.select("symbol", "_i", *[F.col(c).cast("double").alias(f"{c}_p") for c in columns]).join(full.select("symbol", "_i", *[F.col(c).cast("double") for c in columns]), ["symbol", "_i"])
    bad = F.filter(F.array(*[F.when(~_close(F.col(c), F.col(f"{c}_p")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return both.select("symbol", F.col("_i").alias("probe"), F.explode(bad).alias("feature"))


def future_noise_findings(bars: DataFrame, fn: FeatureFn, columns: list[str], probes: list[int], factor: float = 3.0) -> DataFrame:
    """Columns whose values before bar t move when prices from t on are multiplied."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumn("_i", F.row_number().over(w))
    table = bars.sparkSession.createDataFrame([(p,) for p in probes], "_t int")
    moved = rows.join(F.broadcast(table)).withColumn("symbol", F.concat_ws("@", "symbol", "_t"))
    moved = moved.withColumns({c: F.when(F.col("_i") >= F.col("_t"), F.col(c) * factor).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    part = fn(moved).where("_i < _t").withColumn("symbol", F.regexp_replace("symbol", "@[0-9]+$", ""))
    full = fn(rows).select("symbol", "_i", *[F.col(c).cast("double") for c in columns])
    both = part.select("symbol", "_i", "_t", *[F.col(c).cast("double").alias(f"{c}_p") for c in columns]).join(full, ["symbol", "_i"])
    bad = F.filter(F.array(*[F.when(~_close(F.col(c), F.col(f"{c}_p")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return both.select("symbol", F.col("_t").alias("probe"), F.explode(bad).alias("feature")).distinct()


def warmup_findings(bars: DataFrame, fn: FeatureFn, columns: list[str]) -> list[str]:
    """Columns with a look-back that have no null at all."""
    row = fn(bars).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] == 0]


def audit(bars: DataFrame, fn: FeatureFn, columns: list[str], probes: list[int] | None = None) -> dict:
    n = bars.groupBy("symbol").count().agg(F.min("count")).first()[0] or 0
    probes = probes or sorted({max(2, round(n * k / 8)) for k in range(2, 9)})
    found = {r["feature"] for r in truncation_findings(bars, fn, columns, probes).select("feature").distinct().collect()}
    found |= {r["feature"] for r in future_noise_findings(bars, fn, columns, probes[:6]).select("feature").distinct().collect()}
    return {"checks_run": 2, "leaking": sorted(found), "no_warmup": warmup_findings(bars, fn, columns)}


def assert_causal(bars: DataFrame, fn: FeatureFn, columns: list[str]) -> None:
    if leaking := audit(bars, fn, columns)["leaking"]:
        raise AssertionError(f"features look ahead: {leaking}")


def shuffled_labels(rows: DataFrame, label: str, seed: int = 1) -> DataFrame:
    """Labels permuted over rows."""
    from .labels import global_index

    a = global_index(rows, ["row_idx"], "_k").drop(label)
    b = global_index(rows.select(label, F.rand(seed).alias("_x"), "row_idx"), ["_x", "row_idx"], "_k").select("_k", label)
    return a.join(b, "_k").drop("_k")
