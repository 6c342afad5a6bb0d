"""Comparison graphs and the Thurstone model fitted on them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maths import ERF_A, ERF_P, log_loss, preference_probability
from ..sources.writers import scratch
from .allocation import hash_key, hash_rank

MOST_EDGES = 2_000_000  # edges that one task fits
#: Fixed value: passes of a fit.
EPOCHS = 1000


def pair_pool(options: DataFrame, share: float = 0.1, most: int = 1000, seed: int = 42) -> DataFrame:
    """(a, b, holdout) of all unordered pairs; the holdout are the min(share of all, most) pairs first in hash order."""
    x = options.select(F.col("id").alias("a"))
    pairs = x.join(options.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    n = options.count()
    held = min(int(n * (n - 1) // 2 * share), most)
    keyed = pairs.withColumn("pair", F.concat_ws("-", "a", "b"))
    return hash_rank(keyed, "pair", seed).select("a", "b", (F.col("_rank") <= held).alias("holdout"))


def regular_graph(options: DataFrame, degree: int) -> DataFrame:
    """(a, b): every option, in order of ids, is tied to the degree/2 that follow it around a ring (and to its opposite if the degree is odd)."""
    n = options.count()
    if degree >= n or (degree % 2 and n % 2):
        raise ValueError(f"no {degree}-regular graph on {n} options")
    from .ranking import ranked

    placed = ranked(options.select("id"), "id").select("id", (F.col("_rank") - 1).alias("p"))
    steps = list(range(1, degree // 2 + 1))
    ties = placed.select("id", F.explode(F.array(*(F.pmod(F.col("p") + s, F.lit(n)) for s in steps), *([F.when(F.col("p") < n // 2, F.col("p") + n // 2)] if degree % 2 else []))).alias("q")).filter("q IS NOT NULL")
    other = placed.select(F.col("id").alias("other"), F.col("p").alias("q"))
    return ties.join(other, "q").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def random_edges(pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return pool.withColumn("_h", hash_key(seed, F.concat_ws("-", "a", "b"))).orderBy("_h", "a", "b").limit(n).drop("_h")


def add_edges(edges: DataFrame, new: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, pool) after an upsert: a new edge replaces its old one in either orientation and leaves the pool."""
    key = lambda df: df.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
    fresh = key(new).select("_x", "_y").distinct()
    merged = key(edges).join(fresh, ["_x", "_y"], "left_anti").drop("_x", "_y").unionByName(new)
    return merged, key(pool).join(fresh, ["_x", "_y"], "left_anti").drop("_x", "_y")


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def with_utilities(edges: DataFrame, utilities: DataFrame) -> DataFrame:
    """edges with p, the model's probability that a wins."""
    x = utilities.select(F.col("id").alias("a"), F.col("mean").alias("ma"), F.col("variance").alias("va"))
    y = utilities.select(F.col("id").alias("b"), F.col("mean").alias("mb"), F.col("variance").alias("vb"))
    return edges.join(x, "a").join(y, "b").withColumn("gap", F.abs(F.col("ma") - F.col("mb"))).withColumn("p", preference_probability("ma", "va", "mb", "vb")).drop("ma", "va", "mb", "vb")


def active_select(utilities: DataFrame, edges: DataFrame, pool: DataFrame, n: int, p: float, q: float, seed: int = 42) -> DataFrame:
    """n pool pairs among those whose utility gap lies in the lowest share p and whose degree sum lies in the lowest share q.

    Both shares widen by half, five times at most, until there are n; what is still missing comes from the rest in hash order.
    """
    d = degree(edges)
    of = lambda c: d.select(F.col("id").alias(c), F.col("degree").alias(f"d{c}"))
    rated = with_utilities(pool.select("a", "b"), utilities).join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("sum", F.coalesce("da", F.lit(0)) + F.coalesce("db", F.lit(0))).select("a", "b", "gap", "sum")
    shares = [(min(1.0, p * 1.5**k), min(1.0, q * 1.5**k)) for k in range(6)]
    cuts = rated.agg(*(F.percentile("gap", x).alias(f"g{k}") for k, (x, _) in enumerate(shares)), *(F.percentile("sum", y).alias(f"s{k}") for k, (_, y) in enumerate(shares)))
    level = F.lit(len(shares))
    for k in reversed(range(len(shares))):
        level = F.when((F.col("gap") <= F.col(f"g{k}")) & (F.col("sum") <= F.col(f"s{k}")), k).otherwise(level)
    levelled = rated.join(F.broadcast(cuts)).select("a", "b", level.alias("level"))
    counts = {r["level"]: r["n"] for r in levelled.groupBy("level").agg(F.count("*").alias("n")).collect()}  # seven rows at most
    total, reach = 0, len(shares)
    for k in range(len(shares)):
        total += counts.get(k, 0)
        if total >= n:
            reach = k
            break
    first = F.when(F.col("level") <= reach, 0).otherwise(1)
    return levelled.withColumn("_f", first).withColumn("_h", hash_key(seed, F.concat_ws("-", "a", "b"))).orderBy("_f", "_h").limit(n).select("a", "b")


def pseudolabel(utilities: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """(a, b, probability_a): hard labels of pool pairs on which the model is sure enough."""
    p = with_utilities(pool, utilities)
    return p.filter((F.col("p") >= threshold) | (F.col("p") <= 1 - threshold)).select("a", "b", F.when(F.col("p") >= threshold, 1.0).otherwise(0.0).alias("probability_a"))


def _gradient(a: np.ndarray, b: np.ndarray, y: np.ndarray, mu: np.ndarray, log_s2: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the cross entropy of some edges by normed means and by log variances; `total` edges share it."""
    n, s2 = len(mu), np.exp(log_s2)
    z_mu = (mu - mu.mean()) / (mu.std(ddof=1) + 1e-5)
    scale = np.sqrt(s2[a] + s2[b] + 1e-5)
    z = (z_mu[a] - z_mu[b]) / scale
    p = np.clip(0.5 * (1 + _erf(z / math.sqrt(2))), 1e-5, 1 - 1e-5)
    g = (p - y) / (p * (1 - p)) * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / total
    g_s = -0.5 * g * z / scale**2
    return np.bincount(a, g / scale, n) - np.bincount(b, g / scale, n), (np.bincount(a, g_s, n) + np.bincount(b, g_s, n)) * s2


def _descend(gradient: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, epochs: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Adam over means and log variances; means come out with mean 0 and unit deviation, variances as they are."""
    mu, log_s2 = np.linspace(-0.01, 0.01, n), np.zeros(n)
    m = v = np.zeros(2 * n)
    for step in range(1, epochs + 1):
        g_z, g_log = gradient(mu, log_s2)
        sd = mu.std(ddof=1) + 1e-5
        z_mu = (mu - mu.mean()) / sd
        grad = np.r_[(g_z - g_z.mean() - z_mu * (g_z @ z_mu) / max(1, n - 1)) / sd, g_log]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        mu, log_s2 = mu - move[:n], log_s2 - move[n:]
    return (mu - mu.mean()) / (mu.std(ddof=1) + 1e-5), np.exp(log_s2)


def _erf(x: np.ndarray) -> np.ndarray:
    """By the rational approximation of normal_cdf."""
    t = 1 / (1 + ERF_P * np.abs(x))
    return np.sign(x) * (1 - t * np.polyval([*reversed(ERF_A)], t) * np.exp(-x * x))


def fit_arrays(a: np.ndarray, b: np.ndarray, y: np.ndarray, n: int, epochs: int = EPOCHS, rate: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Means (mean 0, unit deviation) and variances that fit win probabilities y of a over b."""
    return _descend(lambda mu, log_s2: _gradient(a, b, y, mu, log_s2, len(y)), n, epochs, rate)


def fit_spread(edges: DataFrame, epochs: int = EPOCHS, rate: float = 0.01) -> DataFrame:
    """(id, mean, variance) of one battery of any number of edges: each epoch is a pass over the edges where they lie, whose partitions send a gradient of options.

    Options, unlike edges, fit one machine; edges are written once to the shared folder.  The same numbers as fit_thurstone up to the order of sums.
    """
    spark = edges.sparkSession
    ids = [r[0] for r in edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().orderBy("id").collect()]
    place = spark.sparkContext.broadcast(np.array(ids, dtype=np.int64))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"a": np.searchsorted(place.value, f["a"]), "b": np.searchsorted(place.value, f["b"]), "y": f["probability_a"].to_numpy(float)})

    path = scratch(spark, "edges")
    edges.select("a", "b", "probability_a").mapInPandas(placed, "a long, b long, y double").write.parquet(path)
    own = spark.read.schema("a long, b long, y double").parquet(path)
    total = own.count()

    def gradient(mu: np.ndarray, log_s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((2, len(mu)))
            for f in frames:
                sums += _gradient(f["a"].to_numpy(), f["b"].to_numpy(), f["y"].to_numpy(), mu, log_s2, total)
            yield pd.DataFrame({"i": np.arange(len(mu)), "z": sums[0], "s": sums[1]})

        sums = own.mapInPandas(part, "i long, z double, s double").groupBy("i").agg(F.sum("z").alias("z"), F.sum("s").alias("s")).toPandas().sort_values("i")
        return sums["z"].to_numpy(), sums["s"].to_numpy()

    mu, s2 = _descend(gradient, len(ids), epochs, rate)
    return spark.createDataFrame(pd.DataFrame({"id": ids, "mean": mu, "variance": s2}), "id long, mean double, variance double")


def fit_thurstone(edges: DataFrame, group: str | None = None, epochs: int = EPOCHS) -> DataFrame:
    """([group,] id, mean, variance): one fit a battery; batteries are fitted side by side, each in one task.

    Without groups a battery of more than `MOST_EDGES` edges goes to fit_spread; a group that large raises: fit it alone.
    """
    if group is None and edges.count() > MOST_EDGES:
        return fit_spread(edges, epochs)
    grouped = edges.withColumn("_g", F.col(group) if group else F.lit(0))
    kind = dict(grouped.dtypes)["_g"]

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > MOST_EDGES:
            raise ValueError(f"a battery of {len(f)} edges; {MOST_EDGES} is the bound of a group")
        f = f.sort_values(["a", "b"])
        ids, place = np.unique(np.r_[f["a"], f["b"]], return_inverse=True)
        mu, s2 = fit_arrays(place[: len(f)], place[len(f) :], f["probability_a"].to_numpy(float), len(ids), epochs)
        return pd.DataFrame({"_g": f["_g"].iloc[0], "id": ids, "mean": mu, "variance": s2})

    out = grouped.select("_g", "a", "b", "probability_a").groupBy("_g").applyInPandas(fit, f"_g {kind}, id long, mean double, variance double")
    return out.withColumnRenamed("_g", group) if group else out.drop("_g")


def eval_thurstone(utilities: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, log_loss, accuracy) on edges; ties of the model count as a win of a."""
    p = with_utilities(edges.select("a", "b", "probability_a"), utilities)
    right = (F.col("p") >= 0.5) == (F.col("probability_a") >= 0.5)
    return p.agg(F.count("*").alias("n"), F.avg(log_loss("p", "probability_a")).alias("log_loss"), F.avg(right.cast("double")).alias("accuracy"))


def target_edges(options: int, multiplier: float) -> int:
    """How many comparisons a battery aims at: multiplier * N * log2 N."""
    return int(multiplier * options * math.log2(options)) if options > 1 else 0


def active_loop(options: DataFrame, answers: DataFrame, degree_: int, batch: int, multiplier: float = 2.0, p: float = 0.1, q: float = 0.2, threshold: float | None = None, epochs: int = EPOCHS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(utilities, edges) of the loop replayed over known answers (a, b, probability_a).

    It starts from a regular graph; each round fits, selects up to `batch` of the pairs that are left, asks and adds them, until the target is reached
    or no pair is left.  With a threshold the pairs that were not asked get pseudo-labels from the last fit where it is sure enough, and it fits once more.
    Edges are written to the shared folder each round, so a lost executor costs a reread; of a round the driver sees counts only.
    """
    spark = options.sparkSession
    n = options.count()
    want, have = target_edges(n, multiplier), n * degree_ // 2
    rounds = max(0, -(-(want - have) // batch))

    def kept(df: DataFrame) -> DataFrame:
        path = scratch(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pool = kept(pair_pool(options, 0.0).select("a", "b"))
    edges = kept(answers.join(regular_graph(options, degree_), ["a", "b"], "left_semi"))
    fitted = kept(fit_thurstone(edges, epochs=epochs))
    for _ in range(rounds):
        rest = pool.join(edges, ["a", "b"], "left_anti")
        chosen = kept(active_select(fitted, edges, rest, batch, p, q, seed))
        if chosen.isEmpty():
            break
        edges = kept(edges.unionByName(answers.join(chosen, ["a", "b"], "left_semi")))
        fitted = kept(fit_thurstone(edges, epochs=epochs))
    if threshold is not None:
        edges = kept(edges.unionByName(pseudolabel(fitted, pool.join(edges, ["a", "b"], "left_anti"), threshold).select(*edges.columns)))
        fitted = fit_thurstone(edges, epochs=epochs)
    return fitted, edges
