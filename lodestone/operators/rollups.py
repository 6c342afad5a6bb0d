"""Evaluation, reward and run-log aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import pass_at_k as pass_at_k_of
from ..functions.maths import safe_rate


def rate(cond: Column) -> Column:
    """Share of rows that hold among those with a value."""
    return F.avg(cond.cast("double"))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, share)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def pass_at_k(graded: DataFrame, ks: Sequence[int], *keys: str) -> DataFrame:
    """(keys, k, pass_at_k) over rows (n, c); only for those k that every row of a group can bear."""
    arms = F.array(*(F.struct(F.lit(k).alias("k"), pass_at_k_of("n", "c", k).alias("p")) for k in ks))
    out = graded.select(*keys, "n", F.explode(arms).alias("x")).groupBy(*keys, "x.k").agg(F.avg("x.p").alias("pass_at_k"), F.min("n").alias("least"))
    return out.filter(F.col("least") >= F.col("k")).drop("least")


def mean_by_sets(df: DataFrame, value: Column, sets: Sequence[str]) -> DataFrame:
    """(level, key, n, mean): overall and by each column alone, in one pass."""
    arms = F.array(F.struct(F.lit("overall").alias("level"), F.lit("all").alias("key")), *(F.struct(F.lit(s).alias("level"), F.col(s).cast("string").alias("key")) for s in sets))
    return df.select(F.explode(arms).alias("x"), value.alias("v")).groupBy("x.level", "x.key").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def order_statistic(df: DataFrame, value: str, places: dict[str, str], *keys: str) -> DataFrame:
    """Values at 0-based places of the ascending order, given as expressions in n."""
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    ranked = df.select(*keys, F.col(value).alias("_v")).withColumn("_r", F.row_number().over(own.orderBy("_v")) - 1).withColumn("n", F.count("*").over(own))
    pick = lambda e: F.max(F.when(F.col("_r") == F.expr(e), F.col("_v")))
    return ranked.groupBy(*keys).agg(*(pick(e).alias(k) for k, e in places.items()))


def counted_statistic(df: DataFrame, value: str, places: dict[str, str], *keys: str) -> DataFrame:
    """order_statistic by way of counts of each value: a window over distinct values instead of over all rows."""
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = own.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_to", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(own))
    pick = lambda e: F.max(F.when((F.expr(e) >= F.col("_to") - F.col("_c")) & (F.expr(e) < F.col("_to")), F.col("_v")))
    return ranked.groupBy(*keys).agg(*(pick(e).alias(k) for k, e in places.items()))


def best_worst(rollouts: DataFrame, key: str) -> DataFrame:
    """Best and worst scored text of a group by (reward, text), with counts and margin; truncated ones (null reward) can be neither."""
    scored = F.when(F.col("reward").isNotNull(), F.struct("reward", "text"))
    out = rollouts.groupBy(key).agg(F.count("*").alias("n_candidates"), F.count("reward").alias("n_gradable"), F.count_if(F.col("reward").isNull()).alias("n_truncated"), F.count_if(F.trim("text") == "").alias("n_empty"), F.max(scored).alias("best"), F.min(scored).alias("worst"))
    return out.select(key, "n_candidates", "n_gradable", "n_truncated", "n_empty", F.col("best.text").alias("chosen"), F.col("worst.text").alias("rejected"), F.col("best.reward").alias("chosen_reward"), F.col("worst.reward").alias("rejected_reward"), (F.col("best.reward") - F.col("worst.reward")).alias("margin"))


def summary_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, sample deviation (0 of one), standard error, least and most."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(value))).alias("se"), F.min(value).alias("low"), F.max(value).alias("high"))


def paired_deltas(scores: DataFrame, item: str, arm: str, value: str, baseline: str, candidate: str) -> DataFrame:
    """(item, delta) of the items that both arms have a value for."""
    of = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value)))
    return scores.groupBy(item).agg((of(candidate) - of(baseline)).alias("delta")).filter("delta IS NOT NULL")


#: Fixed value: resamples of a paired bootstrap.
DRAWS = 10_000
MOST_BROADCAST = 1_000_000


def paired_bootstrap(deltas: DataFrame, item: str, draws: int = DRAWS) -> DataFrame:
    """(n_paired, mean_delta, low, high): mean of the deltas and the places 0.025 and 0.975 of the ascending means of resamples; no row for fewer than two.

    The j-th pick of a draw is the item at place hash(draw, j) mod n in order of items, so every engine draws alike.  Draws are made where they lie and
    averaged map-side; up to a million deltas travel to them, more meet them in a hash join.
    """
    from .ranking import ranked_by_hash

    placed = ranked_by_hash(deltas.select(F.col(item).alias("_i"), F.col("delta").cast("double").alias("delta")), "_i").select((F.col("_rank") - 1).alias("_p"), "delta")
    facts = deltas.agg(F.count("*").alias("n_paired"), F.avg("delta").alias("mean_delta"))
    n = facts.first()["n_paired"]
    spark = deltas.sparkSession
    if n < 2:
        return spark.createDataFrame([], "n_paired bigint, mean_delta double, low double, high double")
    grid = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    drawn = grid.select("draw", (F.conv(F.substring(F.sha2(F.concat_ws(":", "draw", "j"), 256), 1, 8), 16, 10).cast("bigint") % n).alias("_p"))
    means = drawn.join(F.broadcast(placed) if n <= MOST_BROADCAST else placed, "_p").groupBy("draw").agg(F.avg("delta").alias("m"))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m")) - 1  # one row a draw
    pick = lambda k: F.max(F.when(F.col("r") == k, F.col("m")))
    ends = means.withColumn("r", turn).agg(pick(int(0.025 * draws)).alias("low"), pick(int(0.975 * draws)).alias("high"))
    return facts.join(F.broadcast(ends))


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns; null of fewer than two rows and where one doesn't vary."""
    varies = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(varies, F.corr(x, y))


def zscores(df: DataFrame, value: str, name: str = "z", eps: float = 1e-5) -> DataFrame:
    """df with the value in sample deviations from the mean of all rows."""
    facts = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(F.broadcast(facts)).withColumn(name, (F.col(value) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")
