"""Window operators: de-duplication policies, caps, round-robin, slices, phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key in the order of columns (null order values last), aggregated map-side, so no window over a hot key."""
    return _picked(df, keys, F.min_by, *order)


def _picked(df: DataFrame, keys: Sequence[str], pick, *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c))))
    best = df.groupBy(*keys).agg(pick(F.struct(*rest) if rest else F.lit(0), by).alias("_x"))
    return best.select(*keys, *(F.col("_x")[c].alias(c) for c in rest)).select(*df.columns)


def dedup_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write wins; aggregated map-side, so no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_x"))
    return best.select(*keys, "_x.*").select(*df.columns)


def dedup_drop_all(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key no other row has: an aggregate carries one row of each key and its count."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.any_value(F.struct(*rest) if rest else F.lit(0)).alias("_x"), F.count("*").alias("_n")).filter("_n = 1")
    return one.select(*keys, *(F.col("_x")[c].alias(c) for c in rest)).select(*df.columns)


def latest_complete_group(df: DataFrame, key: str, call: str, pos: str, size: int) -> DataFrame:
    """(key, call, n): of a key's groups with exactly `size` rows the one appended last."""
    groups = df.groupBy(key, call).agg(F.count("*").alias("n"), F.max(pos).alias("_at")).filter(F.col("n") == size)
    return groups.groupBy(key).agg(F.max(F.struct("_at", call, "n")).alias("_x")).select(key, f"_x.{call}", "_x.n")


def cap_per_key(df: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """The first `most` rows of each key; rows without a key stay and never meet in a window.

    The filter on the rank is one that Spark applies before the shuffle too (WindowGroupLimit), so a hot key sends `most` rows a task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    capped = df.filter(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
    return capped.union(df.filter(F.col(key).isNull()))


def round_robin(df: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """n rows, one of each group in turn, in order of groups."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n).orderBy("turn", group).limit(n)


def ranked(df: DataFrame, *order: str | Column, buckets: int = 64) -> DataFrame:
    """df with `_rank` from 1 in a total order, without a window over all rows: counts by range of the first key, then ranks inside each range.

    The first order key is cut into `buckets` ranges at its approximate quantiles; equal keys share a range.
    """
    first = order[0]
    if not isinstance(first, str):
        raise TypeError("the first order key must be a column name")
    cuts = sorted(set(df.approxQuantile(first, [i / buckets for i in range(1, buckets)], 0.01)))
    part = df.withColumn("_b", F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)) if cuts else F.array().cast("array<double>"), lambda c: F.col(first) > c)))
    counts = part.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # at most `buckets` rows
    own = Window.partitionBy("_b").orderBy(*order)
    return part.withColumn("_r", F.row_number().over(own)).join(F.broadcast(before), "_b").withColumn("_rank", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")


def ranked_by_hash(df: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """df with `_rank` from 1 in order of the key's SHA-256 (then of the key), without a window over all rows."""
    from .allocation import hash_rank

    return hash_rank(df, key, 0, buckets=buckets)


def step_split(total: int, stages: int) -> list[int]:
    """Sizes of stages; the first ones take the remainder."""
    size, more = divmod(total, stages)
    return [size + (k < more) for k in range(stages)]


def stage_sizes(total: Column | str, stages: int) -> Column:
    """step_split of a column, as an array."""
    n = (F.col(total) if isinstance(total, str) else total).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(stages - 1)), lambda k: F.floor(n / stages) + (k < n % stages).cast("bigint"))
