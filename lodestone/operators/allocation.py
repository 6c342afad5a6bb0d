"""Deterministic sampling, splitting and allocation; every choice follows the SHA-256 of seed and id, the same in every engine."""

from __future__ import annotations

from collections import Counter, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guards import require_empty


def hash_key(seed: int, key: str | Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string")), 256)


def hash_order_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows whose seeded hash is smallest: sample(n) is part of sample(n + 1)."""
    return df.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def hash_rank(df: DataFrame, key: str, seed: int, *strata: str, buckets: int = 256) -> DataFrame:
    """df with `_rank` from 1 in hash order, within strata: counts by the first byte of the hash, then ranks inside each, so no task sees a whole stratum."""
    hashed = df.withColumn("_h", hash_key(seed, key)).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") % buckets)
    counts = hashed.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*(strata or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    own = Window.partitionBy(*strata, "_b").orderBy("_h", key)
    ranked = hashed.withColumn("_r", F.row_number().over(own)).join(before, [*strata, "_b"])
    return ranked.withColumn("_rank", F.col("_r") + F.col("_before")).drop("_h", "_b", "_r", "_before")


def split_train_dev_heldout(df: DataFrame, key: str, heldout: int, dev: int, train: int = 0, seed: int = 42) -> DataFrame:
    """df with `split`: heldout first, then dev, then train (0: all the rest; rows beyond it have null)."""
    rest = F.col("_rank") <= heldout + dev + train if train else F.lit(True)
    split = F.when(F.col("_rank") <= heldout, "heldout").when(F.col("_rank") <= heldout + dev, "dev").when(rest, "train")
    return hash_rank(df, key, seed).withColumn("split", split).drop("_rank")


def largest_remainder(counts: DataFrame, key: str, n: int) -> DataFrame:
    """(key, n, alloc): n places over classes in proportion to their counts; ties by name."""
    whole = Window.partitionBy(F.lit(0))
    quota = counts.withColumn("_q", F.lit(n) * F.col("n") / F.sum("n").over(whole)).withColumn("_f", F.floor("_q"))
    left = F.lit(n) - F.sum("_f").over(whole)
    turn = F.row_number().over(whole.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), key))
    return quota.withColumn("_left", left).withColumn("_turn", turn).select(key, "n", (F.col("_f") + (F.col("_turn") <= F.col("_left")).cast("int")).cast("bigint").alias("alloc"))


def stratified_sample(df: DataFrame, key: str, stratum: str, alloc: DataFrame, seed: int = 42) -> DataFrame:
    """As many rows of each stratum as its allocation says, in hash order."""
    return hash_rank(df, key, seed, stratum).join(F.broadcast(alloc.select(stratum, "alloc")), stratum).filter("_rank <= alloc").drop("_rank", "alloc")


def equal_cells(counts: DataFrame, key: str, want: int) -> DataFrame:
    """(key, n, keep): cells cut from the largest down until `want` rows remain.

    The largest cap with a total of at most `want` holds for all; the remainder goes to the first cells, by key, that have more.  With cells
    in ascending order, the first one that overflows the budget tells the cap: what is left over smaller cells, shared by it and the larger ones.
    """
    whole = Window.partitionBy(F.lit(0)).orderBy("n", key)  # one row a cell
    ordered = counts.withColumn("_s", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_m", F.count("*").over(Window.partitionBy(F.lit(0))) - F.row_number().over(whole) + 1)
    over = F.col("_s") + F.col("n") * F.col("_m") > want
    found = ordered.agg(F.min_by(F.struct(F.floor((want - F.col("_s")) / F.col("_m")).alias("cap"), "_s", "_m"), F.when(over, F.struct("n", key))).alias("x"), F.max("n").alias("most"), F.sum("n").alias("all"))
    best = found.select(F.coalesce("x.cap", "most").alias("cap"), F.coalesce(F.col("x._s") + F.col("x.cap") * F.col("x._m"), "all").alias("t"))
    turn = F.row_number().over(Window.partitionBy(F.col("n") > F.col("cap")).orderBy(key))
    more = (F.col("n") > F.col("cap")) & (F.col("_turn") <= F.lit(want) - F.col("t"))
    return counts.join(F.broadcast(best)).withColumn("_turn", turn).select(key, "n", (F.least("n", "cap") + more.cast("int")).cast("bigint").alias("keep"))


def amend_in_place(cohort: DataFrame, removed: Column, candidates: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(place, key): removed members give their places, in order, to the candidates in hash order; the others keep theirs."""
    kept = cohort.filter(~removed).select("place", key)
    gone = cohort.filter(removed)
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place"))  # the removed are few beside the cohort
    slots = gone.select("place", n.alias("_rank"))
    new = hash_rank(candidates.join(cohort, key, "left_anti"), key, seed).select(key, "_rank")
    return kept.union(slots.join(new, "_rank").select("place", key))


def trim_to_balance(df: DataFrame, cell: str, answer: str, key: str, tolerance: float) -> DataFrame:
    """Rows left after dropping, in each cell, the largest key of the largest answer until every share is within the tolerance of an even one.

    Only counts by answer are looped over; which rows go follows from ranks, so a hot cell is never collected.
    """

    def keep(f: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(f[answer], f["n"], strict=True))
        while n:
            total, k = sum(n.values()), len(n)
            worst = max(sorted(n), key=lambda a: n[a])
            if not total or max(abs(v / total - 1 / k) for v in n.values()) <= tolerance or n[worst] == min(n.values()):
                break
            second = max([v for a, v in n.items() if a != worst], default=0)
            most = max(second, int((1 / k + tolerance) * (total - n[worst]) / (1 - 1 / k - tolerance)) if tolerance < 1 - 1 / k else n[worst])
            n[worst] = min(n[worst] - 1, most)
        return f.assign(keep=[n[a] for a in f[answer]])

    counts = df.groupBy(cell, answer).agg(F.count("*").alias("n"))
    kinds = dict(counts.dtypes)
    kept = counts.groupBy(cell).applyInPandas(keep, f"{cell} {kinds[cell]}, {answer} {kinds[answer]}, n bigint, keep bigint")
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(cell, answer).orderBy(key)))
    return ranked.join(kept, [cell, answer]).filter("_r <= keep").drop("_r", "n", "keep")


def choose_swaps(df: DataFrame, cell: str, key: str) -> DataFrame:
    """(cell, key, flipped): which two-option rows to flip so that first and second places differ by one at most; the surplus side flips its first rows by hash."""
    counts = df.groupBy(cell).agg(F.count_if(F.col("first")).alias("a"), F.count_if(~F.col("first")).alias("b"))
    ranked = hash_rank(df, key, 42, cell, "first")
    surplus = F.when(F.col("first"), F.floor((F.col("a") - F.col("b")) / 2)).otherwise(F.floor((F.col("b") - F.col("a")) / 2))
    return ranked.join(counts, cell).select(cell, key, (F.col("_rank") <= surplus).alias("flipped"))


def greedy_assign(df: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """(family, question, record, cell, slot, turn): `total` different questions, each in one presentation, balanced over slots and cells.

    df: family, question, record (an id of the presentation), cell, slot.  Families share the total by largest remainder of their rows.  In each the next one is the
    presentation whose slot, then whose cell, was taken least, then the question that stands first in hash order, then the smallest record.
    A turn takes one question, so of every (slot, cell) only the first `total` rows can ever be reached: they are picked by rank before anything is
    gathered, and the walk looks at the heads of those lists only.  Cells and slots belong to one family each.  Raises if a family has too few questions.
    """
    share = largest_remainder(df.groupBy("family").agg(F.count("*").alias("n")), "family", total).select("family", "alloc")
    short = df.groupBy("family").agg(F.countDistinct("question").alias("have")).join(share, "family").filter("have < alloc")
    require_empty(short, "families with too few questions")
    keyed = df.withColumn("tie", hash_key(seed, "question"))
    w = Window.partitionBy("family", "slot", "cell").orderBy("tie", "question", "record")
    distinct = keyed.groupBy("family", "slot", "cell", "tie", "question").agg(F.min("record").alias("record"))  # a question's later records of the same slot and cell never come first
    heads = distinct.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= total).drop("_r").join(F.broadcast(share), "family")  # one row a family

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        lists = {k: deque(g[["tie", "question", "record"]].itertuples(index=False, name=None)) for k, g in f.sort_values(["tie", "question", "record"]).groupby(["slot", "cell"], sort=True)}
        slots, cells, taken, out = Counter(), Counter(), set(), []
        for turn in range(int(f["alloc"].iloc[0])):
            for rows in lists.values():
                while rows and rows[0][1] in taken:
                    rows.popleft()
            slot, cell = min((k for k, rows in lists.items() if rows), key=lambda k: (slots[k[0]], cells[k[1]], *lists[k][0]))
            _, question, record = lists[slot, cell].popleft()
            taken.add(question)
            slots[slot] += 1
            cells[cell] += 1
            out.append((f["family"].iloc[0], question, record, cell, slot, turn))
        return pd.DataFrame(out, columns=["family", "question", "record", "cell", "slot", "turn"])

    kinds = dict(df.dtypes)
    return heads.groupBy("family").applyInPandas(walk, ", ".join(f"{c} {kinds[c]}" for c in ("family", "question", "record", "cell", "slot")) + ", turn long")


def quota_batches(df: DataFrame, slot: str, key: str, quota: int, batch: int) -> DataFrame:
    """(slot, key, batch): up to `quota` rows a slot, dealt round-robin over slots into batches of `batch`."""
    turn = F.row_number().over(Window.partitionBy(slot).orderBy(key))
    taken = df.withColumn("_t", turn).filter(F.col("_t") <= quota)
    per_turn = taken.groupBy("_t").agg(F.count("*").alias("_n"))
    before = per_turn.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # at most `quota` rows
    place = F.row_number().over(Window.partitionBy("_t").orderBy(slot)) - 1 + F.col("_before")
    return taken.join(before, "_t").withColumn("batch", F.floor(place / batch).cast("bigint")).select(slot, key, "batch")
