"""Window-style operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators import ranking
from ..tables import derived, load, oracle
from .aggregates import rounded

_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


def _keyed(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_ws("text").cast("binary")).alias("k"), "lang", "n_chars")


@query("dedup_first", oracle(f"SELECT arg_min(doc_id, doc_id) AS doc_id, md5({_NORM}) AS k, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 2"))
def _(spark, sf_dir):
    """The row with the smallest id of each normalised text."""
    return ranking.dedup_first(_keyed(spark, sf_dir), ["k"], "doc_id")


@query("dedup_drop_all", oracle(f"SELECT min(doc_id) AS doc_id, md5({_NORM}) AS k, min(lang) AS lang, min(n_chars) AS n_chars FROM documents GROUP BY 2 HAVING count(*) = 1"))
def _(spark, sf_dir):
    return ranking.dedup_drop_all(_keyed(spark, sf_dir), "k")


@query("dedup_last", oracle("SELECT record_id, arg_max(run_id, pos) AS run_id, max(pos) AS pos, arg_max(elapsed_seconds, pos) AS elapsed_seconds FROM attempts GROUP BY record_id"))
def _(spark, sf_dir):
    return ranking.dedup_last(derived(spark, sf_dir, "attempts").select("record_id", "run_id", "pos", "elapsed_seconds"), ["record_id"], "pos")


@query("latest_complete_group", oracle("WITH g AS (SELECT record_id, run_id, count(*) AS n, max(pos) AS last_pos FROM attempts GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY last_pos DESC) AS r FROM g WHERE n = 20) SELECT record_id, run_id, n FROM m WHERE r = 1"))
def _(spark, sf_dir):
    return ranking.latest_complete_group(derived(spark, sf_dir, "attempts"), "record_id", "run_id", "pos", 20)


@query("author_cap", oracle("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS source FROM documents)) WHERE r <= 3 OR source IS NULL"))
def _(spark, sf_dir):
    """At most three rows a source; rows without one stay."""
    return ranking.cap_per_key(load(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 <> 0 THEN source END AS source"), "source", 3, "doc_id")


@query("group_advantage", oracle("WITH g AS (SELECT record_id, reward_call, avg(reward) AS m, max(reward) = min(reward) AS flat, count(reward) AS n FROM rollouts GROUP BY 1, 2) SELECT record_id, reward_call, pos, text, round(reward - m, 6) + 0 AS advantage, flat FROM rollouts JOIN g USING (record_id, reward_call) WHERE reward IS NOT NULL"))
def _(spark, sf_dir):
    w = Window.partitionBy("record_id", "reward_call")
    r = derived(spark, sf_dir, "rollouts").withColumn("advantage", F.col("reward") - F.avg("reward").over(w)).withColumn("flat", F.max("reward").over(w) == F.min("reward").over(w))
    return rounded(r.filter("reward IS NOT NULL").select("record_id", "reward_call", "pos", "text", "advantage", "flat"))


@query("round_robin", oracle("SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50"))
def _(spark, sf_dir):
    return ranking.round_robin(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", 50, "doc_id").withColumn("turn", F.col("turn").cast("bigint"))


@query("stage_slices", oracle("SELECT doc_id, CASE WHEN r <= (n + 2) // 3 THEN 0 WHEN r <= (n + 2) // 3 + (n + 1) // 3 THEN 1 ELSE 2 END AS stage FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)"))
def _(spark, sf_dir):
    """Contiguous slices of the ordered cohort; the first stages take the remainder."""
    docs = load(spark, sf_dir, "documents").select("doc_id")
    sizes = ranking.step_split(docs.count(), 3)
    return ranking.ranked(docs, "doc_id").select("doc_id", F.when(F.col("_rank") <= sizes[0], 0).when(F.col("_rank") <= sizes[0] + sizes[1], 1).otherwise(2).alias("stage"))


@query("prefix_n", oracle("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100"))
def _(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(100)


@query("half_trend", oracle("WITH l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), t AS (SELECT user_id, value, ntile(2) OVER (PARTITION BY user_id ORDER BY r DESC) AS half FROM l WHERE r <= 40) SELECT user_id, round(avg(value) FILTER (half = 1), 6) AS first_half, round(avg(value) FILTER (half = 2), 6) AS last_half FROM t GROUP BY user_id"))
def _(spark, sf_dir):
    recent = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    t = load(spark, sf_dir, "events").withColumn("r", F.row_number().over(recent)).filter("r <= 40").withColumn("half", F.ntile(2).over(Window.partitionBy("user_id").orderBy(F.desc("r"))))
    side = lambda k: F.avg(F.when(F.col("half") == k, F.col("value")))
    return rounded(t.groupBy("user_id").agg(side(1).alias("first_half"), side(2).alias("last_half")))


@query("run_phase", oracle("WITH last AS (SELECT arg_max(run_id, pos) AS run_id FROM attempts) SELECT run_id, count(*) AS n, round((epoch(max(started_at)) - epoch(min(started_at))) / 60, 4) AS minutes, round(count(*) / ((epoch(max(started_at)) - epoch(min(started_at))) / 60), 6) AS per_minute FROM attempts JOIN last USING (run_id) GROUP BY run_id"))
def _(spark, sf_dir):
    log = derived(spark, sf_dir, "attempts")
    mine = log.join(F.broadcast(log.agg(F.max_by("run_id", "pos").alias("run_id"))), "run_id")
    at = lambda f: F.unix_micros(f("started_at").cast("timestamp"))
    g = mine.groupBy("run_id").agg(F.count("*").alias("n"), ((at(F.max) - at(F.min)) / 6e7).alias("minutes"))
    return g.select("run_id", "n", F.round("minutes", 4).alias("minutes"), F.round(F.col("n") / F.col("minutes"), 6).alias("per_minute"))


@query("min_perm_rank", oracle("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY abs(n_chars - 1500) DESC, doc_id) AS r FROM documents) WHERE r <= 3"))
def _(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.abs(F.col("n_chars") - 1500).alias("off"))
    w = Window.partitionBy("source").orderBy(F.desc("off"), "doc_id")
    return d.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("doc_id", "source")
