"""Sorting, sampling, splitting and allocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.maths import even_indices
from ..operators import allocation as al
from ..operators import ranking
from ..tables import derived, load, oracle
from .aggregates import rounded

HASH = "sha256('42:' || {})"


@query("sort_utility", oracle("SELECT id, mean, variance FROM utilities ORDER BY mean DESC, id"))
def _(spark, sf_dir):
    return rounded(derived(spark, sf_dir, "utilities")).orderBy(F.desc("mean"), "id")


@query("topk_abs", oracle("SELECT id, round(mean - 0.948, 6) AS delta FROM utilities ORDER BY abs(round(mean - 0.948, 6)) DESC, id LIMIT 5"))
def _(spark, sf_dir):
    d = rounded(derived(spark, sf_dir, "utilities").select("id", (F.col("mean") - 0.948).alias("delta")))
    return d.orderBy(F.desc(F.abs("delta")), "id").limit(5)


@query("longer_short_pick", oracle("SELECT source, arg_min(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY source"))
def _(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"))


@query("hash_order_sample", oracle(f"SELECT doc_id FROM documents ORDER BY {HASH.format('doc_id')} LIMIT 200"))
def _(spark, sf_dir):
    return al.hash_order_sample(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200)


@query("amend_in_place", oracle(f"""WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE lang = 'fr'), g AS (SELECT place, row_number() OVER (ORDER BY place) AS r FROM c JOIN documents USING (doc_id) WHERE n_chars < 1000),
n AS (SELECT doc_id, row_number() OVER (ORDER BY {HASH.format('doc_id')}) AS r FROM documents WHERE lang = 'en') SELECT place, doc_id FROM c JOIN documents USING (doc_id) WHERE n_chars >= 1000 UNION ALL SELECT place, doc_id FROM g JOIN n USING (r)"""))
def _(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    cohort = ranking.ranked(docs.filter("lang = 'fr'").select("doc_id", "n_chars"), "doc_id").withColumnRenamed("_rank", "place")
    return al.amend_in_place(cohort, F.col("n_chars") < 1000, docs.filter("lang = 'en'").select("doc_id"), "doc_id").select("place", "doc_id")


@query("seed_sample", oracle(f"SELECT o_orderkey AS id FROM orders ORDER BY sha256('7:' || o_orderkey) LIMIT 100"))
def _(spark, sf_dir):
    return al.hash_order_sample(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 100, seed=7)


@query("split_train_dev_heldout", oracle(f"SELECT doc_id, CASE WHEN r <= 100 THEN 'heldout' WHEN r <= 150 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {HASH.format('doc_id')}) AS r FROM documents)"))
def _(spark, sf_dir):
    return al.split_train_dev_heldout(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 50)


@query("split_fraction", oracle(f"SELECT doc_id, r <= greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS is_eval FROM (SELECT doc_id, row_number() OVER (ORDER BY {HASH.format('doc_id')}) AS r, count(*) OVER () AS n FROM documents)"))
def _(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id")
    n_eval = max(1, round(docs.count() * 0.1))
    return al.hash_rank(docs, "doc_id", 42).select("doc_id", (F.col("_rank") <= n_eval).alias("is_eval"))


_ALLOC = "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, n, 100 * n / sum(n) OVER () AS q FROM c), f AS (SELECT *, floor(q) AS f, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, lang) AS t, 100 - sum(floor(q)) OVER () AS rest FROM q), a AS (SELECT lang, n, CAST(f + (t <= rest)::INT AS BIGINT) AS alloc FROM f) "


def _alloc(spark, sf_dir):
    return al.largest_remainder(load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", 100)


@query("largest_remainder", oracle(_ALLOC + "SELECT lang, n, alloc FROM a"))
def _(spark, sf_dir):
    return _alloc(spark, sf_dir)


@query("stratified_sample", oracle(_ALLOC + f", r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH.format('doc_id')}) AS r FROM documents) SELECT doc_id, r.lang FROM r JOIN a ON r.lang = a.lang WHERE r <= alloc"))
def _(spark, sf_dir):
    return al.stratified_sample(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", _alloc(spark, sf_dir)).select("doc_id", "lang")


@query("stratified_splits", oracle(f"SELECT doc_id, lang, CASE WHEN r <= n // 10 THEN 'heldout' WHEN r <= n // 10 + n // 20 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH.format('doc_id')}) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)"))
def _(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    r = al.hash_rank(docs, "doc_id", 42, "lang").join(F.broadcast(sizes), "lang")
    held, dev = F.floor(F.col("n") / 10), F.floor(F.col("n") / 20)
    return r.select("doc_id", "lang", F.when(F.col("_rank") <= held, "heldout").when(F.col("_rank") <= held + dev, "dev").otherwise("train").alias("split"))


_CELLS = "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), caps AS (SELECT unnest(generate_series(0, (SELECT max(n) FROM c))) AS cap), t AS (SELECT cap, sum(least(n, cap)) AS t FROM caps, c GROUP BY cap), b AS (SELECT max(cap) AS cap, max(t) AS t FROM t WHERE t <= 300) "


@query("equal_cells_trim", oracle(_CELLS + "SELECT source, n, CAST(least(n, cap) + (n > cap AND row_number() OVER (PARTITION BY n > cap ORDER BY source) <= 300 - t)::INT AS BIGINT) AS keep FROM c, b"))
def _(spark, sf_dir):
    return al.equal_cells(load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", 300)


@query("ternary_deal", oracle("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) + length(lang)) % 3 AS presentation FROM documents"))
def _(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return load(spark, sf_dir, "documents").select("doc_id", "lang", ((n + F.length("lang")) % 3).cast("bigint").alias("presentation"))


_SIDES = "SELECT doc_id, lang, doc_id % 3 <> 0 AS first FROM documents"
_FLIPS = f"WITH d AS ({_SIDES}), c AS (SELECT lang, count(*) FILTER (first) AS a, count(*) FILTER (NOT first) AS b FROM d GROUP BY lang), r AS (SELECT *, row_number() OVER (PARTITION BY lang, first ORDER BY {HASH.format('doc_id')}) AS r FROM d) SELECT r.lang, doc_id, r <= CASE WHEN first THEN floor((a - b) / 2) ELSE floor((b - a) / 2) END AS flipped FROM r JOIN c ON r.lang = c.lang"


@query("label_rebalance", oracle(f"SELECT lang, count(*) FILTER (flipped) AS flips FROM ({_FLIPS}) GROUP BY lang"))
def _(spark, sf_dir):
    return al.choose_swaps(load(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "doc_id % 3 <> 0 AS first"), "lang", "doc_id").groupBy("lang").agg(F.count_if("flipped").alias("flips"))


@query("choose_swaps", oracle(_FLIPS))
def _(spark, sf_dir):
    return al.choose_swaps(load(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "doc_id % 3 <> 0 AS first"), "lang", "doc_id")


@query("greedy_assign")
def _(spark, sf_dir):
    """200 questions in one of two presentations each, balanced over answers; sequential, so beyond SQL: a test holds it against the plain walk."""
    p = load(spark, sf_dir, "part").select(F.substring("p_brand", 1, 7).alias("family"), F.col("p_partkey").alias("question"), (F.col("p_size") % 3).alias("_a"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"))
    cell = F.concat_ws("|", "family", "_side")
    return al.greedy_assign(p.select("family", "question", (F.col("question") * 2 + F.col("_side")).alias("record"), cell.alias("cell"), F.concat_ws("|", cell, "_a").alias("slot")), 200)


@query("trim_to_balance")
def _(spark, sf_dir):
    """A data-dependent loop over counts of each cell: rows only."""
    return al.trim_to_balance(derived(spark, sf_dir, "forecasts").filter("label IS NOT NULL").select("event_id", "rotation", "label"), "rotation", "label", "event_id", 0.02)


@query("quota_batches", oracle("WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS t FROM documents), p AS (SELECT *, row_number() OVER (ORDER BY t, source) - 1 AS place FROM t WHERE t <= 10) SELECT source, doc_id, place // 16 AS batch FROM p"))
def _(spark, sf_dir):
    return al.quota_batches(load(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 10, 16)


@query("quota_floor", oracle("SELECT source, count(*) AS n, greatest(0, 60 - count(*)) AS needed FROM documents GROUP BY source HAVING count(*) < 60"))
def _(spark, sf_dir):
    g = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.filter("n < 60").withColumn("needed", F.greatest(F.lit(0).cast("bigint"), 60 - F.col("n")))


@query("even_subsample", oracle("SELECT problem, CASE WHEN n <= 4 THEN array_to_string(range(0, n), ',') ELSE array_to_string(list_transform(range(0, 4), lambda i: CAST(round_even(i::DOUBLE * (n - 1) / 3, 0) AS INT)), ',') END AS places FROM graded"))
def _(spark, sf_dir):
    g = derived(spark, sf_dir, "graded")
    return g.select("problem", F.array_join(F.transform(even_indices("n", 4), lambda x: x.cast("string")), ",").alias("places"))


@query("step_split", "SELECT lang, CAST(s AS BIGINT) AS stage, CAST(n // 7 + (s < n % 7)::INT AS BIGINT) AS steps FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang), generate_series(0, 6) g(s)")
def _(spark, sf_dir):
    """The rows of each language over seven stages."""
    counts = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", F.posexplode(ranking.stage_sizes("n", 7)).alias("stage", "steps")).withColumn("stage", F.col("stage").cast("bigint"))


@query("fact_pairs_balanced", oracle("""WITH p AS (SELECT x.id AS a, y.id AS b, length(CAST(x.id AS VARCHAR)) > length(CAST(y.id AS VARCHAR)) AS longer FROM utilities x JOIN utilities y ON x.mean >= y.mean + 0.001), r AS (SELECT *, row_number() OVER (PARTITION BY longer ORDER BY a, b) - 1 AS k, count(*) OVER (PARTITION BY longer) AS n FROM p), m AS (SELECT min(n) AS m FROM r)
SELECT a, b, longer FROM r, m WHERE n = m OR (k * m) // n <> ((k - 1) * m) // n OR k = 0"""))
def _(spark, sf_dir):
    """Unambiguous pairs; the larger of the two length classes is thinned by an even stride to the size of the smaller."""
    u = derived(spark, sf_dir, "utilities").select("id", "mean")
    x, y = u.toDF("a", "ma"), u.toDF("b", "mb")
    longer = F.length(F.col("a").cast("string")) > F.length(F.col("b").cast("string"))
    p = x.join(y, F.col("ma") >= F.col("mb") + 0.001).select("a", "b", longer.alias("longer"))
    w = Window.partitionBy("longer")
    r = p.withColumn("k", (F.row_number().over(w.orderBy("a", "b")) - 1).cast("bigint")).withColumn("n", F.count("*").over(w))
    m = p.groupBy("longer").agg(F.count("*").alias("n")).agg(F.min("n").alias("m"))
    step = lambda k: F.floor(k * F.col("m") / F.col("n"))
    return r.join(F.broadcast(m)).filter((F.col("n") == F.col("m")) | (step(F.col("k")) != step(F.col("k") - 1)) | (F.col("k") == 0)).select("a", "b", "longer")


@query("closest_to_target", oracle("SELECT record_id, arg_min(pos, (abs(output_tokens - 150), pos)) AS pos, min(abs(output_tokens - 150)) AS off FROM attempts WHERE NOT api_error GROUP BY record_id"))
def _(spark, sf_dir):
    off = F.abs(F.col("output_tokens") - 150)
    return derived(spark, sf_dir, "attempts").filter("NOT api_error").groupBy("record_id").agg(F.min_by("pos", F.struct(off, "pos")).alias("pos"), F.min(off).alias("off"))


@query("subset_preferred", oracle("SELECT doc_id, source, preferred FROM (SELECT doc_id, source, doc_id % 97 = 0 AS preferred, row_number() OVER (PARTITION BY doc_id % 97 = 0, source ORDER BY doc_id) AS t FROM documents) ORDER BY preferred DESC, t, source, doc_id LIMIT 60"))
def _(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 97 == 0).alias("preferred"))
    w = Window.partitionBy("preferred", "source").orderBy("doc_id")
    return d.withColumn("t", F.row_number().over(w)).filter("t <= 60").orderBy(F.desc("preferred"), "t", "source", "doc_id").limit(60).drop("t")
