"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import guards
from ..operators.matching import linked_in_group, snippet_overlap
from ..tables import derived, load, oracle
from .aggregates import rounded

SCORES = "(SELECT record_id, max(reward) AS best, min(reward) AS least FROM rollouts WHERE reward IS NOT NULL GROUP BY record_id)"


def scores(spark, sf_dir):
    return derived(spark, sf_dir, "rollouts").filter("reward IS NOT NULL").groupBy("record_id").agg(F.max("reward").alias("best"), F.min("reward").alias("least"))


@query("join_scores", oracle(f"SELECT o_orderstatus AS status, count(*) AS n, count(best) AS matched, count(*) - count(best) AS unmatched, round(avg(best), 6) AS mean_best FROM orders LEFT JOIN {SCORES} ON o_orderkey = record_id GROUP BY 1"))
def _(spark, sf_dir):
    j = load(spark, sf_dir, "orders").join(scores(spark, sf_dir), F.col("o_orderkey") == F.col("record_id"), "left")
    return rounded(j.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count("best").alias("matched"), F.count_if(F.col("best").isNull()).alias("unmatched"), F.avg("best").alias("mean_best")))


@query("join_heldout", oracle("SELECT record_id, o_orderpriority AS difficulty, count(*) AS n FROM rollouts JOIN orders ON record_id = o_orderkey GROUP BY 1, 2"))
def _(spark, sf_dir):
    gens, held = derived(spark, sf_dir, "rollouts"), load(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "record_id")
    guards.require_empty(guards.missing(gens, held, "record_id"), "generations without a held-out row")
    return gens.join(held, "record_id").groupBy("record_id", F.col("o_orderpriority").alias("difficulty")).agg(F.count("*").alias("n"))


@query("join_paired", oracle("WITH m AS (SELECT item, arm, avg(reward) AS r FROM arms GROUP BY item, arm) SELECT item, round(b.r, 6) AS base_reward, round(c.r, 6) AS arm_reward, round(c.r - b.r, 6) + 0 AS delta FROM (SELECT * FROM m WHERE arm = 'base') b JOIN (SELECT * FROM m WHERE arm = 'arm') c USING (item)"))
def _(spark, sf_dir):
    m = derived(spark, sf_dir, "arms").groupBy("item", "arm").agg(F.avg("reward").alias("r"))
    side = lambda a: m.filter(F.col("arm") == a).select("item", F.col("r").alias(f"{a}_reward"))
    return rounded(side("base").join(side("arm"), "item").withColumn("delta", F.col("arm_reward") - F.col("base_reward")))


@query("join_traces_source", oracle("SELECT l_linestatus AS status, count(*) AS n, count(p_partkey) AS found, count(DISTINCT p_brand) AS brands FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY 1"))
def _(spark, sf_dir):
    j = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").filter("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy(F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.count("p_partkey").alias("found"), F.countDistinct("p_brand").alias("brands"))


_ACTIONS = "SELECT c_custkey AS idx, 'first' AS choice, c_mktsegment AS action FROM customer UNION ALL SELECT c_custkey, 'second', c_name FROM customer"


@query("join_choice_action", oracle(f"SELECT action, count(*) AS n FROM choices JOIN ({_ACTIONS}) USING (idx, choice) GROUP BY action"))
def _(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    pick = F.explode(F.array(F.struct(F.lit("first").alias("choice"), F.col("c_mktsegment").alias("action")), F.struct(F.lit("second").alias("choice"), F.col("c_name").alias("action"))))
    actions = c.select(F.col("c_custkey").alias("idx"), pick.alias("x")).select("idx", "x.*")
    return derived(spark, sf_dir, "choices").join(actions, ["idx", "choice"]).groupBy("action").agg(F.count("*").alias("n"))


@query("join_variants", oracle("WITH u AS (SELECT p_type AS description, p_size % 2 AS variant, avg(p_retailprice) AS mean FROM part GROUP BY 1, 2) SELECT count(*) AS shared, round(corr(x.mean, y.mean), 6) AS correlation FROM u x JOIN u y USING (description) WHERE x.variant = 0 AND y.variant = 1"))
def _(spark, sf_dir):
    u = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("description"), (F.col("p_size") % 2).alias("variant")).agg(F.avg("p_retailprice").alias("mean"))
    side = lambda v, n: u.filter(F.col("variant") == v).select("description", F.col("mean").alias(n))
    return rounded(side(0, "x").join(side(1, "y"), "description").agg(F.count("*").alias("shared"), F.corr("x", "y").alias("correlation")))


@query("join_values_taxonomy", oracle("SELECT r_name AS taxonomy, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"))
def _(spark, sf_dir):
    dim = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(spark, sf_dir, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("taxonomy")).agg(F.count("*").alias("n"))


@query("join_target_items", oracle("WITH bridge AS (SELECT id AS target, id AS item FROM utilities UNION SELECT id, (id + 1) % 25 FROM utilities WHERE id % 3 = 0) SELECT target, count(*) AS items, round(avg(mean), 6) AS mean FROM bridge JOIN utilities ON item = id GROUP BY target"))
def _(spark, sf_dir):
    u = derived(spark, sf_dir, "utilities")
    items = F.when(F.col("id") % 3 == 0, F.array(F.col("id"), (F.col("id") + 1) % 25)).otherwise(F.array("id"))
    bridge = u.select(F.col("id").alias("target"), F.explode(F.array_distinct(items)).alias("id"))
    return rounded(bridge.join(u, "id").groupBy("target").agg(F.count("*").alias("items"), F.avg("mean").alias("mean")))


@query("semi_split", oracle("SELECT CASE WHEN o_orderkey IS NULL THEN 'not_in_split' ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'validation' ELSE 'train' END END AS split, count(*) AS n FROM (SELECT DISTINCT problem FROM samples) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') ON problem = o_orderkey GROUP BY 1"))
def _(spark, sf_dir):
    split = load(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("problem"), F.when(F.col("o_orderkey") % 10 == 0, "validation").otherwise("train").alias("split"))
    j = derived(spark, sf_dir, "samples").select("problem").distinct().join(split, "problem", "left")
    return j.groupBy(F.coalesce("split", F.lit("not_in_split")).alias("split")).agg(F.count("*").alias("n"))


@query("semi_selected", oracle("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY doc_id"))
def _(spark, sf_dir):
    chosen = load(spark, sf_dir, "labels").filter("quality = 1")
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(chosen, "doc_id", "left_semi").orderBy("doc_id")


@query("anti_done", oracle("SELECT o_orderkey AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"))
def _(spark, sf_dir):
    done = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("problem"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("problem")).join(done, "problem", "left_anti")


@query("anti_train", oracle("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def _(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("anti_outside", oracle("SELECT count(*) AS outside FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40))"))
def _(spark, sf_dir):
    inside = load(spark, sf_dir, "part").filter("p_size <= 40").withColumnRenamed("p_partkey", "l_partkey")
    return guards.missing(load(spark, sf_dir, "lineitem"), inside, "l_partkey").agg(F.count("*").alias("outside"))


@query("anti_reserved", oracle("SELECT o_orderkey AS record_id, list_sort(list_filter([CASE WHEN o_orderkey % 10 = 0 THEN 'reserved_split' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'known_bad' END, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'excluded' END], lambda x: x IS NOT NULL)) AS reasons FROM orders").replace("SELECT o_orderkey AS record_id, list_sort", "SELECT record_id, array_to_string(reasons, ',') AS reasons FROM (SELECT o_orderkey AS record_id, list_sort") + ") WHERE len(reasons) > 0")
def _(spark, sf_dir):
    reserved = load(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("_bad"))
    j = load(spark, sf_dir, "orders").join(reserved, "o_custkey", "left")
    why = guards.reasons(("reserved_split", F.col("o_orderkey") % 10 == 0), ("known_bad", F.col("o_orderpriority") == "1-URGENT"), ("excluded", F.col("_bad").isNotNull()))
    return j.select(F.col("o_orderkey").alias("record_id"), F.array_sort(why).alias("r")).filter(F.size("r") > 0).select("record_id", F.array_join("r", ",").alias("reasons"))


@query("mark_contam", oracle("SELECT problem, problem IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') AS in_training FROM (SELECT DISTINCT problem FROM samples)"))
def _(spark, sf_dir):
    pool = load(spark, sf_dir, "orders").filter("o_orderdate < TIMESTAMP '1996-01-01'").select(F.col("o_orderkey").alias("problem"), F.lit(True).alias("_in"))
    return derived(spark, sf_dir, "samples").select("problem").distinct().join(pool, "problem", "left").select("problem", F.col("_in").isNotNull().alias("in_training"))


@query("cross_pairs", oracle("SELECT x.id AS a, y.id AS b FROM utilities x JOIN utilities y ON x.id < y.id"))
def _(spark, sf_dir):
    u = derived(spark, sf_dir, "utilities").select("id")
    return u.select(F.col("id").alias("a")).join(u.select(F.col("id").alias("b")), F.col("a") < F.col("b"))


@query("cross_adapter_pairs", oracle("WITH v AS (SELECT DISTINCT run_id FROM attempts) SELECT x.run_id AS left_run, y.run_id AS right_run FROM v x JOIN v y ON x.run_id < y.run_id"))
def _(spark, sf_dir):
    v = derived(spark, sf_dir, "attempts").select("run_id").distinct()
    return v.select(F.col("run_id").alias("left_run")).join(v.select(F.col("run_id").alias("right_run")), F.col("left_run") < F.col("right_run"))


@query("cross_variant_grid", oracle("SELECT r_name AS family, mode, rotation FROM region, (VALUES ('plain'), ('reasoning')) m(mode), generate_series(0, 2) g(rotation)"))
def _(spark, sf_dir):
    """Small dimensions multiply in a projection, without a join."""
    r = load(spark, sf_dir, "region").select(F.col("r_name").alias("family"), F.explode(F.array(F.lit("plain"), F.lit("reasoning"))).alias("mode"))
    return r.withColumn("rotation", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))


_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_SNIPPETS = f"SELECT item_id, {_NORM.format('text')} AS snippet FROM benchmark WHERE length({_NORM.format('text')}) >= 25"


@query("theta_contains", oracle(f"SELECT doc_id, item_id FROM documents, ({_SNIPPETS}) s WHERE contains({_NORM.format('documents.text')}, snippet)"))
def _(spark, sf_dir):
    return snippet_overlap(load(spark, sf_dir, "documents"), "doc_id", load(spark, sf_dir, "benchmark"), "item_id")


@query("theta_similarity")
def _(spark, sf_dir):
    """For each document its class of equal texts in its language, and how many other classes there have a matching ratio of 0.7 or more; the ratio is beyond SQL."""
    return linked_in_group(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "text"), 0.7).select("id", "class_id", "n_links")


@query("set_intersect_all", oracle("SELECT item FROM arms GROUP BY item HAVING count(DISTINCT arm) = 2"))
def _(spark, sf_dir):
    return derived(spark, sf_dir, "arms").groupBy("item").agg(F.countDistinct("arm").alias("n")).filter("n = 2").select("item")


@query("assert_equal_across", oracle("SELECT item, min(finished::INT)::BOOLEAN AS low, max(finished::INT)::BOOLEAN AS high FROM arms GROUP BY item HAVING min(finished::INT) <> max(finished::INT)"))
def _(spark, sf_dir):
    return guards.differing(derived(spark, sf_dir, "arms"), "item", "finished")


@query("join_dilemma_model", oracle("SELECT idx, ord, choice, c_mktsegment AS action FROM (SELECT idx, ord, arg_min(choice, pos) AS choice FROM choices GROUP BY idx, ord) LEFT JOIN customer ON idx = c_custkey"))
def _(spark, sf_dir):
    first = derived(spark, sf_dir, "choices").groupBy("idx", "ord").agg(F.min_by("choice", "pos").alias("choice"))
    actions = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("action"))
    return first.join(actions, "idx", "left").select("idx", "ord", "choice", "action")


@query("accepted_membership", oracle("SELECT record_id, CASE WHEN o_orderkey IS NULL THEN 'outside' WHEN n > 1 THEN 'duplicate' WHEN o_orderstatus <> 'F' THEN 'mismatch' ELSE 'ok' END AS verdict FROM (SELECT l_orderkey AS record_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') ON record_id = o_orderkey"))
def _(spark, sf_dir):
    accepted = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.count("*").alias("n"))
    cohort = load(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("record_id"), "o_orderstatus")
    j = accepted.join(cohort, "record_id", "left")
    verdict = guards.first_reason(("outside", F.col("o_orderstatus").isNull()), ("duplicate", F.col("n") > 1), ("mismatch", F.col("o_orderstatus") != "F"))
    return j.select("record_id", F.coalesce(verdict, F.lit("ok")).alias("verdict"))


@query("row_aligned_zip", oracle("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) ORDER BY doc_id"))
def _(spark, sf_dir):
    """Lists that were aligned by position meet on their id."""
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id").orderBy("doc_id")


@query("resolve_ids", oracle("SELECT id, CASE WHEN n_name IS NULL THEN 'unknown' ELSE n_name END AS resolved FROM (SELECT r_name || '.' || k AS id, r_name, k FROM region, generate_series(0, 9) g(k)) LEFT JOIN (SELECT n_name, r_name AS rn, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS place FROM nation JOIN region ON n_regionkey = r_regionkey) ON rn = r_name AND place = k"))
def _(spark, sf_dir):
    named = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    options = named.groupBy(F.col("r_name").alias("cat")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("o")).select("cat", F.posexplode("o").alias("at", "x")).select("cat", "at", "x.n_name")
    ids = load(spark, sf_dir, "region").select("r_name", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select(F.concat_ws(".", "r_name", "k").alias("id"))
    parts = F.split("id", "\\.")
    j = ids.join(options, (parts[0] == F.col("cat")) & (parts[1].cast("int") == F.col("at")), "left")
    return j.select("id", F.coalesce("n_name", F.lit("unknown")).alias("resolved"))


@query("edge_jaccard", oracle("""SELECT count(*) FILTER (l AND r) AS shared, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only, count(*) AS union_size, round(count(*) FILTER (l AND r) / nullif(count(*), 0), 6) AS jaccard
FROM (SELECT coalesce(avg((label = 'A')::INT) FILTER (direction = 'original'), 0) >= 0.5 AS l, coalesce(avg((label = 'A')::INT) FILTER (direction = 'flipped'), 0) >= 0.5 AS r FROM votes GROUP BY least(a, b), greatest(a, b)) WHERE l OR r"""))
def _(spark, sf_dir):
    """Edges that the first position wins in one presentation, against those that it wins in the other; an edge is the same in either orientation."""
    share = lambda d: F.coalesce(F.avg(F.when(F.col("direction") == d, (F.col("label") == "A").cast("double"))), F.lit(0.0)) >= 0.5
    g = derived(spark, sf_dir, "votes").groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(share("original").alias("l"), share("flipped").alias("r")).filter("l OR r")
    both = F.count_if(F.col("l") & F.col("r"))
    return rounded(g.agg(both.alias("shared"), F.count_if(F.col("l") & ~F.col("r")).alias("left_only"), F.count_if(F.col("r") & ~F.col("l")).alias("right_only"), F.count("*").alias("union_size"), F.when(F.count("*") > 0, both / F.count("*")).alias("jaccard")))


@query("intersect_all", oracle("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"))
def _(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    own = lambda cond: li.filter(cond).select(F.col("l_orderkey").alias("id"))
    return own("l_returnflag = 'A'").intersect(own("l_linestatus = 'F'")).intersect(load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query("union_drop", oracle("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0)"))
def _(spark, sf_dir):
    l = load(spark, sf_dir, "labels")  # noqa: E741
    bad = l.filter("toxic = 1").select("doc_id").union(l.filter("quality = 0").select("doc_id")).distinct()
    return load(spark, sf_dir, "documents").select("doc_id").join(bad, "doc_id", "left_anti")


@query("except_missing", oracle("SELECT 'missing' AS side, count(*) AS n FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'extra', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity < 30 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def _(spark, sf_dir):
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")  # noqa: E741
    missing = o.select("o_orderkey").subtract(l.select("l_orderkey")).agg(F.lit("missing").alias("side"), F.count("*").alias("n"))
    extra = l.filter("l_quantity < 30").select("l_orderkey").subtract(o.filter("o_orderstatus = 'F'").select("o_orderkey")).agg(F.lit("extra").alias("side"), F.count("*").alias("n"))
    return missing.union(extra)


@query("union_arms", oracle("WITH p AS (SELECT DISTINCT a, b FROM votes) SELECT a, b, 'original' AS direction, a AS first_id, b AS second_id FROM p UNION ALL SELECT a, b, 'flipped', b, a FROM p"))
def _(spark, sf_dir):
    from ..operators.pairwise import render_votes

    return render_votes(derived(spark, sf_dir, "votes").select("a", "b").distinct())


@query("unique_ordered", oracle("WITH w AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS roles FROM w GROUP BY conv_id"))
def _(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


@query("reconcile", oracle(f"""WITH p AS (SELECT record_id, best - least AS margin FROM {SCORES} WHERE best - least >= 0.3), q AS (SELECT DISTINCT l_orderkey AS record_id FROM lineitem WHERE l_returnflag = 'A')
SELECT coalesce(p.record_id, q.record_id) AS record_id, CASE WHEN q.record_id IS NULL THEN 'score_without_pair' WHEN p.record_id IS NULL THEN 'orphan_pair' ELSE 'kept' END AS state FROM p FULL JOIN q ON p.record_id = q.record_id"""))
def _(spark, sf_dir):
    p = scores(spark, sf_dir).filter(F.col("best") - F.col("least") >= 0.3).select("record_id", F.lit(True).alias("scored"))
    q = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("record_id")).distinct().withColumn("paired", F.lit(True))
    j = p.join(q, "record_id", "full")
    return j.select("record_id", F.when(F.col("paired").isNull(), "score_without_pair").when(F.col("scored").isNull(), "orphan_pair").otherwise("kept").alias("state"))
