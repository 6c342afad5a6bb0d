"""Comparison graphs, active selection, utility fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.maths import normal_cdf_sql
from ..operators import graphs, pairwise
from ..tables import derived, oracle
from .aggregates import rounded

_POOL = "SELECT x.id AS a, y.id AS b FROM utilities x JOIN utilities y ON x.id < y.id"
_HASH = "sha256('42:' || a || '-' || b)"


def _pool(spark, sf_dir):
    return graphs.pair_pool(derived(spark, sf_dir, "utilities"))


@query("pair_pool", oracle(f"WITH p AS ({_POOL}) SELECT a, b, row_number() OVER (ORDER BY {_HASH}, a || '-' || b) <= least(CAST(floor(0.1 * (SELECT count(*) FROM p)) AS BIGINT), 1000) AS holdout FROM p"))
def _(spark, sf_dir):
    return _pool(spark, sf_dir)


@query("regular_graph", oracle("WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () AS n FROM utilities), t AS (SELECT id, (p + s) % n AS q FROM p, generate_series(1, 2) g(s)) SELECT DISTINCT least(t.id, p.id) AS a, greatest(t.id, p.id) AS b FROM t JOIN p ON t.q = p.p"))
def _(spark, sf_dir):
    return graphs.regular_graph(derived(spark, sf_dir, "utilities"), 4)


@query("random_edges", oracle(f"SELECT a, b FROM ({_POOL}) ORDER BY {_HASH}, a, b LIMIT 40"))
def _(spark, sf_dir):
    return graphs.random_edges(_pool(spark, sf_dir).select("a", "b"), 40)


@query("add_edges", oracle("WITH e AS (SELECT DISTINCT a, b FROM votes WHERE k < 40), n AS (SELECT DISTINCT b AS a, a AS b FROM votes WHERE k >= 98) SELECT a, b, 'old' AS origin FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.a = e.b AND n.b = e.a) UNION ALL SELECT a, b, 'new' FROM n"))
def _(spark, sf_dir):
    v = derived(spark, sf_dir, "votes")
    old = v.filter("k < 40").select("a", "b").distinct().withColumn("origin", F.lit("old"))
    new = v.filter("k >= 98").select(F.col("b").alias("a"), F.col("a").alias("b")).distinct().withColumn("origin", F.lit("new"))
    return graphs.add_edges(old, new, v.select("a", "b").distinct())[0]


@query("degree", oracle("SELECT id, count(*) AS degree FROM (SELECT DISTINCT a, b FROM votes) e, (VALUES (0), (1)) s(s), LATERAL (SELECT CASE s WHEN 0 THEN a ELSE b END AS id) GROUP BY id"))
def _(spark, sf_dir):
    return graphs.degree(derived(spark, sf_dir, "votes").select("a", "b").distinct())


_RATED = f"""WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM votes WHERE k = 7), d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id),
r AS (SELECT p.a, p.b, abs(x.mean - y.mean) AS gap, coalesce(dx.degree, 0) + coalesce(dy.degree, 0) AS s FROM ({_POOL}) p JOIN utilities x ON p.a = x.id JOIN utilities y ON p.b = y.id LEFT JOIN d dx ON p.a = dx.id LEFT JOIN d dy ON p.b = dy.id),
l AS (SELECT a, b, CASE """ + " ".join(f"WHEN gap <= (SELECT quantile_cont(gap, {min(1.0, 0.1 * 1.5**k)!r}) FROM r) AND s <= (SELECT quantile_cont(CAST(s AS DOUBLE), {min(1.0, 0.2 * 1.5**k)!r}) FROM r) THEN {k}" for k in range(6)) + """ ELSE 6 END AS level FROM r),
c AS (SELECT level, sum(count(*)) OVER (ORDER BY level) AS upto FROM l GROUP BY level), k AS (SELECT coalesce(min(level) FILTER (upto >= 20 AND level < 6), 6) AS reach FROM c) """


@query("active_select", oracle(_RATED + f"SELECT a, b FROM l, k ORDER BY level > reach, {_HASH} LIMIT 20"))
def _(spark, sf_dir):
    edges = derived(spark, sf_dir, "votes").filter("k = 7").select("a", "b").distinct()
    return graphs.active_select(derived(spark, sf_dir, "utilities"), edges, _pool(spark, sf_dir), 20, 0.1, 0.2)


_P = normal_cdf_sql("(x.mean - y.mean) / sqrt(x.variance + y.variance + 1e-5)")


@query("pseudolabel", oracle(f"SELECT a, b, CASE WHEN p >= 0.52 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS probability_a FROM (SELECT x.id AS a, y.id AS b, {_P} AS p FROM utilities x JOIN utilities y ON x.id < y.id) WHERE p >= 0.52 OR p <= 1 - 0.52"))
def _(spark, sf_dir):
    return graphs.pseudolabel(derived(spark, sf_dir, "utilities"), _pool(spark, sf_dir).select("a", "b"), 0.52)


def _edges(spark, sf_dir):
    return pairwise.edge_prob(derived(spark, sf_dir, "votes")).select("a", "b", "probability_a")


@query("fit_thurstone")
def _(spark, sf_dir):
    """Iterative: rows only; tests hold it against utilities that are known."""
    return rounded(graphs.fit_thurstone(_edges(spark, sf_dir)), 4)


@query("eval_thurstone", oracle(f"""WITH e AS (SELECT a, b, sum(w) / count(w) AS y FROM (SELECT a, b, CASE WHEN direction = 'flipped' THEN 1 - v ELSE v END AS w FROM (SELECT *, CASE label WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.0::DOUBLE END AS v FROM votes)) GROUP BY a, b HAVING count(w) > 0),
q AS (SELECT e.y, greatest(least({_P}, 1 - 1e-5), 1e-5) AS p, {_P} AS raw FROM e JOIN utilities x ON e.a = x.id JOIN utilities y ON e.b = y.id)
SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg(((raw >= 0.5) = (y >= 0.5))::INT), 6) AS accuracy FROM q"""))
def _(spark, sf_dir):
    return rounded(graphs.eval_thurstone(derived(spark, sf_dir, "utilities"), _edges(spark, sf_dir)))


@query("active_loop")
def _(spark, sf_dir):
    """The loop of fits and selections up to 2 N log2 N edges, replayed over known answers; beyond SQL, a test holds it against those answers."""
    u = derived(spark, sf_dir, "utilities").select("id")
    answers = graphs.with_utilities(_pool(spark, sf_dir).select("a", "b"), derived(spark, sf_dir, "utilities")).select("a", "b", F.col("p").alias("probability_a"))
    return rounded(graphs.active_loop(u, answers, 4, 20)[0], 4)
