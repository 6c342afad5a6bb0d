"""Queries of votes, forecasts, evaluations, rewards and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..functions.maths import safe_rate
from ..operators import guards, pairwise, rollups
from ..tables import derived, load, oracle


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded (and minus zero made zero), so that engines that add in other orders agree."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def votes_multi(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "votes").withColumn("multiple", text.multi_answer_flag("raw", ["A", "B"]))


HASH = "(CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT) / 4294967296.0)"
_FOLD = "CASE WHEN direction = 'flipped' THEN 1 - x ELSE x END"


@query("edge_prob", oracle("""SELECT a, b, sum(w) AS count_a, sum(1 - w) AS count_b, count(w) AS total, round(sum(w) / count(w), 6) AS probability_a
FROM (SELECT a, b, CASE WHEN direction = 'flipped' THEN 1 - x ELSE x END AS w FROM (SELECT *, CASE label WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.0::DOUBLE END AS x FROM votes)) GROUP BY a, b HAVING count(w) > 0"""))
def _(spark, sf_dir):
    return rounded(pairwise.edge_prob(derived(spark, sf_dir, "votes")))


@query("edge_prob_distribution", oracle("""SELECT a, b, sum(w) AS count_a, sum(1 - w) AS count_b, count(w) AS total, round(sum(w) / count(w), 6) AS probability_a
FROM (SELECT a, b, coalesce(CASE WHEN direction = 'flipped' THEN 1 - x ELSE x END, 0.5) AS w FROM (SELECT *, CASE label WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.0::DOUBLE END AS x FROM votes)) GROUP BY a, b"""))
def _(spark, sf_dir):
    return rounded(pairwise.edge_prob(derived(spark, sf_dir, "votes"), "distribution"))


@query("edge_prob_random", oracle(f"""SELECT a, b, sum(w) AS count_a, sum(1 - w) AS count_b, count(w) AS total, round(sum(w) / count(w), 6) AS probability_a
FROM (SELECT a, b, coalesce({_FOLD}, CASE WHEN {HASH.format("'42:' || event_id")} < 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS w FROM (SELECT *, CASE label WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.0::DOUBLE END AS x FROM votes)) GROUP BY a, b"""))
def _(spark, sf_dir):
    return rounded(pairwise.edge_prob(derived(spark, sf_dir, "votes"), "random", pairwise.hash_unit(F.lit(42), "event_id")))


@query("edge_prob_logprob", oracle("""SELECT a, b, round(sum(p), 6) AS count_a, count(p) AS total, round(avg(p), 6) AS probability_a
FROM (SELECT a, b, CASE WHEN direction = 'flipped' THEN 1 - p_a ELSE p_a END AS p FROM probs) WHERE p IS NOT NULL GROUP BY a, b"""))
def _(spark, sf_dir):
    return rounded(pairwise.edge_prob_logprob(derived(spark, sf_dir, "probs")))


@query("choice_mass", oracle("""WITH t AS (SELECT user_id, CASE k % 4 WHEN 0 THEN ' A' WHEN 1 THEN 'b' WHEN 2 THEN 'A' ELSE 'other' END AS token, -CAST(k AS DOUBLE) / 20 - 0.1 AS logprob FROM acts)
SELECT user_id, round(sum(CASE WHEN upper(trim(token)) = 'A' THEN exp(logprob) ELSE 0 END) / nullif(sum(CASE WHEN upper(trim(token)) IN ('A', 'B') THEN exp(logprob) ELSE 0 END), 0), 6) AS p_a FROM t GROUP BY user_id"""))
def _(spark, sf_dir):
    t = derived(spark, sf_dir, "acts").selectExpr("user_id", "CASE k % 4 WHEN 0 THEN ' A' WHEN 1 THEN 'b' WHEN 2 THEN 'A' ELSE 'other' END AS token", "-CAST(k AS DOUBLE) / 20 - 0.1D AS logprob")
    return rounded(pairwise.choice_mass(t, "user_id"))


_DIAG = """WITH d AS (SELECT a, b, count(*) AS raw_count, count(label) AS valid_count, count(*) - count(label) AS unparseable_count, count(*) FILTER (raw IS NULL) AS none_count, count(*) FILTER (k BETWEEN 90 AND 94) AS multiple_count,
  count(*) FILTER (label = 'A') AS first_count, count(*) FILTER (label = 'B') AS second_count, count(label) FILTER (direction = 'original') AS n_original, count(label) FILTER (direction = 'flipped') AS n_flipped,
  count(*) FILTER (label = 'A' AND direction = 'original') AS a_original, count(*) FILTER (label = 'B' AND direction = 'flipped') AS a_flipped FROM votes GROUP BY a, b),
e AS (SELECT *, unparseable_count / raw_count AS invalid_rate, multiple_count / raw_count AS multiple_rate, first_count / nullif(valid_count, 0) AS position_rate, a_original / nullif(n_original, 0) AS original_a_rate, a_flipped / nullif(n_flipped, 0) AS flipped_a_rate,
  (a_original + a_flipped) / nullif(valid_count, 0) AS probability_a FROM d),
f AS (SELECT *, position_rate - 0.5 AS position_bias, original_a_rate - flipped_a_rate AS order_effect_gap, CASE WHEN n_original > 0 AND n_flipped > 0 AND position_rate >= 0.95 THEN 'A' WHEN n_original > 0 AND n_flipped > 0 AND second_count / valid_count >= 0.95 THEN 'B' END AS always_pick FROM e),
g AS (SELECT *, always_pick IS NOT NULL AND abs(probability_a - 0.5) <= 1e-9 AS degenerate_tie FROM f) """


@query("edge_diag_hard", oracle(_DIAG + "SELECT * REPLACE (round(invalid_rate, 6) AS invalid_rate, round(multiple_rate, 6) AS multiple_rate, round(position_rate, 6) AS position_rate, round(original_a_rate, 6) AS original_a_rate, round(flipped_a_rate, 6) AS flipped_a_rate, round(probability_a, 6) AS probability_a, round(position_bias, 6) AS position_bias, round(order_effect_gap, 6) AS order_effect_gap) FROM g"))
def _(spark, sf_dir):
    return rounded(pairwise.edge_diag_hard(votes_multi(spark, sf_dir)))


@query("edge_diag_logprob", oracle("""SELECT a, b, prompt_count, none_count, round(pr, 6) AS position_rate, round(o, 6) AS original_a_rate, round(f, 6) AS flipped_a_rate, round(pr - 0.5, 6) AS position_bias, round(o - f, 6) AS order_effect_gap,
  CASE WHEN o IS NOT NULL AND f IS NOT NULL AND lo >= 0.95 THEN 'A' WHEN o IS NOT NULL AND f IS NOT NULL AND hi <= 0.05 THEN 'B' END AS always_pick
FROM (SELECT a, b, count(*) AS prompt_count, count(*) - count(p_a) AS none_count, avg(p_a) AS pr, avg(p_a) FILTER (direction <> 'flipped') AS o, avg(1 - p_a) FILTER (direction = 'flipped') AS f, min(p_a) AS lo, max(p_a) AS hi FROM probs GROUP BY a, b)"""))
def _(spark, sf_dir):
    return rounded(pairwise.edge_diag_logprob(derived(spark, sf_dir, "probs")))


@query("graph_diag", oracle(_DIAG + "SELECT count(*) AS n_edges, CAST(sum(raw_count) AS BIGINT) AS raw_total, CAST(sum(valid_count) AS BIGINT) AS valid_total, round(sum(unparseable_count) / sum(raw_count), 6) AS invalid_rate, count(*) FILTER (always_pick = 'A') AS always_a, count(*) FILTER (always_pick = 'B') AS always_b, count(*) FILTER (degenerate_tie) AS degenerate_ties, round(avg(abs(order_effect_gap)), 6) AS mean_abs_gap, round(avg(abs(position_bias)), 6) AS mean_abs_bias FROM g"))
def _(spark, sf_dir):
    return rounded(pairwise.graph_diag(pairwise.edge_diag_hard(votes_multi(spark, sf_dir))))


def _forecast_sql(keys: str) -> str:
    return f"""SELECT *, more + less + same AS n_valid, (more - less) / nullif(more + less + same, 0) AS net,
  CASE WHEN more + less + same > 0 AND (more = top)::INT + (less = top)::INT + (same = top)::INT = 1 THEN CASE WHEN more = top THEN 'MORE' WHEN less = top THEN 'LESS' ELSE 'SAME' END END AS plurality
  FROM (SELECT *, greatest(more, less, same) AS top FROM (SELECT {keys}, count(*) AS n_samples, count(*) FILTER (label = 'MORE') AS more, count(*) FILTER (label = 'LESS') AS less, count(*) FILTER (label = 'SAME') AS same FROM forecasts GROUP BY {keys}))"""


_FORECAST = "{keys}, n_samples, more, less, same, n_valid, round(net, 6) AS net, plurality, CASE WHEN n_valid = 0 THEN 'no_valid_labels' WHEN top = n_valid THEN 'unanimous' WHEN plurality IS NULL THEN 'tie' ELSE 'plurality' END AS aggregation, CASE WHEN n_valid = 0 THEN 'unparseable' WHEN n_valid = n_samples THEN 'parsed' ELSE 'partially_parsed' END AS parse_status"


@query("forecast_dist", oracle(f"SELECT {_FORECAST.format(keys='record')} FROM ({_forecast_sql('record')})"))
def _(spark, sf_dir):
    return rounded(pairwise.forecast_dist(derived(spark, sf_dir, "forecasts"), "record"))


@query("rotation_pool", oracle(f"""WITH r AS ({_forecast_sql('record, rotation')}), p AS ({_forecast_sql('record')}), e AS (SELECT record, count(*) AS rotations, CASE WHEN count(net) > 1 THEN max(net) - min(net) END AS oe FROM r GROUP BY record)
SELECT {_FORECAST.format(keys='record')}, rotations, round(oe, 6) AS order_effect FROM p JOIN e USING (record)"""))
def _(spark, sf_dir):
    return rounded(pairwise.rotation_pool(derived(spark, sf_dir, "forecasts")))


_FOLDED = f"""WITH d AS ({_forecast_sql('record, rotation')}), f AS (SELECT rotation, count(net) AS n, avg(net) AS mean_net, stddev_pop(net) AS sd_net, avg(more / nullif(n_valid, 0)) AS up, avg(less / nullif(n_valid, 0)) AS down, avg(same / nullif(n_valid, 0)) AS flat FROM d GROUP BY rotation) """


def _folded(spark, sf_dir):
    return pairwise.forecast_fold(pairwise.forecast_dist(derived(spark, sf_dir, "forecasts"), "record", "rotation"), "rotation")


@query("forecast_fold", oracle(_FOLDED + "SELECT rotation, n, round(mean_net, 6) AS mean_net, round(sd_net, 6) AS sd_net, round(up, 6) AS up, round(down, 6) AS down, round(flat, 6) AS flat FROM f"))
def _(spark, sf_dir):
    return rounded(_folded(spark, sf_dir))


@query("forecast_report", oracle(_FOLDED + "SELECT f.rotation, round(f.mean_net, 6) AS mean_net, round(f.mean_net - b.mean_net, 6) AS delta_net, round(f.flat - b.flat, 6) AS delta_flat FROM f, f b WHERE b.rotation = 0"))
def _(spark, sf_dir):
    return rounded(pairwise.forecast_report(_folded(spark, sf_dir), "rotation", 0))


_WINS = """SELECT item, CAST(sum(win) AS BIGINT) AS wins, count(*) AS total, sum(win) / count(*) AS rate FROM (
  SELECT a AS item, CASE WHEN (direction = 'flipped') = (label = 'B') THEN 1 ELSE 0 END AS win, event_id FROM votes WHERE label IS NOT NULL
  UNION ALL SELECT b, CASE WHEN (direction = 'flipped') = (label = 'B') THEN 0 ELSE 1 END, event_id FROM votes WHERE label IS NOT NULL) WHERE {} GROUP BY item"""


@query("win_rate", oracle(f"SELECT item, wins, total, round(rate, 6) AS rate FROM ({_WINS.format('true')})"))
def _(spark, sf_dir):
    return rounded(pairwise.win_rate(derived(spark, sf_dir, "votes")))


@query("win_rate_delta", oracle(f"""WITH d AS (SELECT item, abs(y.rate - x.rate) AS d FROM ({_WINS.format('event_id % 2 = 0')}) x JOIN ({_WINS.format('event_id % 2 = 1')}) y USING (item))
SELECT round(avg(d), 6) AS mean_abs, round(max(d), 6) AS max_abs, arg_max(item, (round(d, 9), item)) AS worst_item FROM d"""))
def _(spark, sf_dir):
    votes = derived(spark, sf_dir, "votes")
    return rounded(pairwise.win_rate_delta(pairwise.win_rate(votes.filter("event_id % 2 = 0")), pairwise.win_rate(votes.filter("event_id % 2 = 1"))))


@query("tier_counts", oracle("""WITH t AS (SELECT CASE doc_id % 12 WHEN 3 THEN 'terminal_label' WHEN 7 THEN 'empty' WHEN 8 THEN 'empty' WHEN 9 THEN 'has_think' WHEN 10 THEN 'terminal_label' ELSE 'truncated' END AS tier FROM documents)
SELECT tier, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY tier"""))
def _(spark, sf_dir):
    return rounded(rollups.histogram(derived(spark, sf_dir, "responses").withColumn("tier", text.recover("raw")["tier"]), "tier"))


_PASS = "CASE WHEN n - c < {k} THEN 1.0::DOUBLE WHEN c = 0 THEN 0.0::DOUBLE ELSE 1 - list_reduce(list_transform(generate_series(CAST(n - c + 1 AS BIGINT), CAST(n AS BIGINT)), lambda i: 1.0::DOUBLE - {k}::DOUBLE / i), lambda x, y: x * y, 1.0::DOUBLE) END"


def _pass_sql(ks, keys: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {lead}{k} AS k, round(avg({_PASS.format(k=k)}), 6) AS pass_at_k FROM graded {group} HAVING min(n) >= {k}" for k in ks)


@query("pass_at_k", oracle(f"SELECT * FROM ({_pass_sql((1, 3), '')})"))
def _(spark, sf_dir):
    return rounded(rollups.pass_at_k(derived(spark, sf_dir, "graded"), (1, 3)))


@query("pass_at_k_by", oracle(f"SELECT * FROM ({_pass_sql((1, 2), 'difficulty')})"))
def _(spark, sf_dir):
    return rounded(rollups.pass_at_k(derived(spark, sf_dir, "graded"), (1, 2), "difficulty"))


@query("all_tests_pass", oracle("SELECT problem, bool_and(correct) AS passed, count(*) AS n_tests FROM samples GROUP BY problem"))
def _(spark, sf_dir):
    tests = derived(spark, sf_dir, "samples").groupBy("problem").agg(F.collect_list(F.when(F.col("correct"), 1).otherwise(-2)).alias("scores"))
    return tests.select("problem", F.forall("scores", lambda x: x > 0).alias("passed"), F.size("scores").cast("bigint").alias("n_tests"))


@query("mean_pass1_by", oracle("""WITH g AS (SELECT *, c / n AS p FROM graded) SELECT 'overall' AS level, 'all' AS key, count(*) AS n, round(avg(p), 6) AS mean FROM g UNION ALL SELECT 'difficulty', difficulty, count(*), round(avg(p), 6) FROM g GROUP BY difficulty
UNION ALL SELECT 'platform', platform, count(*), round(avg(p), 6) FROM g GROUP BY platform"""))
def _(spark, sf_dir):
    return rounded(rollups.mean_by_sets(derived(spark, sf_dir, "graded"), F.col("c") / F.col("n"), ("difficulty", "platform")))


@query("pass1_given_code", oracle("""WITH p AS (SELECT problem, avg(correct::INT) AS pass1, bool_and(code <> '') AS has_code, sum((code = '')::INT) AS none, count(*) AS n FROM samples GROUP BY problem)
SELECT count(*) AS problems, round(avg(pass1), 6) AS pass1, round(avg(pass1) FILTER (has_code), 6) AS pass1_given_code, round(avg(has_code::INT), 6) AS emission_rate, round(sum(none) / sum(n), 6) AS no_code_rate FROM p"""))
def _(spark, sf_dir):
    per = derived(spark, sf_dir, "samples").groupBy("problem").agg(rollups.rate(F.col("correct")).alias("pass1"), F.bool_and(F.col("code") != "").alias("has_code"), F.count_if(F.col("code") == "").alias("none"), F.count("*").alias("n"))
    return rounded(per.agg(F.count("*").alias("problems"), F.avg("pass1").alias("pass1"), F.avg(F.when(F.col("has_code"), F.col("pass1"))).alias("pass1_given_code"), rollups.rate(F.col("has_code")).alias("emission_rate"), safe_rate(F.sum("none"), F.sum("n")).alias("no_code_rate")))


@query("merge_running_mean", oracle("SELECT platform, count(*) AS n, round(avg(c / n), 6) AS mean FROM graded GROUP BY platform"))
def _(spark, sf_dir):
    """Partial (sum, n) of two batches, merged by size."""
    part = derived(spark, sf_dir, "graded").groupBy("platform", (F.col("problem") % 2).alias("batch")).agg(F.sum(F.col("c") / F.col("n")).alias("s"), F.count("*").alias("n"))
    return rounded(part.groupBy("platform").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean")).select("platform", "n", "mean"))


_STATUS = "CASE k % 8 WHEN 1 THEN 'TimeoutExpired' WHEN 2 THEN 'OutOfMemory' WHEN 3 THEN 'Exception' WHEN 4 THEN 'SyntaxError' WHEN 5 THEN 'ValueError' WHEN 6 THEN 'AbnormalTermination' ELSE 'Done' END"


@query("failure_hist", oracle(f"SELECT {_STATUS} AS status, count(*) AS n, round(count(*) / (SELECT count(*) FROM runs), 6) AS share FROM runs GROUP BY 1"))
def _(spark, sf_dir):
    from ..functions.compare import run_status

    return rounded(rollups.histogram(derived(spark, sf_dir, "runs").withColumn("status", run_status("exit_code", "stderr")), "status")).orderBy(F.desc("n"))


@query("top_messages", oracle("SELECT message, count(*) AS n FROM (SELECT substr(split_part(text, chr(10), 1), 1, 160) AS message FROM documents) GROUP BY message ORDER BY n DESC, message LIMIT 20"))
def _(spark, sf_dir):
    first = F.substring(F.substring_index("text", "\n", 1), 1, 160)
    return load(spark, sf_dir, "documents").groupBy(first.alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(20)


@query("date_span", oracle("SELECT platform, strftime(min(contest_date), '%Y-%m-%d') AS first_date, strftime(max(contest_date), '%Y-%m-%d') AS last_date FROM samples GROUP BY platform"))
def _(spark, sf_dir):
    day = F.date_format("contest_date", "yyyy-MM-dd")
    return derived(spark, sf_dir, "samples").groupBy("platform").agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


@query("gen_summary", oracle("""SELECT arm, count(*) AS n, count(*) FILTER (finished) AS terminated, round(avg(finished::INT), 6) AS termination_rate, round(avg(CASE WHEN finished THEN reward ELSE 0 END), 6) AS mean_reward, round(avg(reward) FILTER (finished), 6) AS reward_given_termination,
  round(avg((finished AND solved)::INT), 6) AS full_pass, round(avg(solved::INT) FILTER (finished), 6) AS full_pass_given_termination FROM arms GROUP BY arm"""))
def _(spark, sf_dir):
    done = F.col("finished")
    return rounded(derived(spark, sf_dir, "arms").groupBy("arm").agg(F.count("*").alias("n"), F.count_if(done).alias("terminated"), rollups.rate(done).alias("termination_rate"), F.avg(F.when(done, F.col("reward")).otherwise(0.0)).alias("mean_reward"), F.avg(F.when(done, F.col("reward"))).alias("reward_given_termination"), rollups.rate(done & F.col("solved")).alias("full_pass"), rollups.rate(F.when(done, F.col("solved"))).alias("full_pass_given_termination")))


@query("length_survival", oracle("""WITH s AS (SELECT platform, tokens, row_number() OVER (PARTITION BY platform ORDER BY tokens) - 1 AS r, count(*) OVER (PARTITION BY platform) AS n FROM samples)
SELECT platform, max(CASE WHEN r = n // 2 THEN tokens END) AS median, max(tokens) AS longest, round(avg((tokens < 10)::INT), 6) AS below_10, round(avg((tokens < 25)::INT), 6) AS below_25, round(avg((tokens < 40)::INT), 6) AS below_40 FROM s GROUP BY platform"""))
def _(spark, sf_dir):
    s = derived(spark, sf_dir, "samples")
    shares = s.groupBy("platform").agg(F.max("tokens").alias("longest"), *(rollups.rate(F.col("tokens") < c).alias(f"below_{c}") for c in (10, 25, 40)))
    return rounded(shares.join(rollups.counted_statistic(s, "tokens", {"median": "n div 2"}, "platform"), "platform"))


@query("heuristic_agree", oracle("SELECT platform, count(*) AS n, round(avg(((code <> '') = correct)::INT), 6) AS agreement FROM samples WHERE finished GROUP BY platform"))
def _(spark, sf_dir):
    known = derived(spark, sf_dir, "samples").filter("finished")
    return rounded(known.groupBy("platform").agg(F.count("*").alias("n"), rollups.rate((F.col("code") != "") == F.col("correct")).alias("agreement")))


@query("heldout_summary", oracle("""WITH r AS (SELECT item, avg(reward) AS mr, avg(reward) FILTER (finished) AS rt, avg(finished::INT) AS t, bool_or(solved) AS any_solved FROM arms GROUP BY item)
SELECT count(*) AS records, round(avg(mr), 6) AS mean_reward, round(avg(rt), 6) AS reward_given_termination, round(avg(t), 6) AS termination_rate, round(avg(any_solved::INT), 6) AS solve_rate FROM r"""))
def _(spark, sf_dir):
    per = derived(spark, sf_dir, "arms").groupBy("item").agg(F.avg("reward").alias("mr"), F.avg(F.when(F.col("finished"), F.col("reward"))).alias("rt"), rollups.rate(F.col("finished")).alias("t"), F.bool_or("solved").alias("any_solved"))
    return rounded(per.agg(F.count("*").alias("records"), F.avg("mr").alias("mean_reward"), F.avg("rt").alias("reward_given_termination"), F.avg("t").alias("termination_rate"), rollups.rate(F.col("any_solved")).alias("solve_rate")))


_GROUPS = """SELECT record_id, count(*) AS n_candidates, count(reward) AS n_gradable, count(*) - count(reward) AS n_truncated, count(*) FILTER (trim(text) = '') AS n_empty,
  arg_max(text, (reward, text)) FILTER (reward IS NOT NULL) AS chosen, arg_min(text, (reward, text)) FILTER (reward IS NOT NULL) AS rejected, max(reward) AS chosen_reward, min(reward) AS rejected_reward, max(reward) - min(reward) AS margin FROM rollouts GROUP BY record_id"""


@query("group_best_worst", oracle(f"SELECT * REPLACE (round(chosen_reward, 6) AS chosen_reward, round(rejected_reward, 6) AS rejected_reward, round(margin, 6) AS margin) FROM ({_GROUPS})"))
def _(spark, sf_dir):
    return rounded(rollups.best_worst(derived(spark, sf_dir, "rollouts"), "record_id"))


@query("group_best", oracle("SELECT record_id, arg_max(text, (coalesce(reward, -1e308), text)) AS best FROM rollouts GROUP BY record_id"))
def _(spark, sf_dir):
    return derived(spark, sf_dir, "rollouts").groupBy("record_id").agg(F.max_by("text", F.struct(F.coalesce("reward", F.lit(-1e308)), "text")).alias("best"))


@query("usable_groups", oracle("SELECT record_id, reward_call, count(*) AS n FROM rollouts WHERE reward IS NOT NULL AND record_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY record_id, reward_call HAVING count(*) >= 2 AND max(reward) > min(reward)"))
def _(spark, sf_dir):
    paired = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("record_id"))
    scored = derived(spark, sf_dir, "rollouts").filter("reward IS NOT NULL").join(paired, "record_id", "left_semi")
    return scored.groupBy("record_id", "reward_call").agg(F.count("*").alias("n"), (F.max("reward") - F.min("reward")).alias("spread")).filter("n >= 2 AND spread > 0").drop("spread")


@query("repair_rank", oracle("SELECT record_id, count(*) AS attempts, arg_max(pos, (CASE WHEN api_error THEN 0 WHEN pass_rate = 1 THEN 2 ELSE 1 END, coalesce(pass_rate, -1.0), pos)) AS best_pos FROM attempts GROUP BY record_id"))
def _(spark, sf_dir):
    kind = F.when(F.col("api_error"), 0).when(F.col("pass_rate") == 1, 2).otherwise(1)
    return derived(spark, sf_dir, "attempts").groupBy("record_id").agg(F.count("*").alias("attempts"), F.max_by("pos", F.struct(kind, F.coalesce("pass_rate", F.lit(-1.0)), "pos")).alias("best_pos"))


@query("pair_audit", oracle(f"SELECT record_id, n_candidates, n_gradable, n_truncated, n_empty, round(margin, 6) AS margin, n_gradable >= 2 AND coalesce(margin, 0) >= 0.3 AS eligible FROM ({_GROUPS})"))
def _(spark, sf_dir):
    g = rollups.best_worst(derived(spark, sf_dir, "rollouts"), "record_id")
    return rounded(g.select("record_id", "n_candidates", "n_gradable", "n_truncated", "n_empty", "margin", ((F.col("n_gradable") >= 2) & (F.coalesce("margin", F.lit(0.0)) >= 0.3)).alias("eligible")))


@query("summary_stats", oracle("SELECT difficulty, count(tokens) AS n, round(avg(tokens), 6) AS mean, round(coalesce(stddev_samp(tokens), 0), 6) AS sd, round(coalesce(stddev_samp(tokens), 0) / sqrt(count(tokens)), 6) AS se, min(tokens) AS low, max(tokens) AS high FROM samples GROUP BY difficulty"))
def _(spark, sf_dir):
    return rounded(rollups.summary_stats(derived(spark, sf_dir, "samples"), "tokens", "difficulty"))


_MARGIN = "WITH m AS (SELECT margin - 0.4 AS d FROM (" + _GROUPS + ") WHERE margin IS NOT NULL) "


@query("binomial_se", oracle(_MARGIN + "SELECT count(*) AS n, round(avg((d > 1e-9)::INT), 6) AS accuracy, round(avg((abs(d) <= 1e-9)::INT), 6) AS tie_rate, round(sqrt(avg((d > 1e-9)::INT) * (1 - avg((d > 1e-9)::INT)) / count(*)), 6) AS se, round(avg(ln(1 + exp(-d))), 6) AS logistic_loss FROM m"))
def _(spark, sf_dir):
    m = rollups.best_worst(derived(spark, sf_dir, "rollouts"), "record_id").filter("margin IS NOT NULL").select((F.col("margin") - 0.4).alias("d"))
    p = rollups.rate(F.col("d") > 1e-9)
    return rounded(m.agg(F.count("*").alias("n"), p.alias("accuracy"), rollups.rate(F.abs("d") <= 1e-9).alias("tie_rate"), F.sqrt(p * (1 - p) / F.count("*")).alias("se"), F.avg(F.log1p(F.exp(-F.col("d")))).alias("logistic_loss")))


@query("pairwise_accuracy", oracle("WITH p AS (SELECT item, avg(reward) FILTER (arm = 'arm') AS c, avg(reward) FILTER (arm = 'base') AS r FROM arms GROUP BY item) SELECT count(*) AS n, round(avg((round(c, 9) > round(r, 9))::INT), 6) AS accuracy FROM p WHERE c IS NOT NULL AND r IS NOT NULL"))
def _(spark, sf_dir):
    p = derived(spark, sf_dir, "arms").groupBy("item").agg(F.avg(F.when(F.col("arm") == "arm", F.col("reward"))).alias("c"), F.avg(F.when(F.col("arm") == "base", F.col("reward"))).alias("r")).dropna()
    return rounded(p.agg(F.count("*").alias("n"), rollups.rate(F.round("c", 9) > F.round("r", 9)).alias("accuracy")))


@query("seed_gate", oracle("WITH s AS (SELECT problem % 5 AS seed, avg(correct::INT) AS acc, count(*) AS n FROM samples GROUP BY 1) SELECT round(max(acc), 6) AS best, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd, round(100 / min(n), 6) AS points_per_pair, avg(acc) >= 0.3 AND min(acc) >= 0.25 AS passed FROM s"))
def _(spark, sf_dir):
    s = derived(spark, sf_dir, "samples").groupBy((F.col("problem") % 5).alias("seed")).agg(rollups.rate(F.col("correct")).alias("acc"), F.count("*").alias("n"))
    return rounded(s.agg(F.max("acc").alias("best"), F.avg("acc").alias("mean"), F.stddev_samp("acc").alias("sd"), (100 / F.min("n")).alias("points_per_pair"), ((F.avg("acc") >= 0.3) & (F.min("acc") >= 0.25)).alias("passed")))


@query("answer_balance", oracle("""WITH s AS (SELECT rotation, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY rotation) AS share FROM forecasts WHERE label IS NOT NULL GROUP BY rotation, label)
SELECT rotation, round(max(abs(share - 1 / 3)), 6) AS worst, count(*) < 3 AS missing FROM s GROUP BY rotation"""))
def _(spark, sf_dir):
    n = derived(spark, sf_dir, "forecasts").filter("label IS NOT NULL").groupBy("rotation", "label").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("rotation"))
    return rounded(n.withColumn("share", share).groupBy("rotation").agg(F.max(F.abs(F.col("share") - 1 / 3)).alias("worst"), (F.count("*") < 3).alias("missing")))


@query("length_tell", oracle("SELECT count(*) AS n, round(avg(((length(raw) > 9) = (label = 'A'))::INT), 6) AS accuracy FROM votes WHERE label IS NOT NULL AND a <> b"))
def _(spark, sf_dir):
    return rounded(derived(spark, sf_dir, "votes").filter("label IS NOT NULL AND a <> b").agg(F.count("*").alias("n"), rollups.rate((F.length("raw") > 9) == (F.col("label") == "A")).alias("accuracy")))


@query("position_report", oracle("SELECT direction, count(*) FILTER (label = 'A') AS first, count(*) FILTER (label = 'B') AS second, round(avg((label = 'A')::INT), 6) AS first_share, round(avg((label = 'A')::INT) - 0.5, 6) AS over_chance FROM votes WHERE label IS NOT NULL GROUP BY direction"))
def _(spark, sf_dir):
    at = F.array_position(F.array(F.lit("A"), F.lit("B")), F.col("label"))
    return rounded(derived(spark, sf_dir, "votes").filter("label IS NOT NULL").groupBy("direction").agg(F.count_if(at == 1).alias("first"), F.count_if(at == 2).alias("second"), rollups.rate(at == 1).alias("first_share"), (rollups.rate(at == 1) - 0.5).alias("over_chance")))


@query("contradictions", oracle("SELECT a, b, user_id, count(DISTINCT CASE WHEN (direction = 'flipped') = (label = 'B') THEN a ELSE b END) AS answers FROM votes WHERE label IS NOT NULL GROUP BY a, b, user_id HAVING count(DISTINCT CASE WHEN (direction = 'flipped') = (label = 'B') THEN a ELSE b END) > 1"))
def _(spark, sf_dir):
    chosen = F.when((F.col("direction") == "flipped") == (F.col("label") == "B"), F.col("a")).otherwise(F.col("b"))
    return derived(spark, sf_dir, "votes").filter("label IS NOT NULL").groupBy("a", "b", "user_id").agg(F.countDistinct(chosen).alias("answers")).filter("answers > 1")


_ENDS = "SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_type, (ts, event_id)) AS f, arg_max(event_type, (ts, event_id)) AS l, count(*) AS n FROM acts GROUP BY 1, 2"


def _ends(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return derived(spark, sf_dir, "acts").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("event_type", at).alias("f"), F.max_by("event_type", at).alias("l"), F.count("*").alias("n"))


@query("flip_rate", oracle(f"SELECT count(*) AS shared, round(avg((f <> l)::INT), 6) AS flip_rate FROM ({_ENDS}) WHERE n > 1"))
def _(spark, sf_dir):
    return rounded(_ends(spark, sf_dir).filter("n > 1").agg(F.count("*").alias("shared"), rollups.rate(F.col("f") != F.col("l")).alias("flip_rate")))


@query("noise_floor", oracle(f"""WITH e AS ({_ENDS}), r AS (SELECT count(*) FILTER (n > 1) AS shared, avg((f <> l)::INT) FILTER (n > 1) AS p, avg((f <> 'view')::INT) FILTER (n > 1) AS q FROM e)
SELECT shared, round(p, 6) AS flip_rate, round(q, 6) AS replicate_rate, round(p - q, 6) AS excess, round(2 * sqrt(q * (1 - q) / shared), 6) AS floor, p - q > 2 * sqrt(q * (1 - q) / shared) AS beyond FROM r"""))
def _(spark, sf_dir):
    r = _ends(spark, sf_dir).filter("n > 1").agg(F.count("*").alias("shared"), rollups.rate(F.col("f") != F.col("l")).alias("flip_rate"), rollups.rate(F.col("f") != "view").alias("replicate_rate"))
    floor = 2 * F.sqrt(F.col("replicate_rate") * (1 - F.col("replicate_rate")) / F.col("shared"))
    return rounded(r.withColumn("excess", F.col("flip_rate") - F.col("replicate_rate")).withColumn("floor", floor).withColumn("beyond", F.col("excess") > F.col("floor")))


@query("value_profile", oracle("""WITH x AS (SELECT c_mktsegment AS value, ord, count(*) AS n FROM choices JOIN customer ON idx = c_custkey WHERE choice = 'first' GROUP BY 1, 2),
d AS (SELECT coalesce(f.value, r.value) AS value, coalesce(f.n, 0) AS forward, coalesce(r.n, 0) AS reverse FROM (SELECT * FROM x WHERE ord = 'forward') f FULL JOIN (SELECT * FROM x WHERE ord = 'reverse') r ON f.value = r.value)
SELECT value, forward, reverse, reverse - forward AS delta FROM d ORDER BY abs(reverse - forward) DESC, value LIMIT 4"""))
def _(spark, sf_dir):
    chosen = derived(spark, sf_dir, "choices").filter("choice = 'first'").join(load(spark, sf_dir, "customer"), F.col("idx") == F.col("c_custkey"))
    side = lambda o: chosen.filter(F.col("ord") == o).groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias(o))
    both = side("forward").join(side("reverse"), "value", "full").fillna(0)
    return both.withColumn("delta", F.col("reverse") - F.col("forward")).orderBy(F.desc(F.abs("delta")), "value").limit(4)


@query("order_consistent", oracle("SELECT idx, min(choice) AS choice FROM choices GROUP BY idx HAVING count(DISTINCT choice) = 1 AND count(DISTINCT ord) = 2"))
def _(spark, sf_dir):
    g = derived(spark, sf_dir, "choices").groupBy("idx").agg(F.min("choice").alias("choice"), F.max("choice").alias("other"), F.countDistinct("ord").alias("orders"))
    return g.filter("choice = other AND orders = 2").select("idx", "choice")


@query("mcnemar_counts", oracle("WITH p AS (SELECT item, bool_or(solved) FILTER (arm = 'arm') AS x, bool_or(solved) FILTER (arm = 'base') AS y FROM arms GROUP BY item) SELECT count(*) AS shared, count(*) FILTER (x AND NOT y) AS arm_only, count(*) FILTER (y AND NOT x) AS base_only FROM p WHERE x IS NOT NULL AND y IS NOT NULL"))
def _(spark, sf_dir):
    side = lambda arm: F.bool_or(F.when(F.col("arm") == arm, F.col("solved")))
    p = derived(spark, sf_dir, "arms").groupBy("item").agg(side("arm").alias("x"), side("base").alias("y")).dropna()
    return p.agg(F.count("*").alias("shared"), F.count_if(F.col("x") & ~F.col("y")).alias("arm_only"), F.count_if(F.col("y") & ~F.col("x")).alias("base_only"))


@query("output_contract", oracle("SELECT (SELECT count(*) FROM utilities) AS n_utilities, (SELECT count(DISTINCT p_brand) FROM part) AS n_options, round(avg((label IS NOT NULL)::INT), 6) AS parse_rate, avg((label IS NOT NULL)::INT) >= 0.85 AND (SELECT count(*) FROM utilities) = (SELECT count(DISTINCT p_brand) FROM part) AS ok FROM votes"))
def _(spark, sf_dir):
    n = derived(spark, sf_dir, "utilities").agg(F.count("*").alias("n_utilities"))
    m = load(spark, sf_dir, "part").agg(F.countDistinct("p_brand").alias("n_options"))
    r = derived(spark, sf_dir, "votes").agg(rollups.rate(F.col("label").isNotNull()).alias("parse_rate"))
    one = n.join(F.broadcast(m)).join(F.broadcast(r))
    return rounded(one.withColumn("ok", (F.col("parse_rate") >= 0.85) & (F.col("n_utilities") == F.col("n_options"))))


@query("parse_rate", oracle("SELECT direction, count(*) AS n, count(label) AS parsed, round(count(label) / count(*), 6) AS rate, count(DISTINCT label) AS distinct_labels, count(label) / count(*) >= 0.85 AS passed FROM votes GROUP BY direction"))
def _(spark, sf_dir):
    g = derived(spark, sf_dir, "votes").groupBy("direction").agg(F.count("*").alias("n"), F.count("label").alias("parsed"), F.countDistinct("label").alias("distinct_labels"))
    return rounded(g.withColumn("rate", F.col("parsed") / F.col("n")).withColumn("passed", F.col("rate") >= 0.85))


@query("job_clean", oracle("SELECT user_id % 5 AS job, count(*) AS n, round(count(label) / count(*), 6) AS parse_rate, round(avg((trim(raw) = '')::INT), 6) AS empty_rate, count(label) / count(*) >= 0.9 AND avg((trim(raw) = '')::INT) <= 0.005 AS clean FROM votes GROUP BY 1"))
def _(spark, sf_dir):
    g = derived(spark, sf_dir, "votes").groupBy((F.col("user_id") % 5).alias("job")).agg(F.count("*").alias("n"), (F.count("label") / F.count("*")).alias("parse_rate"), rollups.rate(F.trim("raw") == "").alias("empty_rate"))
    return rounded(g.withColumn("clean", (F.col("parse_rate") >= 0.9) & (F.col("empty_rate") <= 0.005)))


@query("completed_pairs", oracle("WITH c AS (SELECT a, b, count(*) FILTER (direction = 'original') AS n0, count(*) FILTER (direction = 'flipped') AS n1 FROM votes GROUP BY a, b) SELECT a, b, CASE WHEN n0 >= 60 AND n1 >= 60 THEN 'done' WHEN n0 >= 60 OR n1 >= 60 THEN 'partial' ELSE 'open' END AS state FROM c"))
def _(spark, sf_dir):
    n = lambda d: F.count_if(F.col("direction") == d)
    c = derived(spark, sf_dir, "votes").groupBy("a", "b").agg((n("original") >= 60).alias("x"), (n("flipped") >= 60).alias("y"))
    return c.select("a", "b", F.when(F.col("x") & F.col("y"), "done").when(F.col("x") | F.col("y"), "partial").otherwise("open").alias("state"))


@query("reason_counts_all", oracle("""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN contains(text, '@') THEN 'address' END], lambda x: x IS NOT NULL)) AS reason FROM documents) GROUP BY reason"""))
def _(spark, sf_dir):
    why = guards.reasons(("short", F.col("n_chars") < 200), ("long", F.col("n_chars") > 5000), ("language", F.col("lang") != "en"), ("address", F.contains("text", F.lit("@"))))
    return load(spark, sf_dir, "documents").select(F.explode(F.array_distinct(why)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("config_parity", oracle("SELECT run_id, count(DISTINCT input_tokens % 10) AS variants, count(DISTINCT input_tokens % 10) = 1 AS same, min(input_tokens % 10) + 8 AS effective_batch FROM attempts GROUP BY run_id"))
def _(spark, sf_dir):
    v = F.col("input_tokens") % 10
    return derived(spark, sf_dir, "attempts").groupBy("run_id").agg(F.countDistinct(v).alias("variants"), (F.countDistinct(v) == 1).alias("same"), (F.min(v) + 8).alias("effective_batch"))


@query("identity_guard", oracle("SELECT count(DISTINCT (lang, source)) AS n_distinct, count(DISTINCT (lang, source)) <= 1 AS ok FROM documents"))
def _(spark, sf_dir):
    return guards.identity(load(spark, sf_dir, "documents"), "lang", "source")


@query("q95_tau", oracle("WITH d AS (SELECT platform, abs(avg(correct::INT) FILTER (sample % 2 = 0) - avg(correct::INT) FILTER (sample % 2 = 1)) AS d FROM samples GROUP BY platform, problem) SELECT platform, round(quantile_cont(d, 0.95), 6) AS tau FROM d WHERE d IS NOT NULL GROUP BY platform"))
def _(spark, sf_dir):
    half = lambda k: F.avg(F.when(F.col("sample") % 2 == k, F.col("correct").cast("double")))
    d = derived(spark, sf_dir, "samples").groupBy("platform", "problem").agg(F.abs(half(0) - half(1)).alias("d")).dropna()
    return rounded(d.groupBy("platform").agg(F.percentile("d", 0.95).alias("tau")))


@query("source_license_counts", oracle("SELECT source, CASE WHEN contains(text, 'MIT License') THEN 'MIT' WHEN contains(text, 'Apache License') THEN 'Apache-2.0' ELSE 'unknown' END AS license, count(*) AS n FROM documents GROUP BY 1, 2"))
def _(spark, sf_dir):
    license = F.when(F.contains("text", F.lit("MIT License")), "MIT").when(F.contains("text", F.lit("Apache License")), "Apache-2.0").otherwise("unknown")
    return load(spark, sf_dir, "documents").groupBy("source", license.alias("license")).agg(F.count("*").alias("n"))


_COST = "SELECT record_id, sum(input_tokens * 0.5 + output_tokens * 1.5) / 1000 AS cost FROM attempts GROUP BY record_id"


@query("cost_rollup", oracle(f"""WITH c AS ({_COST}), r AS (SELECT cost, row_number() OVER (ORDER BY cost) - 1 AS k, count(*) OVER () AS n FROM c), h AS (SELECT (epoch(max(started_at)) - epoch(min(started_at))) / 3600 AS hours FROM attempts)
SELECT count(*) AS records, round(sum(cost), 4) AS total, round(avg(cost), 6) AS mean, round(max(CASE WHEN k = CAST(floor(0.9 * (n - 1)) AS BIGINT) THEN cost END), 6) AS p90, round(sum(cost) / (SELECT hours FROM h), 6) AS burn_per_hour, round((200 - count(*)) * (SELECT hours FROM h) / count(*), 4) AS eta_hours FROM r"""))
def _(spark, sf_dir):
    log = derived(spark, sf_dir, "attempts")
    cost = log.groupBy("record_id").agg((F.sum(F.col("input_tokens") * 0.5 + F.col("output_tokens") * 1.5) / 1000).alias("cost"))
    hours = log.agg(((F.unix_micros(F.max("started_at").cast("timestamp")) - F.unix_micros(F.min("started_at").cast("timestamp"))) / 3.6e9).alias("hours"))
    out = cost.agg(F.count("*").alias("records"), F.sum("cost").alias("total"), F.avg("cost").alias("mean")).join(F.broadcast(rollups.counted_statistic(cost, "cost", {"p90": "cast(floor(0.9D * (n - 1)) as bigint)"}))).join(F.broadcast(hours))
    return out.select("records", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("p90", 6).alias("p90"), F.round(F.col("total") / F.col("hours"), 6).alias("burn_per_hour"), F.round((200 - F.col("records")) * F.col("hours") / F.col("records"), 4).alias("eta_hours"))


@query("drop_reasons", oracle("SELECT arm, count(*) FILTER (t IS NULL) AS missing, count(*) FILTER (length(trim(t)) < 40) AS degenerate, count(*) FILTER (regexp_matches(t, '^(?i)(as an|i cannot|sorry)')) AS refusal FROM (SELECT lang AS arm, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'Sorry, I can do no such thing here, not at all.' ELSE text END AS t FROM documents) GROUP BY arm"))
def _(spark, sf_dir):
    t = load(spark, sf_dir, "documents").selectExpr("lang AS arm", "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'Sorry, I can do no such thing here, not at all.' ELSE text END AS t")
    return t.groupBy("arm").agg(F.count_if(F.col("t").isNull()).alias("missing"), F.count_if(F.length(F.trim("t")) < 40).alias("degenerate"), F.count_if(F.col("t").rlike("^(?i)(as an|i cannot|sorry)")).alias("refusal"))


@query("difficulty_solve", oracle("SELECT difficulty, count(*) AS total, count(*) FILTER (c > 0) AS solved, round(avg((c > 0)::INT), 6) AS share FROM graded GROUP BY difficulty"))
def _(spark, sf_dir):
    return rounded(derived(spark, sf_dir, "graded").groupBy("difficulty").agg(F.count("*").alias("total"), F.count_if(F.col("c") > 0).alias("solved"), rollups.rate(F.col("c") > 0).alias("share")))


@query("order_stats", oracle("WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, max(CASE WHEN k = n // 2 THEN n_chars END) AS median, max(CASE WHEN k = least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) THEN n_chars END) AS p99, max(n_chars) AS most FROM r GROUP BY source"))
def _(spark, sf_dir):
    return rollups.counted_statistic(load(spark, sf_dir, "documents"), "n_chars", {"median": "n div 2", "p99": "least(n - 1, cast(floor(0.99D * n) as bigint))", "most": "n - 1"}, "source")
