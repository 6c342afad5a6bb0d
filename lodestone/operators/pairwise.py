"""Pairwise votes: edge probabilities, diagnostics, win rates, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import safe_rate

#: The share from which one position counts as a strategy, and how near to a half a tie is.
STRATEGY_SHARE, TIE_EPS = 0.95, 1e-9


def hash_unit(*keys: Column | str) -> Column:
    """A number in [0, 1) from the SHA-256 of keys joined by a colon, the same in every engine."""
    text = F.concat_ws(":", *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def vote_weight(label: str, direction: str, mode: str, seed: Column | None = None) -> tuple[Column, Column]:
    """What a vote adds to A and to B in the original orientation; a flipped vote for A is one for B."""
    straight = F.when(F.col(label) == "A", 1.0).when(F.col(label) == "B", 0.0)
    as_a = F.when(F.col(direction) == "flipped", 1.0 - straight).otherwise(straight)
    if mode == "distribution":
        as_a = F.coalesce(as_a, F.lit(0.5))
    elif mode == "random":
        as_a = F.coalesce(as_a, F.when(seed < 0.5, 1.0).otherwise(0.0))
    elif mode != "skip":
        raise ValueError(f"unknown mode {mode}")
    return as_a, 1.0 - as_a


def edge_prob(votes: DataFrame, mode: str = "skip", seed: Column | None = None) -> DataFrame:
    """(a, b, count_a, count_b, total, probability_a) of edges with any counted vote; mode says what an unparseable one is worth."""
    w_a, w_b = vote_weight("label", "direction", mode, seed)
    folded = votes.select("a", "b", w_a.alias("w_a"), w_b.alias("w_b"))
    out = folded.groupBy("a", "b").agg(F.coalesce(F.sum("w_a"), F.lit(0.0)).alias("count_a"), F.coalesce(F.sum("w_b"), F.lit(0.0)).alias("count_b"), F.count("w_a").alias("total"))
    return out.filter("total > 0").withColumn("probability_a", F.col("count_a") / (F.col("count_a") + F.col("count_b")))


def edge_prob_logprob(probs: DataFrame) -> DataFrame:
    """The same from probabilities of A, weight 1 each."""
    p = F.when(F.col("direction") == "flipped", 1.0 - F.col("p_a")).otherwise(F.col("p_a"))
    out = probs.select("a", "b", p.alias("p")).filter("p IS NOT NULL").groupBy("a", "b").agg(F.sum("p").alias("count_a"), F.count("*").alias("total"))
    return out.withColumn("probability_a", F.col("count_a") / F.col("total"))


def choice_mass(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, p_a) from (token, logprob): mass of A over that of A and B, tokens trimmed and upper-cased; null without either."""
    token = F.upper(F.trim(F.col("token")))
    mass = lambda x: F.coalesce(F.sum(F.when(token == x, F.exp("logprob"))), F.lit(0.0))
    return tokens.groupBy(*keys).agg(mass("A").alias("m_a"), mass("B").alias("m_b")).select(*keys, safe_rate(F.col("m_a"), F.col("m_a") + F.col("m_b")).alias("p_a"))


def edge_diag_hard(votes: DataFrame) -> DataFrame:
    """Per edge: how many votes are valid, how they lean by position and by order, and whether one position explains them."""
    valid, first = F.col("label").isin("A", "B"), F.col("label") == "A"
    flipped = F.col("direction") == "flipped"
    n = lambda cond: F.count_if(cond)
    out = votes.groupBy("a", "b").agg(
        F.count("*").alias("raw_count"),
        n(valid).alias("valid_count"),
        n(F.col("label").isNull()).alias("unparseable_count"),
        n(F.col("raw").isNull()).alias("none_count"),
        n(F.col("multiple")).alias("multiple_count"),
        n(first).alias("first_count"),
        n(F.col("label") == "B").alias("second_count"),
        n(valid & ~flipped).alias("n_original"),
        n(valid & flipped).alias("n_flipped"),
        n(first & ~flipped).alias("a_original"),
        n((F.col("label") == "B") & flipped).alias("a_flipped"),
    )
    out = out.withColumns({
        "invalid_rate": safe_rate(F.col("unparseable_count"), F.col("raw_count")),
        "multiple_rate": safe_rate(F.col("multiple_count"), F.col("raw_count")),
        "position_rate": safe_rate(F.col("first_count"), F.col("valid_count")),
        "original_a_rate": safe_rate(F.col("a_original"), F.col("n_original")),
        "flipped_a_rate": safe_rate(F.col("a_flipped"), F.col("n_flipped")),
        "probability_a": safe_rate(F.col("a_original") + F.col("a_flipped"), F.col("valid_count")),
    })
    both = (F.col("n_original") > 0) & (F.col("n_flipped") > 0)
    out = out.withColumns({
        "position_bias": F.col("position_rate") - 0.5,
        "order_effect_gap": F.col("original_a_rate") - F.col("flipped_a_rate"),
        "always_pick": F.when(both & (F.col("position_rate") >= STRATEGY_SHARE), "A").when(both & (F.col("second_count") / F.col("valid_count") >= STRATEGY_SHARE), "B"),
    })
    return out.withColumn("degenerate_tie", F.col("always_pick").isNotNull() & (F.abs(F.col("probability_a") - 0.5) <= TIE_EPS))


def edge_diag_logprob(probs: DataFrame) -> DataFrame:
    """The same from probabilities of the first position; a strategy needs every one of them beyond 0.95 or 0.05."""
    flipped = F.col("direction") == "flipped"
    out = probs.groupBy("a", "b").agg(
        F.count("*").alias("prompt_count"),
        F.count_if(F.col("p_a").isNull()).alias("none_count"),
        F.avg("p_a").alias("position_rate"),
        F.avg(F.when(~flipped, F.col("p_a"))).alias("original_a_rate"),
        F.avg(F.when(flipped, 1.0 - F.col("p_a"))).alias("flipped_a_rate"),
        F.min("p_a").alias("low"),
        F.max("p_a").alias("high"),
    )
    both = F.col("original_a_rate").isNotNull() & F.col("flipped_a_rate").isNotNull()
    return out.withColumns({
        "position_bias": F.col("position_rate") - 0.5,
        "order_effect_gap": F.col("original_a_rate") - F.col("flipped_a_rate"),
        "always_pick": F.when(both & (F.col("low") >= STRATEGY_SHARE), "A").when(both & (F.col("high") <= 1 - STRATEGY_SHARE), "B"),
    }).drop("low", "high")


def graph_diag(edges: DataFrame) -> DataFrame:
    """One row over the edges of edge_diag_hard."""
    return edges.agg(
        F.count("*").alias("n_edges"),
        F.sum("raw_count").alias("raw_total"),
        F.sum("valid_count").alias("valid_total"),
        safe_rate(F.sum("unparseable_count"), F.sum("raw_count")).alias("invalid_rate"),
        F.count_if(F.col("always_pick") == "A").alias("always_a"),
        F.count_if(F.col("always_pick") == "B").alias("always_b"),
        F.count_if("degenerate_tie").alias("degenerate_ties"),
        F.avg(F.abs("order_effect_gap")).alias("mean_abs_gap"),
        F.avg(F.abs("position_bias")).alias("mean_abs_bias"),
    )


def forecast_dist(labels: DataFrame, *keys: str) -> DataFrame:
    """Vote distribution over MORE, LESS and SAME: net score, plurality (null on a tie) and how it came about."""
    out = labels.groupBy(*keys).agg(F.count("*").alias("n_samples"), *(F.count_if(F.col("label") == x).alias(x.lower()) for x in ("MORE", "LESS", "SAME")))
    n = F.col("more") + F.col("less") + F.col("same")
    top = F.greatest("more", "less", "same")
    winners = sum(((F.col(x) == top).cast("int") for x in ("more", "less", "same")), F.lit(0))
    plurality = F.when((n > 0) & (winners == 1), F.when(F.col("more") == top, "MORE").when(F.col("less") == top, "LESS").otherwise("SAME"))
    return out.withColumns({
        "n_valid": n,
        "net": safe_rate(F.col("more") - F.col("less"), n),
        "plurality": plurality,
        "aggregation": F.when(n == 0, "no_valid_labels").when(top == n, "unanimous").when(plurality.isNull(), "tie").otherwise("plurality"),
        "parse_status": F.when(n == 0, "unparseable").when(n == F.col("n_samples"), "parsed").otherwise("partially_parsed"),
    })


def rotation_pool(labels: DataFrame) -> DataFrame:
    """Rotations of a record pooled, with the range of their net scores where more than one has any."""
    pooled = forecast_dist(labels, "record")
    nets = forecast_dist(labels, "record", "rotation").groupBy("record").agg(F.count("*").alias("rotations"), F.count("net").alias("_n"), (F.max("net") - F.min("net")).alias("_range"))
    return pooled.join(nets, "record").withColumn("order_effect", F.when(F.col("_n") > 1, F.col("_range"))).drop("_n", "_range")


def forecast_fold(nets: DataFrame, *keys: str) -> DataFrame:
    """Mean and population deviation of net scores with mean shares, by variant."""
    share = lambda x: F.avg(safe_rate(F.col(x), F.col("n_valid")))
    return nets.groupBy(*keys).agg(F.count("net").alias("n"), F.avg("net").alias("mean_net"), F.stddev_pop("net").alias("sd_net"), share("more").alias("up"), share("less").alias("down"), share("same").alias("flat"))


def forecast_report(folded: DataFrame, key: str, baseline: object) -> DataFrame:
    """Each variant against the baseline one."""
    base = folded.filter(F.col(key) == baseline).select(F.col("mean_net").alias("base_net"), F.col("flat").alias("base_flat"))
    return folded.join(F.broadcast(base)).select(key, "mean_net", (F.col("mean_net") - F.col("base_net")).alias("delta_net"), (F.col("flat") - F.col("base_flat")).alias("delta_flat"))


def win_rate(votes: DataFrame) -> DataFrame:
    """(item, wins, total, rate) over both members of every pair with a valid vote."""
    chose_a = F.when(F.col("direction") == "flipped", F.col("label") == "B").otherwise(F.col("label") == "A")
    sides = F.array(F.struct(F.col("a").alias("item"), chose_a.cast("int").alias("win")), F.struct(F.col("b").alias("item"), (~chose_a).cast("int").alias("win")))
    long = votes.filter(F.col("label").isin("A", "B")).select(F.explode(sides).alias("x")).select("x.*")
    return long.groupBy("item").agg(F.sum("win").cast("bigint").alias("wins"), F.count("*").alias("total")).withColumn("rate", F.col("wins") / F.col("total"))


def win_rate_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: mean and largest absolute change of shared items, and the item that changed most (ties: the larger)."""
    joined = before.select("item", F.col("rate").alias("r0")).join(after.select("item", F.col("rate").alias("r1")), "item").withColumn("d", F.abs(F.col("r1") - F.col("r0")))
    return joined.agg(F.avg("d").alias("mean_abs"), F.max("d").alias("max_abs"), F.max_by("item", F.struct(F.round("d", 9), "item")).alias("worst_item"))


def render_votes(pairs: DataFrame) -> DataFrame:
    """Both orientations of each pair."""
    both = pairs.withColumn("direction", F.explode(F.array(F.lit("original"), F.lit("flipped"))))
    flip = F.col("direction") == "flipped"
    return both.withColumns({"first_id": F.when(flip, F.col("b")).otherwise(F.col("a")), "second_id": F.when(flip, F.col("a")).otherwise(F.col("b"))})
