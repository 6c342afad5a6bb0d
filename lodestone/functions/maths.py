"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Erf by a rational approximation with an absolute error below 1.5e-7.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def safe_rate(num: Column, den: Column) -> Column:
    """num / den, null unless den is positive."""
    return F.when(den > 0, num.cast("double") / den)


def normal_cdf(x: Column | str) -> Column:
    z = col(x) / (2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + ERF_P * F.abs(z))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.signum(z) * (F.lit(1.0) - poly * F.exp(-z * z))
    return 0.5 * (F.lit(1.0) + erf)


def normal_cdf_sql(x: str) -> str:
    z = f"(({x}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P}::DOUBLE * abs({z})))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})::DOUBLE) * {t})"
    return f"(0.5::DOUBLE * (1.0::DOUBLE + sign({z}) * (1.0::DOUBLE - {poly} * exp(-{z} * {z}))))"


def preference_probability(mean_a, var_a, mean_b, var_b) -> Column:
    return normal_cdf((col(mean_a) - col(mean_b)) / F.sqrt(col(var_a) + col(var_b) + 1e-5))


def pass_at_k(n: Column | str, c: Column | str, k: int) -> Column:
    """1 - prod(1 - k/i) for i from n-c+1 to n; 1 if fewer than k fail, 0 if none passes."""
    n, c = col(n), col(c)
    product = F.aggregate(F.sequence(F.least(n - c + 1, n), n), F.lit(1.0), lambda acc, i: acc * (1.0 - k / i.cast("double")))
    return F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1.0 - product)


def log_loss(p: Column | str, y: Column | str, eps: float = 1e-5) -> Column:
    q = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))
    return -(col(y) * F.ln(q) + (1 - col(y)) * F.ln(1 - q))


def drift_label(delta: Column | str, tau: float) -> Column:
    d = col(delta)
    return F.when(d > tau, "MORE").when(d < -tau, "LESS").otherwise("SAME")


#: Lengths in tokens of the score's band, and its value at the floor.
BAND_FLOOR, BAND_TARGET, BAND_BUDGET, BAND_FLOOR_VALUE = 32, 256, 500, 0.4


def band_score(n: Column | str, floor: int = BAND_FLOOR, target: int = BAND_TARGET, budget: int = BAND_BUDGET, floor_value: float = BAND_FLOOR_VALUE) -> Column:
    """Length score: from the floor's value up to 1 at the floor, 1 up to the target, down to 0 at the budget."""
    n = col(n).cast("double")
    return F.when(n > budget, 0.0).when(n > target, (budget - n) / max(budget - target, 1)).when(n >= floor, 1.0).otherwise(floor_value + (1 - floor_value) * n / max(floor, 1))


#: What a commitment, the length score and a right answer weigh, and the penalty without a commitment.
W_COMMIT, W_BAND, W_CORRECT, NO_COMMIT_PENALTY = 0.5, 0.3, 0.2, 0.2


def format_reward(committed: Column, band: Column, correct: Column, verifiable: Column) -> Column:
    """Weighted score of a commitment; the weight of correctness goes to the commitment where no answer is known; the penalty without one."""
    right = F.when(verifiable, W_COMMIT + W_CORRECT * F.coalesce(correct.cast("double"), F.lit(0.0))).otherwise(W_COMMIT + W_CORRECT)
    return F.when(committed, right + W_BAND * band).otherwise(F.lit(-NO_COMMIT_PENALTY))


def kv_budget(batch: Column | str, max_tokens: Column | str, allowance: int, capacity: int) -> Column:
    return col(batch) * (col(max_tokens) + allowance) <= capacity


def decompose(t0, q0, t1, q1) -> Column:
    """struct(from_termination, from_quality, delta): the change of rate times quality, split into its two parts."""
    t0, q0, t1, q1 = map(col, (t0, q0, t1, q1))
    return F.struct(((t1 - t0) * q0).alias("from_termination"), (t1 * (q1 - q0)).alias("from_quality"), (t1 * q1 - t0 * q0).alias("delta"))


def even_indices(n: Column | str, m: int) -> Column:
    """m evenly spaced places among 0..n-1, both ends included, halves to even, each once; all of them if there are at most m."""
    n = col(n)
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i.cast("double") * (n - 1) / max(1, m - 1), 0).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= m, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(spaced)
