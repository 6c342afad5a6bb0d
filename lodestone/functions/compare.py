"""Comparison of a captured output with the expected one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda x: x != "")


def lines(c: Column | str) -> Column:
    """Lines, however they are ended, without white space at their ends, and without empty ones at the end of the text."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+$", "")
    return F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))


def out_tokens(got: Column | str, want: Column | str) -> Column:
    return tokens(got) == tokens(want)


def out_exact_lines(got: Column | str, want: Column | str) -> Column:
    return lines(got) == lines(want)


def out_ci_tokens(got: Column | str, want: Column | str) -> Column:
    return tokens(F.lower(col(got))) == tokens(F.lower(col(want)))


def close(x: Column, y: Column, rel: float = 1e-6, absolute: float = 1e-6) -> Column:
    return F.abs(x - y) <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs(x), F.abs(y)))


NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


def out_float_tokens(got: Column | str, want: Column | str) -> Column:
    """Token by token: two numbers must be finite and within 1e-6, anything else must be equal."""
    a, b = tokens(got), tokens(want)
    number = lambda x: x.rlike(NUMBER) | x.rlike(NOT_FINITE)
    near = lambda x, y: F.coalesce(~x.rlike(NOT_FINITE) & ~y.rlike(NOT_FINITE) & close(x.try_cast("double"), y.try_cast("double")), F.lit(False))
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.when(number(x) & number(y), near(x, y)).otherwise(x == y)), lambda t: t)


def line_equal(x: Column, y: Column, tolerance: str = "0.00001") -> Column:
    """Equal lines; true and false with or without a capital; or as many decimals, each within the tolerance."""
    flags = (x.isin("True", "true") & y.isin("True", "true")) | (x.isin("False", "false") & y.isin("False", "false"))
    a, b = tokens(x), tokens(y)
    near = F.forall(F.zip_with(a, b, lambda p, q: F.coalesce(F.abs(p.try_cast("decimal(38,18)") - q.try_cast("decimal(38,18)")) <= F.lit(tolerance).cast("decimal(38,18)"), F.lit(False))), lambda t: t)
    return (x == y) | flags | ((F.size(a) > 0) & (F.size(a) == F.size(b)) & near)


def out_lcb(got: Column | str, want: Column | str) -> Column:
    """Line by line, after trimming: the counts and every line must agree."""
    cut = lambda c: F.transform(F.split(F.trim(F.coalesce(col(c), F.lit("")), F.lit(" \n\t\r")), "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    a, b = cut(got), cut(want)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: line_equal(x, y)), lambda t: t)


def prefix_to_first_failure(passed: Column | str) -> Column:
    """Results up to the first false one, which is kept."""
    p = col(passed)
    first = F.array_position(p, F.lit(False)).cast("int")
    return F.when(first > 0, F.slice(p, F.lit(1), first)).otherwise(p)


def pass_fraction(passed: Column | str) -> Column:
    """Share of true ones; null without any."""
    p = col(passed)
    return F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(p))


def screen_then_full(screen: Column | str, full: Column | str) -> Column:
    return F.when(col(screen) == 1.0, col(full))


#: How a runtime says that memory ran out.
NO_MEMORY = r"OutOfMemoryException|OutOfMemoryError|out of memory|FatalProcessOutOfMemory|memory allocation .*? failed"


def run_status(exit_code: Column | str, stderr: Column | str) -> Column:
    """How a run ended, by its error output first and its exit code then."""
    err, code = F.coalesce(col(stderr), F.lit("")), col(exit_code)
    named = F.when(err.contains("SyntaxError"), "SyntaxError").when(err.contains("ValueError"), "ValueError").when(err.contains("TimeoutExpired"), "TimeoutExpired").when(err.rlike(NO_MEMORY), "OutOfMemory")
    return F.coalesce(named, F.when(code.isNull(), "AbnormalTermination").when(code != 0, "Exception").otherwise("Done"))


def build_status(exit_code: Column | str, stderr: Column | str) -> Column:
    err, code = F.coalesce(col(stderr), F.lit("")), col(exit_code)
    named = F.when(err.contains("what():  Resource temporarily unavailable"), "OutOfMemory").when(err.contains("TimeoutExpired"), "BuildTimeOut")
    return F.coalesce(named, F.when(code.isNull(), "BuildFailed").when(code != 0, "SyntaxError").otherwise("BuildDone"))
