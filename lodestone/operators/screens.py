"""Screens over rows, chats, tests and whole tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from .guards import first_reason, reasons

MESSAGE_ROLES = ("system", "user", "assistant")

#: Classes of prompts that a cohort leaves out, by pattern (case ignored, over lines).
PROMPT_CLASSES = {"license_text": r"licen[sc]ed? (under|to)", "contact": r"[a-z0-9.]+@[a-z0-9.]+", "markup": r"</?[a-z]+>", "assignment": r"[a-z_]+ = [\"']", "shouting": r"!!\s"}


def screen_cascade(df: DataFrame, rules: list[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """df with `reason`: the first rule that holds, else the mark of kept rows.  Survivors and drops add up to all rows."""
    return df.withColumn("reason", F.coalesce(first_reason(*rules), F.lit(kept)))


def prompt_classes(c: Column | str) -> Column:
    return reasons(*((name, col(c).rlike(f"(?is){p}")) for name, p in PROMPT_CLASSES.items()))


def prompt_classes_sql(c: str) -> str:
    quoted = {k: p.replace("'", "''") for k, p in PROMPT_CLASSES.items()}
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, '(?is){p}') THEN '{k}' END" for k, p in quoted.items()) + "], lambda x: x IS NOT NULL), ',')"


def domain_terms(c: Column | str, terms: list[str]) -> Column:
    """Terms that a text holds: plain words at word boundaries, others anywhere."""
    low = F.lower(col(c))
    found = lambda t: low.rlike(f"(^|[^a-z0-9_]){re.escape(t)}([^a-z0-9_]|$)") if t.isalnum() and not t.isdigit() else F.contains(low, F.lit(t))
    return reasons(*((t, found(t)) for t in terms))


def chats(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) in order of turns."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def message_problems(c: Column | str) -> Column:
    m = col(c)
    return reasons(
        ("too_few", F.size(m) < 2),
        ("role", F.exists(m, lambda x: ~x["role"].isin(*MESSAGE_ROLES))),
        ("empty", F.exists(m, lambda x: F.trim(x["text"]) == "")),
        ("no_user", ~F.exists(m, lambda x: x["role"] == "user")),
        ("last_not_assistant", F.element_at(m, -1)["role"] != "assistant"),
    )


def test_io(tests: DataFrame, least: int) -> DataFrame:
    """Per record: distinct (input, output) pairs, whether one input has two outputs, whether an output is blank, whether there are enough."""
    pairs = tests.select("record_id", "input", "output").distinct()
    same = Window.partitionBy("record_id", "input")
    return pairs.withColumn("_k", F.count("*").over(same)).groupBy("record_id").agg(F.count("*").alias("n_unique"), (F.max("_k") > 1).alias("conflict"), F.bool_or(F.trim("output") == "").alias("blank"), (F.count("*") >= least).alias("enough"))


def canonicalize_tests(tests: DataFrame, least: int) -> DataFrame:
    """test_io with the sorted reasons why a record can't stay."""
    why = reasons(("blank_output", F.col("blank")), ("conflicting_outputs", F.col("conflict")), ("too_few_tests", ~F.col("enough")))
    return test_io(tests, least).withColumn("reasons", F.array_sort(why))


def set_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(gate, passed) of aggregates over the whole table, in one pass."""
    one = df.agg(*(c.alias(k) for k, c in checks.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).alias("passed")) for k in checks))))


def level_filter(targets: DataFrame, levels: list[str], primary: str, full: Column) -> DataFrame:
    """Each target with each level: the primary one for all, the others only where `full` holds."""
    return targets.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).filter((F.col("level") == primary) | full)


def analysis_tier(primary: Column, secondary: Column) -> Column:
    return F.when(primary, "primary").when(secondary, "secondary").otherwise("exploratory")
