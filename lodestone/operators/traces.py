"""Screens of reasoning traces: one row at a time, and a whole set against its source prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .guards import first_reason

OPEN, CLOSE = "<think>", "</think>"
#: Turn marks of a chat template, list marks, words of a trace about its format, words of one that does not decide, roles of ternary labels.
TURN_MARKS = ("<|im_start|>", "<|im_end|>")
LIST_MARK = r"^\s*(?:[-*•]\s+|\d{1,2}[.)]\s+)"
FORMAT_ECHO = (
    r"(?iU)(<think>|</think>|think(?:ing)? tags?|bullet points?|\bAnswer:\s*[\"'`]|constraint \d|thinking process:|output the (?:thinking|final answer)|inside the [`\"]|"
    r"\bthe user (?:wants|is asking|asks|needs)\b|here (?:are|is) the (?:thought|thinking|bullet))"
)
HEDGE = r"(?i)(depends (largely |entirely )?on|ultimately dictates|is a matter of|personal preference|comes down to|either option)"
UP, DOWN, FLAT = ("MORE", "HIGHER"), ("LESS", "LOWER"), ("SAME", "UNCHANGED")
#: Characters of a broken decode: replacement and control characters, zero-width and direction marks, scripts beyond U+2FFF.
SUSPICIOUS = r"[\x{0000}-\x{0008}\x{000B}-\x{001F}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{3000}-\x{10FFFF}]"
BREAKS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
BLANKS = " \t\n\r\x0b\x0c"

BAND_FLOOR = 32


def _strip(x: Column) -> Column:
    return F.trim(x, F.lit(BLANKS))


def full_lines(x: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(x, BREAKS), lambda s: _strip(s) != "")


def halves(c: Column | str) -> tuple[Column, Column]:
    """What stands before the first closing tag (all without one) and behind it."""
    t = F.coalesce(text.col(c), F.lit(""))
    at = F.instr(t, CLOSE)
    return F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t), F.when(at > 0, F.substring(t, at + len(CLOSE), F.length(t))).otherwise("")


def closes(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(text.col(c), F.lit("")), F.lit(CLOSE))


def has_turn_mark(c: Column | str) -> Column:
    t = F.coalesce(text.col(c), F.lit(""))
    return t.contains(TURN_MARKS[0]) | t.contains(TURN_MARKS[1])


def format_echo(c: Column | str) -> Column:
    """Whether the reasoning speaks of its format or of the request instead of the question."""
    return halves(c)[0].rlike(FORMAT_ECHO)


def suspicious(c: Column | str) -> Column:
    return F.coalesce(text.col(c), F.lit("")).rlike(SUSPICIOUS)


def committed(c: Column | str, labels: Column | str) -> Column:
    """The label of an array that the last line, `Answer: label` and nothing else, names; null without one."""
    found = F.upper(F.regexp_extract(F.coalesce(text.last_line(c), F.lit("")), rf"(?i)^{text.NOISE}Answer:\s*\*{{0,2}}\s*(.+?){text.TAIL}$", 1))
    return F.get(F.filter(text.col(labels), lambda x: F.upper(x) == found), F.lit(0))


def trace_problem(c: Column | str, n_tokens: Column, floor: int = BAND_FLOOR) -> Column:
    """The first reason to drop a trace, null to keep it; n_tokens is the length of its reasoning."""
    lines = full_lines(halves(c)[1])
    last = F.coalesce(_strip(F.get(lines, F.size(lines) - 1)), F.lit(""))
    return first_reason(
        ("template_contamination", has_turn_mark(c)),
        ("think_tag_count", closes(c) != 1),
        ("no_bare_answer_last", ~last.rlike(r"^Answer:\s*\S+$")),
        ("coda_after_think", F.size(lines) > 1),
        ("format_echo", format_echo(c)),
        ("below_band_floor", F.coalesce(n_tokens, F.lit(0)) < floor),
    )


def trace_status(c: Column | str, labels: Column | str, answer: Column | str, verifiable: Column | str, count: Callable[[Column], Column], most: int, least: int = 0, most_coda: int = 0, strip_coda: bool = False) -> Column:
    """struct(status, clean, n_tokens): why a generation is no target, or the text that is one; `count` measures reasoning.

    With strip_coda what stands between the closing tag and the answer line goes instead of the whole generation.
    """
    t = F.coalesce(text.col(c), F.lit(""))
    before, after = halves(t)
    opened = F.ltrim(before)
    reasoning = F.when(opened.startswith(OPEN), F.substring(opened, F.lit(len(OPEN) + 1), F.length(opened))).otherwise(before)
    label = committed(after, labels)
    lines = full_lines(after)
    coda = _strip(F.array_join(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
    n = F.when((closes(t) == 1) & ~has_turn_mark(t), count(reasoning)).otherwise(count(t))
    long = F.length(coda) > most_coda
    key = text.col(answer)
    bad = first_reason(
        ("template_leak", has_turn_mark(t)),
        ("no_close", closes(t) == 0),
        ("meta_echo", closes(t) > 1),
        ("no_commit", label.isNull()),
        ("wrong", F.coalesce(text.col(verifiable), F.lit(False)) & key.isNotNull() & (label != key)),
        ("too_short", n < least),
        ("too_long", n > most),
        *(() if strip_coda else (("coda", long),)),
    )
    whole = F.regexp_replace(t, r"\s+$", "")
    clean = F.when(long, F.concat(before, F.lit(f"{CLOSE}\n\n"), _strip(F.get(lines, F.size(lines) - 1)))).otherwise(whole)
    return F.struct(F.coalesce(bad, F.lit("pass")).alias("status"), F.when(bad.isNull(), clean).alias("clean"), n.alias("n_tokens"))


def chosen_meaning(label: Column, labels: Column | str, prompt: Column | str) -> Column:
    """What a label stands for however it was shown: the role of a ternary one, else the text of its option block in the prompt."""
    role = F.when(label.isin(*UP), "UP").when(label.isin(*DOWN), "DOWN").when(label.isin(*FLAT), "FLAT")
    block = F.call_function("regexp_extract", text.col(prompt), F.concat(F.lit(r"(?ms)^Option \Q"), label, F.lit(r"\E:\s*\n(.+?)(?=\n\s*\n|\z)")), F.lit(1))
    shown = F.lower(_strip(F.regexp_replace(block, r"\s+", " ")))
    return F.when(label.isNull(), None).when(F.size(text.col(labels)) == 3, role).otherwise(F.when(shown != "", shown))


GATES = ("missing_source", "repeated_question", "expected_rows", "contradiction", "wrong_key", "turn_marks", "think_tag_count", "opening_tag", "coda", "no_answer_line", "list_marks", "emphasis", "backticks", "drafted_answer", "thin_reasoning", "suspicious_character", "repeated_completion", "undecided")


def trace_gate(rows: DataFrame, source: DataFrame, expect_rows: int | None = None) -> DataFrame:
    """(gate, n, passed, warning) of all `GATES`: n counts what offends (of expected_rows the training rows); `undecided` only warns.

    rows: record_id, sibling (0 is training, others are spares), labels (array), answer, verifiable, completion; source: unique record_id, content_id, prompt.
    Row checks are one aggregate; questions and completions are aggregated by key with map-side combining, so a hot one is no task of its own.
    """
    known = source.select("record_id", F.col("content_id").alias("_q"), F.col("prompt").alias("_p"), F.lit(True).alias("_known"))
    before, after = halves("completion")
    sentences = F.filter(F.split(_strip(before), r"(?<=[.!?])\s+"), lambda s: _strip(s) != "")
    judged = rows.join(known, "record_id", "left").withColumn("_label", committed("completion", "labels")).withColumn("_meaning", F.when(F.col("_known"), chosen_meaning(F.col("_label"), "labels", "_p")))
    train = F.coalesce(F.col("sibling"), F.lit(0)) == 0
    c = F.coalesce("completion", F.lit(""))
    own = {
        "missing_source": train & F.col("_known").isNull(),
        "expected_rows": train,
        "wrong_key": F.coalesce("verifiable", F.lit(False)) & F.col("answer").isNotNull() & ~F.col("_label").eqNullSafe(F.col("answer")),
        "turn_marks": has_turn_mark("completion"),
        "think_tag_count": closes("completion") != 1,
        "opening_tag": c.contains(OPEN),
        "coda": F.size(full_lines(after)) > 1,
        "no_answer_line": F.col("_label").isNull(),
        "list_marks": F.exists(full_lines(before), lambda x: x.rlike(LIST_MARK)),
        "emphasis": c.contains("**") | c.contains("__"),
        "backticks": c.contains("`"),
        "drafted_answer": before.rlike(r"(?iU)\banswer\s*:"),
        "thin_reasoning": F.length(_strip(before)) < 20,
        "suspicious_character": suspicious("completion"),
        "undecided": F.coalesce(F.get(sentences, F.size(sentences) - 1).rlike(HEDGE), F.lit(False)),
    }
    counted = judged.agg(*(F.count_if(v).alias(k) for k, v in own.items()))
    meaning = F.coalesce("_meaning", F.lit("\0"))
    questions = judged.filter("_known").groupBy("_q").agg(F.count_if(train).alias("n"), F.count("*").alias("all"), (F.min(meaning) != F.max(meaning)).alias("torn"))
    asked = questions.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("repeated_question"), F.count_if(F.col("torn") & (F.col("all") > 1)).alias("contradiction"))
    said = rows.groupBy(F.sha2(c, 256).alias("_h")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_completion"))
    one = counted.join(F.broadcast(asked)).join(F.broadcast(said))  # one row each
    told = lambda g: F.struct(F.lit(g).alias("gate"), F.col(g).alias("n"), ((F.col(g) == expect_rows) if g == "expected_rows" and expect_rows is not None else F.lit(True) if g in ("expected_rows", "undecided") else F.col(g) == 0).alias("passed"), ((F.col(g) > 0) if g == "undecided" else F.lit(False)).alias("warning"))
    return one.select(F.inline(F.array(*map(told, GATES))))
