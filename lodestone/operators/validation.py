"""Checks of data sets before they are used: chat examples, distilled answers, generation caches, cells of written portraits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FENCE, col, normalize_ws
from .guards import reasons
from .matching import snippet_overlap
from .screens import MESSAGE_ROLES

#: Fields every example has, splits that there are, the schema and the placeholder of distilled rows, and what their answers look like.
REQUIRED = ("id", "intervention_id", "language_id", "license", "messages", "source", "split", "task")
SPLITS = ("pool", "train", "validation")
DISTILL_SCHEMA, PLACEHOLDER = "sft_distill_v1", "REPLACE-WITH-REAL-TEACHER-MODEL-ID"
FENCED_PYTHON = rf"(?s)\A\s*{FENCE}python\n.*?\n?{FENCE}\s*\z"


def filled(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c), F.lit(" \t\n\r\x0b\x0c")) != "", F.lit(False))


def message_errors(c: Column | str) -> Column:
    """Of an array of struct(role, content): too few messages, else wrong roles, blank contents, no user, an end that is no assistant's."""
    m = col(c)
    few = F.coalesce(F.size(m), F.lit(0)) < 2
    later = reasons(
        ("role", F.exists(m, lambda x: ~F.coalesce(x["role"].isin(*MESSAGE_ROLES), F.lit(False)))),
        ("content", F.exists(m, lambda x: ~filled(x["content"]))),
        ("no_user", ~F.exists(m, lambda x: F.coalesce(x["role"] == "user", F.lit(False)))),
        ("last_not_assistant", ~F.coalesce(F.get(m, F.size(m) - 1)["role"] == "assistant", F.lit(False))),
    )
    return F.when(few, F.array(F.lit("too_few"))).otherwise(later)


def _later(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """rows with whether an earlier line has the same key: the first line of each key comes from an aggregate, not from a window over a hot key."""
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min("line_no").alias("_first"))
    return keyed.join(first.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k"))).withColumn(name, F.col("line_no") > F.col("_first")).drop("_key", "_k", "_first")


def dataset_problems(rows: DataFrame, constants: dict[str, str], split: str, snippets: DataFrame, snippet_key: str) -> DataFrame:
    """(line_no, problems) of every example of a file, line_no unique.

    A row that lacks required fields (null) is told those and takes no part in the rest.  Else: an id or a normalised user prompt that an earlier line has,
    constants of the file, its split, blank source or license, its messages, and whether it holds a snippet of 25 characters or more.
    """
    fields = [F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in REQUIRED]
    missing = F.array_compact(F.array(*fields))
    lacking = rows.filter(F.size(missing) > 0).select("line_no", missing.alias("problems"))
    whole = rows.filter(F.size(missing) == 0)
    said = F.transform("messages", lambda x: F.coalesce(x["content"], F.lit("")))
    asked = F.transform(F.filter("messages", lambda x: F.coalesce(x["role"] == "user", F.lit(False))), lambda x: F.coalesce(x["content"], F.lit("")))
    whole = _later(_later(whole, F.col("id"), "_same_id"), F.sha2(normalize_ws(F.array_join(asked, "\n")), 256), "_same_prompt")
    copied = snippet_overlap(whole.select("line_no", F.array_join(said, "\n").alias("text")), "line_no", snippets, snippet_key).select("line_no").distinct().withColumn("_copied", F.lit(True))
    whole = whole.join(copied, "line_no", "left")
    own = reasons(
        ("duplicate_id", F.col("_same_id")),
        *((f"constant_{k}", F.col(k) != v) for k, v in constants.items()),
        ("split", F.col("split") != split),
        ("unknown_split", ~F.col("split").isin(*SPLITS)),
        ("source", ~filled("source")),
        ("license", ~filled("license")),
    )
    end = reasons(("duplicate_prompt", F.col("_same_prompt")), ("copied_snippet", F.col("_copied")))
    return lacking.union(whole.select("line_no", F.concat(own, message_errors("messages"), end).alias("problems")))


def distill_problems(rows: DataFrame, source: DataFrame) -> DataFrame:
    """(line_no, problems) of distilled rows against their source (unique record_id, dataset_id, expected user text); line_no unique.

    Rows: line_no, schema, mock_note, record_id, dataset_id, teacher_model, teacher_pass_rate, messages.  Without a record_id, without a source row and
    without two messages the later checks have nothing to look at and are left out.
    """
    named = filled("record_id")
    known = source.select("record_id", F.col("dataset_id").alias("_set"), F.col("expected").alias("_want"), F.lit(True).alias("_known"))
    judged = _later(rows, F.when(named, F.col("record_id")).otherwise(F.concat(F.lit("\0"), F.col("line_no"))), "_same_id").join(known, "record_id", "left")
    here = named & F.coalesce("_known", F.lit(False))
    first, second = F.get("messages", F.lit(0)), F.get("messages", F.lit(1))
    two = here & (F.coalesce(F.size("messages"), F.lit(0)) == 2)
    why = reasons(
        ("schema", ~F.col("schema").eqNullSafe(F.lit(DISTILL_SCHEMA))),
        ("mock_note", F.col("mock_note").isNotNull()),
        ("record_id", ~named),
        ("duplicate_id", F.col("_same_id")),
        ("not_in_source", named & ~here),
        ("dataset_id", here & ~F.col("dataset_id").eqNullSafe(F.col("_set"))),
        ("teacher_model", here & (~F.coalesce(F.col("teacher_model") != "", F.lit(False)) | F.col("teacher_model").eqNullSafe(F.lit(PLACEHOLDER)))),
        ("pass_rate", here & ~F.col("teacher_pass_rate").eqNullSafe(F.lit(1.0))),
        ("messages", here & ~two),
        ("roles", two & ~(first["role"].eqNullSafe(F.lit("user")) & second["role"].eqNullSafe(F.lit("assistant")))),
        ("user_text", two & ~first["content"].eqNullSafe(F.col("_want"))),
        ("fence", two & ~F.coalesce(second["content"].rlike(FENCED_PYTHON), F.lit(False))),
    )
    return judged.select("line_no", why.alias("problems"))


CACHE_CHECKS = {"missing": True, "extra": False, "all_empty": True, "wrong_lengths": True, "bad_prompt": True, "bad_shape": True, "little_code": False}


def cache_preflight(records: DataFrame, expected: DataFrame, k: int, fence: str) -> DataFrame:
    """(problem, n, blocking, passed) of a cache of generations (question_id, prompt, output_list, code_list) against the expected question_ids.

    missing and extra ids, entries without any output, lists that are not k long, prompts that are no JSON list of messages with a user,
    code whose output is not exactly one fenced block, and (n = 1) code for less than half of the entries.  Extra entries take no part in the rest.
    A repeated question_id counts as one entry, the last of it in order of its texts.
    """
    one = records.groupBy("question_id").agg(F.max(F.struct("prompt", "output_list", "code_list")).alias("x")).select("question_id", "x.*")
    want = expected.select("question_id").distinct().withColumn("_want", F.lit(True))
    both = one.withColumn("_have", F.lit(True)).join(want, "question_id", "full")
    here = F.coalesce(F.col("_have") & F.col("_want"), F.lit(False))
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    outputs, codes = texts(F.col("output_list")), texts(F.col("code_list"))
    some = lambda xs: F.exists(xs, filled)
    messages = F.from_json("prompt", "array<struct<role:string>>")
    listed = F.coalesce(F.ltrim("prompt").startswith("[") & messages.isNotNull(), F.lit(False))
    asked = listed & F.coalesce(F.exists(messages, lambda m: F.coalesce(m["role"] == "user", F.lit(False))), F.lit(False))
    exact = lambda t: F.coalesce(t, F.lit("")).rlike(rf"\A\s*{FENCE}{re.escape(fence)}[ \t]*\r?\n(?:(?!{FENCE})[\s\S])+{FENCE}\s*\z")
    shapes = F.size(F.filter(F.arrays_zip(outputs.alias("o"), codes.alias("c")), lambda z: filled(z["c"]) & z["o"].isNotNull() & ~exact(z["o"])))
    counts = both.agg(
        F.count_if(F.col("_have").isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("extra"),
        F.count_if(here & ~some(outputs)).alias("all_empty"),
        F.count_if(here & ((F.size(outputs) != k) | (F.size(codes) != k))).alias("wrong_lengths"),
        F.count_if(here & ~asked).alias("bad_prompt"),
        F.coalesce(F.sum(F.when(here, shapes)), F.lit(0)).alias("bad_shape"),
        (F.count_if(here & some(codes)) < 0.5 * F.count("_have")).cast("bigint").alias("little_code"),
    )
    rows = [F.struct(F.lit(p).alias("problem"), F.col(p).alias("n"), F.lit(b).alias("blocking"), ((F.col(p) == 0) | F.lit(not b)).alias("passed")) for p, b in CACHE_CHECKS.items()]
    return counts.select(F.inline(F.array(*rows)))


#: Names that a portrait of a value must not use, verbs that name one, the length of a continuation, the sets of a cell.
LABEL_WORDS = {
    "Self-Direction": ["self-direction", "independence", "autonomy"],
    "Security": ["security"],
    "Stimulation": ["stimulation"],
    "Conformity": ["conformity", "obedience", "compliance"],
    "Hedonism": ["hedonism", "gratification", "indulgence"],
    "Tradition": ["tradition", "elder", "elders"],
    "Achievement": ["achievement"],
    "Benevolence": ["benevolence"],
    "Power": ["power", "dominance"],
    "Universalism": ["universalism"],
}
NAMING = r"(?iU)\byou (value|prize|cherish|care about|believe in|are driven by|are motivated by|are guided by|prioritize)\b"
SHORTEST, LONGEST, SETS = 120, 150, 3


def cell_problems(value: Column | str, sets: Column | str) -> Column:
    """Of a cell's continuations: their number, and by set what is blank, left to do, out of the length band, without its lead, names the value or uses a label of it."""
    v, xs = col(value), F.coalesce(col(sets), F.array().cast("array<string>"))
    stripped = F.transform(xs, lambda x: F.trim(F.coalesce(x, F.lit("")), F.lit(" \t\n\r\x0b\x0c")))

    def of_set(x: Column, i: Column) -> Column:
        tag = lambda what: F.concat(F.lit("set"), (i + 1).cast("string"), F.lit(f" {what}"))
        labels = [F.when((v == name) & x.rlike(rf"(?iU)\b{re.escape(w)}\b"), tag(f"label {w}")) for name, words in LABEL_WORDS.items() for w in words]
        return F.array_compact(
            F.array(
                F.when(x == "", tag("empty")),
                F.when(x.contains("TODO"), tag("todo")),
                F.when(~F.length(x).between(SHORTEST, LONGEST), tag("length")),
                F.when(~x.rlike(r"(?iU)^you\b"), tag("lead")),
                F.when(x.rlike(NAMING), tag("naming")),
                *labels,
            )
        )

    return F.concat(F.array_compact(F.array(F.when(F.size(xs) != SETS, F.lit("sets")))), F.flatten(F.transform(stripped, of_set)))
