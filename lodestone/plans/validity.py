"""Trace screens and checks of data sets, over whole texts with every defect planted in some rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators import traces, validation
from ..tables import derived, load, oracle

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BREAKS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_ECHO = r"""(?i)(<think>|</think>|think(?:ing)? tags?|bullet points?|\bAnswer:\s*["''`]|constraint \d|thinking process:|output the (?:thinking|final answer)|inside the [`"]|\bthe user (?:wants|is asking|asks|needs)\b|here (?:are|is) the (?:thought|thinking|bullet))"""


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _listed(cases: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cases) + "], lambda x: x IS NOT NULL)"


# Parts of a trace: what stands before and behind the first closing tag, its lines, its last line's label.
_PARTS = f"""t AS (SELECT * REPLACE (coalesce(completion, '') AS completion), string_split(labels, ',') AS known, strpos(coalesce(completion, ''), '</think>') AS shut, (length(coalesce(completion, '')) - length(replace(coalesce(completion, ''), '</think>', ''))) // 8 AS closes FROM traces),
p AS (SELECT *, CASE WHEN shut > 0 THEN substr(completion, 1, shut - 1) ELSE completion END AS head, CASE WHEN shut > 0 THEN substr(completion, shut + 8) ELSE '' END AS after FROM t),
l AS (SELECT *, list_filter(regexp_split_to_array(after, '{_BREAKS}'), lambda x: {_strip('x')} <> '') AS lines, list_filter(regexp_split_to_array(head, '{_BREAKS}'), lambda x: {_strip('x')} <> '') AS thoughts,
  len(list_filter(regexp_split_to_array(head, '\\s+'), lambda x: x <> '')) AS n_head, len(list_filter(regexp_split_to_array(completion, '\\s+'), lambda x: x <> '')) AS n_all, contains(completion, '<|im_start|>') OR contains(completion, '<|im_end|>') AS marked FROM p),
-- the label a line commits to, of the whole completion (whole_label) and of what stands behind the tag (label_after)
c AS (SELECT *, list_filter(known, lambda k: regexp_full_match(coalesce(list_filter(string_split(replace(completion, chr(13), ''), chr(10)), lambda x: trim(x) <> '')[-1], ''), '(?i)[ \\t>*_"''`#-]*Answer:\\s*\\*?\\*?\\s*' || k || '[ \\t.,;:!?*_"''`)\\]]*'))[1] AS whole_label,
  list_filter(known, lambda k: regexp_full_match(coalesce(list_filter(string_split(replace(after, chr(13), ''), chr(10)), lambda x: trim(x) <> '')[-1], ''), '(?i)[ \\t>*_"''`#-]*Answer:\\s*\\*?\\*?\\s*' || k || '[ \\t.,;:!?*_"''`)\\]]*'))[1] AS label_after FROM l)"""


def _traces(spark, sf_dir):
    return derived(spark, sf_dir, "traces").withColumn("labels", F.split("labels", ","))


_PROBLEM = f"CASE WHEN marked THEN 'template_contamination' WHEN closes <> 1 THEN 'think_tag_count' WHEN NOT regexp_full_match(coalesce({_strip('lines[-1]')}, ''), 'Answer:\\s*\\S+') THEN 'no_bare_answer_last' WHEN len(lines) > 1 THEN 'coda_after_think' WHEN regexp_matches(head, '{_ECHO}') THEN 'format_echo' WHEN n_head < 32 THEN 'below_band_floor' ELSE 'kept' END"


@query("trace_classify", oracle(f"WITH {_PARTS} SELECT record_id, {_PROBLEM} AS reason FROM c"))
def _(spark, sf_dir):
    why = traces.trace_problem("completion", text.word_count(traces.halves("completion")[0]))
    return _traces(spark, sf_dir).select("record_id", F.coalesce(why, F.lit("kept")).alias("reason"))


def _status_sql(strip_coda: bool) -> str:
    coda = _strip("array_to_string(lines[:-2], chr(10))")
    opened = "regexp_replace(head, '^ *<think>', '')"
    n = f"CASE WHEN closes = 1 AND NOT marked THEN len(list_filter(regexp_split_to_array({opened}, '\\s+'), lambda x: x <> '')) ELSE n_all END"
    status = f"CASE WHEN marked THEN 'template_leak' WHEN closes = 0 THEN 'no_close' WHEN closes > 1 THEN 'meta_echo' WHEN label_after IS NULL THEN 'no_commit' WHEN verifiable AND answer IS NOT NULL AND label_after <> answer THEN 'wrong' WHEN n < 8 THEN 'too_short' WHEN n > 1200 THEN 'too_long' " + ("" if strip_coda else "WHEN length(coda) > 0 THEN 'coda' ") + "ELSE 'pass' END"
    clean = f"CASE WHEN length(coda) > 0 THEN head || '</think>' || chr(10) || chr(10) || {_strip('lines[-1]')} ELSE regexp_replace(completion, '\\s+$', '') END"
    return f"WITH {_PARTS}, n AS (SELECT *, CAST({n} AS BIGINT) AS n, {coda} AS coda FROM c), s AS (SELECT *, {status} AS status FROM n) SELECT record_id, status, n AS n_tokens, CASE WHEN status = 'pass' THEN md5({clean}) END AS clean FROM s"


for _name, _salvage in (("trace_status", False), ("trace_status_salvaged", True)):

    @query(_name, oracle(_status_sql(_salvage)))
    def _(spark, sf_dir, salvage=_salvage):
        s = traces.trace_status("completion", "labels", "answer", "verifiable", text.word_count, 1200, 8, strip_coda=salvage)
        return _traces(spark, sf_dir).select("record_id", s.alias("s")).select("record_id", "s.status", "s.n_tokens", F.md5(F.col("s.clean").cast("binary")).alias("clean"))


_ROW_GATES = {
    "wrong_key": "verifiable AND answer IS NOT NULL AND whole_label IS DISTINCT FROM answer",
    "turn_marks": "marked",
    "think_tag_count": "closes <> 1",
    "opening_tag": "contains(completion, '<think>')",
    "coda": "len(lines) > 1",
    "no_answer_line": "whole_label IS NULL",
    "list_marks": "len(list_filter(thoughts, lambda x: regexp_matches(x, '^\\s*(?:[-*•]\\s+|\\d{1,2}[.)]\\s+)'))) > 0",
    "emphasis": "contains(completion, '**') OR contains(completion, '__')",
    "backticks": "contains(completion, '`')",
    "drafted_answer": "regexp_matches(head, '(?i)(^|[^\\p{L}\\p{N}_])answer\\s*:')",
    "thin_reasoning": f"length({_strip('head')}) < 20",
    "suspicious_character": r"regexp_matches(completion, '[\x{0001}-\x{0008}\x{000B}-\x{001F}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{3000}-\x{10FFFF}]')",
    "undecided": r"regexp_matches(coalesce(list_filter(string_split(regexp_replace(" + _strip("head") + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: " + _strip("x") + r" <> '')[-1], ''), '(?i)(depends (largely |entirely )?on|ultimately dictates|is a matter of|personal preference|comes down to|either option)')",
}
_GATE_ROWS = " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER ({c}) AS n, {'true' if g == 'undecided' else f'count(*) FILTER ({c}) = 0'} AS passed, {f'count(*) FILTER ({c}) > 0' if g == 'undecided' else 'false'} AS warning FROM c" for g, c in _ROW_GATES.items())


@query("trace_gate", oracle(f"""WITH {_PARTS}, q AS (SELECT *, record_id % 100 <> 98 AS present, CASE WHEN whole_label IS NULL THEN '?' WHEN len(known) = 3 THEN CASE WHEN whole_label IN ('MORE', 'HIGHER') THEN 'UP' WHEN whole_label IN ('LESS', 'LOWER') THEN 'DOWN' ELSE 'FLAT' END
  ELSE lower(trim(regexp_replace(split_part(split_part(prompt, 'Option ' || whole_label || ':' || chr(10), 2), chr(10), 1), '\\s+', ' ', 'g'))) END AS meaning FROM c),
g AS (SELECT content_id, count(*) FILTER (sibling = 0) AS n, count(*) AS a, count(DISTINCT meaning) AS m FROM q WHERE present GROUP BY content_id)
SELECT 'missing_source' AS gate, count(*) FILTER (sibling = 0 AND NOT present) AS n, count(*) FILTER (sibling = 0 AND NOT present) = 0 AS passed, false AS warning FROM q
UNION ALL SELECT 'repeated_question', CAST(coalesce(sum(greatest(n - 1, 0)), 0) AS BIGINT), coalesce(sum(greatest(n - 1, 0)), 0) = 0, false FROM g
UNION ALL SELECT 'expected_rows', count(*) FILTER (sibling = 0), count(*) FILTER (sibling = 0) = 500, false FROM q
UNION ALL SELECT 'contradiction', count(*) FILTER (a > 1 AND m > 1), count(*) FILTER (a > 1 AND m > 1) = 0, false FROM g
UNION ALL SELECT 'repeated_completion', count(*), count(*) = 0, false FROM (SELECT completion FROM c GROUP BY completion HAVING count(*) > 1)
UNION ALL {_GATE_ROWS}"""))
def _(spark, sf_dir):
    rows = _traces(spark, sf_dir)
    source = rows.select(F.when(F.col("record_id") % 100 == 98, -1 - F.col("record_id")).otherwise(F.col("record_id")).alias("record_id"), "content_id", "prompt")  # some rows have no source
    return traces.trace_gate(rows.drop("content_id", "prompt", "label"), source, 500)


@query("format_echo", oracle(f"WITH {_PARTS} SELECT record_id, regexp_matches(head, '{_ECHO}') AS echo FROM c"))
def _(spark, sf_dir):
    return _traces(spark, sf_dir).select("record_id", traces.format_echo("completion").alias("echo"))


@query("suspicious_char", r"SELECT doc_id, regexp_matches(text, '[\x{0001}-\x{0008}\x{000B}-\x{001F}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{3000}-\x{10FFFF}]') AS suspicious FROM documents")
def _(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", traces.suspicious("text").alias("suspicious"))


# First person and refusals: pronouns are counted as words between characters that are none.
@query("first_person_min", oracle(r"SELECT conv_id, turn, hits FROM (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda w: list_contains(['i', 'im', 'my', 'me', 'mine', 'myself', 'we', 'our', 'us'], w))) AS hits FROM told) WHERE hits >= 3"))
def _(spark, sf_dir):
    return derived(spark, sf_dir, "told").select("conv_id", "turn", text.first_person_hits("text").alias("hits")).filter("hits >= 3")


@query("refusal_filter", oracle(f"SELECT conv_id, turn, regexp_matches({_strip('text')}, '^(?i)i\\s*(''m|am)?\\s*(sorry[,.]?\\s*)?(but\\s+)?(cannot|can''t|can not|won''t|will not|am not able to|''m not able to)([^a-z0-9_]|$)') AS refused FROM told"))
def _(spark, sf_dir):
    return derived(spark, sf_dir, "told").select("conv_id", "turn", text.refuses("text").alias("refused"))


_WORDS = r"list_filter(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z'']+')), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w))"
_NAMES = "list_filter(['A', 'B'], lambda k: regexp_matches({}, '(^|[^A-Za-z0-9_])' || k || '([^A-Za-z0-9_]|$)'))"
_RECOVERED = f"""WITH t AS (SELECT rid, trim(coalesce(raw, ''), ' ' || chr(10) || chr(9) || chr(13)) AS raw, {_WORDS.format('first')} AS a, {_WORDS.format('second')} AS b FROM drafts),
w AS (SELECT *, list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '') AS ws, trim(list_filter(string_split(replace(raw, chr(13), ''), chr(10)), lambda x: trim(x) <> '')[-1]) AS tail, {_NAMES.format('raw')} AS named, {_WORDS.format('raw')} AS body,
  list_filter(string_split(regexp_replace(raw, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')[-1] AS closing FROM t),
g AS (SELECT *, {_NAMES.format('closing')} AS ends, {_NAMES.format('tail')} AS bare, upper(regexp_extract(tail, '^(?i)[\\s>*_#`\\-]*(?:answer|final answer|choice)\\s*[:\\-]?\\s*\\**\\s*([AB])\\b', 1)) AS dressed,
  len(list_filter(body, lambda x: list_contains(a, x) AND NOT list_contains(b, x))) - len(list_filter(body, lambda x: list_contains(b, x) AND NOT list_contains(a, x))) AS gap FROM w),
r AS (SELECT *, CASE WHEN raw = '' THEN 'empty' WHEN contains(raw, '<think>') THEN 'has_think' WHEN len(ws) >= 40 AND len(list_distinct(ws)) / len(ws) < 0.35 THEN 'degenerate_loop' WHEN NOT regexp_matches(raw, '[.!?"'')\\]]\\s*$') THEN 'truncated'
  WHEN regexp_matches(raw, '(?i)(answer\\s*[:\\-]?\\s*["''`]?A["''`]?\\s*(?:or|/|,)\\s*["''`]?(?:answer\\s*[:\\-]?\\s*)?B)|(on (?:its|your) own line)|(exactly as)') THEN 'instruction_echo'
  WHEN coalesce(dressed, '') <> '' THEN 'terminal_label' WHEN length(tail) <= 4 AND len(bare) = 1 THEN 'terminal_short' WHEN len(named) = 1 THEN 'single_label' WHEN len(named) = 2 THEN CASE WHEN len(ends) = 1 THEN 'terminal_endorse' ELSE 'ambiguous' END
  WHEN abs(gap) < 3 THEN 'semantic_below_margin' ELSE 'semantic' END AS tier FROM g)
SELECT rid, replace(tier, 'terminal_short', 'terminal_label') AS tier, CASE tier WHEN 'terminal_label' THEN dressed WHEN 'terminal_short' THEN bare[1] WHEN 'single_label' THEN named[1] WHEN 'terminal_endorse' THEN ends[1] WHEN 'semantic' THEN CASE WHEN gap > 0 THEN 'A' ELSE 'B' END END AS label FROM r"""


@query("recover_tier", oracle(_RECOVERED))
def _(spark, sf_dir):
    return derived(spark, sf_dir, "drafts").select("rid", text.recover("raw", True, "first", "second").alias("x")).select("rid", "x.*")


# Data sets.
def _examples(spark, sf_dir):
    turns = derived(spark, sf_dir, "example_turns").groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    return derived(spark, sf_dir, "example_heads").join(turns.select("line_no", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")), "line_no")


CONSTANTS = {"intervention_id": "style", "task": "coding", "language_id": "rust"}
_EXAMPLE_CASES = [
    ("duplicate_id", "line_no > first_id"), *((f"constant_{k}", f"{k} <> '{v}'") for k, v in CONSTANTS.items()), ("split", "split <> 'train'"), ("unknown_split", "split NOT IN ('pool', 'train', 'validation')"), ("source", "trim(source) = ''"), ("license", "trim(license) = ''"),
    ("too_few", "len(m) < 2"), ("role", "len(m) >= 2 AND len(list_filter(m, lambda x: x.role NOT IN ('system', 'user', 'assistant'))) > 0"), ("content", "len(m) >= 2 AND len(list_filter(m, lambda x: trim(x.content) = '')) > 0"),
    ("no_user", "len(m) >= 2 AND len(list_filter(m, lambda x: x.role = 'user')) = 0"), ("last_not_assistant", "len(m) >= 2 AND m[-1].role <> 'assistant'"), ("duplicate_prompt", "line_no > first_prompt"), ("copied_snippet", "copied"),
]


@query("dataset_valid", oracle(f"""WITH g AS (SELECT line_no, list({{'role': role, 'content': content}} ORDER BY turn) AS m, string_agg(content, chr(10) ORDER BY turn) AS said, coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS asked FROM example_turns GROUP BY line_no),
e AS (SELECT *, lower(trim(regexp_replace(asked, '\\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(said, '\\s+', ' ', 'g'))) AS s FROM example_heads JOIN g USING (line_no)),
w AS (SELECT *, min(line_no) OVER (PARTITION BY id) AS first_id, min(line_no) OVER (PARTITION BY q) AS first_prompt, EXISTS (SELECT 1 FROM benchmark WHERE length(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) >= 25 AND contains(s, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))) AS copied FROM e WHERE id IS NOT NULL AND license IS NOT NULL)
SELECT line_no, array_to_string({_listed([('missing id', 'id IS NULL'), ('missing license', 'license IS NULL')])}, ',') AS problems FROM e WHERE id IS NULL OR license IS NULL
UNION ALL SELECT line_no, array_to_string({_listed(_EXAMPLE_CASES)}, ',') FROM w"""))
def _(spark, sf_dir):
    found = validation.dataset_problems(_examples(spark, sf_dir), CONSTANTS, "train", load(spark, sf_dir, "benchmark"), "item_id")
    return found.select("line_no", F.array_join("problems", ",").alias("problems"))


_DISTILL_CASES = [
    ("schema", "schema <> 'sft_distill_v1'"), ("mock_note", "mock_note IS NOT NULL"), ("record_id", "record_id = ''"), ("duplicate_id", "record_id <> '' AND line_no > first"), ("not_in_source", "record_id <> '' AND expected IS NULL"), ("dataset_id", "expected IS NOT NULL AND dataset_id <> 'set'"),
    ("teacher_model", "expected IS NOT NULL AND teacher_model IN ('', 'REPLACE-WITH-REAL-TEACHER-MODEL-ID')"), ("pass_rate", "expected IS NOT NULL AND teacher_pass_rate <> 1"), ("messages", "expected IS NOT NULL AND n_messages <> 2"), ("roles", "expected IS NOT NULL AND n_messages = 2 AND first_role <> 'user'"),
    ("user_text", "expected IS NOT NULL AND n_messages = 2 AND asked <> expected"), ("fence", "expected IS NOT NULL AND n_messages = 2 AND NOT regexp_matches(answer, '(?s)\\A\\s*```python\\n.*?\\n?```\\s*\\z')"),
]


@query("distill_valid", oracle(f"WITH w AS (SELECT d.*, s.expected, min(line_no) OVER (PARTITION BY d.record_id) AS first FROM distilled d LEFT JOIN distill_source s ON d.record_id = s.record_id) SELECT line_no, array_to_string({_listed(_DISTILL_CASES)}, ',') AS problems FROM w"))
def _(spark, sf_dir):
    d = derived(spark, sf_dir, "distilled")
    user, assistant = F.struct(F.col("first_role").alias("role"), F.col("asked").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    rows = d.withColumn("messages", F.when(F.col("n_messages") == 1, F.array(user)).when(F.col("n_messages") == 3, F.array(user, assistant, user)).otherwise(F.array(user, assistant)))
    found = validation.distill_problems(rows.withColumn("teacher_pass_rate", F.col("teacher_pass_rate").cast("double")), derived(spark, sf_dir, "distill_source"))
    return found.select("line_no", F.array_join("problems", ",").alias("problems"))


_SHAPE = "regexp_full_match(output, '\\s*```go[ \\t]*\\r?\\n[\\s\\S]+```\\s*') AND (length(output) - length(replace(output, '```', ''))) // 3 = 2"


@query("cache_preflight", oracle(f"""WITH h AS (SELECT cache.* FROM cache JOIN cache_questions USING (question_id)), n AS (SELECT (SELECT count(*) FROM cache_questions ANTI JOIN cache USING (question_id)) AS missing, (SELECT count(*) FROM cache ANTI JOIN cache_questions USING (question_id)) AS extra,
  (SELECT count(*) FROM h WHERE trim(output) = '') AS all_empty, (SELECT count(*) FROM h WHERE n_out <> 2 OR n_code <> 2) AS wrong_lengths, (SELECT count(*) FROM h WHERE prompt IS NULL OR NOT (starts_with(prompt, '[') AND contains(prompt, '"user"'))) AS bad_prompt,
  (SELECT CAST(coalesce(sum(least(n_out, n_code)), 0) AS BIGINT) FROM h WHERE trim(code, {_BLANKS}) <> '' AND NOT ({_SHAPE})) AS bad_shape, CAST((SELECT count(*) FROM h WHERE trim(code, {_BLANKS}) <> '') < 0.5 * (SELECT count(*) FROM cache) AS BIGINT) AS little_code)
SELECT 'missing' AS problem, missing AS n, true AS blocking, missing = 0 AS passed FROM n UNION ALL SELECT 'extra', extra, false, true FROM n UNION ALL SELECT 'all_empty', all_empty, true, all_empty = 0 FROM n UNION ALL SELECT 'wrong_lengths', wrong_lengths, true, wrong_lengths = 0 FROM n
UNION ALL SELECT 'bad_prompt', bad_prompt, true, bad_prompt = 0 FROM n UNION ALL SELECT 'bad_shape', bad_shape, true, bad_shape = 0 FROM n UNION ALL SELECT 'little_code', little_code, false, true FROM n"""))
def _(spark, sf_dir):
    c = derived(spark, sf_dir, "cache")
    records = c.select("question_id", "prompt", F.array_repeat("output", F.col("n_out")).alias("output_list"), F.array_repeat("code", F.col("n_code")).alias("code_list"))
    return validation.cache_preflight(records, derived(spark, sf_dir, "cache_questions"), 2, "go")


def _cell_sql() -> str:
    x = "trim(coalesce(s, ''), " + _BLANKS + ")"
    word = lambda w: f"regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)')"
    cases = [("empty", f"{x} = ''"), ("todo", f"contains({x}, 'TODO')"), ("length", f"length({x}) NOT BETWEEN 120 AND 150"), ("lead", f"NOT regexp_matches({x}, '^(?i)you([^\\p{{L}}\\p{{N}}_]|$)')")]
    cases.append(("naming", f"regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])you (value|prize|cherish|care about|believe in|are driven by|are motivated by|are guided by|prioritize)([^\\p{{L}}\\p{{N}}_]|$)')"))
    cases += [(f"label {w}", f"value = '{name}' AND {word(w)}") for name, words in validation.LABEL_WORDS.items() for w in words]
    listed = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN 'set' || i || ' {n}' END" for n, c in cases) + "], lambda x: x IS NOT NULL)"
    return f"""WITH s AS (SELECT cell, value, CASE WHEN three IS NULL THEN 2 ELSE 3 END AS k, unnest([1, 2, 3]) AS i, unnest([one, two, three]) AS s FROM cells), p AS (SELECT cell, k, i, {listed} AS l FROM s WHERE i <= k)
SELECT cell, array_to_string(list_concat(CASE WHEN any_value(k) <> 3 THEN ['sets'] ELSE [] END, flatten(list(l ORDER BY i))), ',') AS problems FROM p GROUP BY cell"""


@query("cell_validate", oracle(_cell_sql()))
def _(spark, sf_dir):
    return derived(spark, sf_dir, "cells").select("cell", F.array_join(validation.cell_problems("value", F.array_compact(F.array("one", "two", "three"))), ",").alias("problems"))
