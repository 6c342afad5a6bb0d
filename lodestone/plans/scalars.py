"""Scalar functions over derived texts, outputs and numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import arrays, compare, maths, text
from ..operators import rollups
from ..operators.screens import analysis_tier, chats, level_filter
from ..tables import derived, load, oracle
from .aggregates import rounded

AB = ["A", "B"]


def over(table: str, key: str, **columns):
    """A query of a derived input's key and of columns, which are made when it runs."""

    def run(spark, sf_dir):
        return derived(spark, sf_dir, table).select(key, *(c().alias(n) for n, c in columns.items()))

    return run


def docs(**columns):
    def run(spark, sf_dir):
        return load(spark, sf_dir, "documents").select("doc_id", *(c().alias(n) for n, c in columns.items()))

    return run


_WS = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
query("normalize_ws", f"SELECT doc_id, md5({_WS}) AS h FROM documents")(docs(h=lambda: F.md5(text.normalize_ws("text").cast("binary"))))
query("normalize_casefold", "SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(replace(lower(text), 'ß', 'ss'), '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+'), lambda w: w <> ''), ' ')) AS h FROM documents")(docs(h=lambda: F.md5(text.normalize_casefold("text").cast("binary"))))
query("word_count", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents")(docs(n=lambda: text.word_count("text")))
_ONE = "replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"  # the entities that pages hold; the ampersand last
_TWICE = _ONE.format(_ONE.format("html"))
query("clean_html_text", rf"""SELECT page_id, md5(trim(regexp_replace(regexp_replace({_TWICE}, '[\x{{200B}}-\x{{200F}}\x{{FEFF}}]|&#x200[bB];', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS h FROM pages""".replace('\\"', '"'))(
    lambda spark, sf_dir: load(spark, sf_dir, "pages").select("page_id", F.when(F.col("html").isNotNull(), F.md5(text.clean_html_text("html", closed=True).cast("binary"))).alias("h"))
)
query("html_unescape", f"SELECT page_id, md5({_TWICE}) AS h FROM pages".replace('\\"', '"'))(lambda spark, sf_dir: load(spark, sf_dir, "pages").select("page_id", F.md5(arrays.html_unescape_closed("html").cast("binary")).alias("h")))
_KEPT = "list_filter(parts, lambda s: trim(s) <> '' AND NOT regexp_matches(s, '(?i)(^|[^A-Za-z0-9_])(of|License)([^A-Za-z0-9_]|$)'))"
query("scrub_sentences", rf"""WITH p AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM documents)
SELECT doc_id, len({_KEPT}) < len(parts) AS scrubbed, CASE WHEN len({_KEPT}) < len(parts) THEN trim(regexp_replace(array_to_string({_KEPT}, ' '), '\s+([,.!?])', '\1', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE text END AS text FROM p""".replace("\\\\", "\\"))(docs(text=lambda: text.scrub_sentences("text", ["of", "License"])["text"], scrubbed=lambda: text.scrub_sentences("text", ["of", "License"])["scrubbed"]))
query("ask_from_title", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Would I be wrong if I asked ' || doc_id || '?' WHEN 1 THEN 'Would I be wrong for asking ' || doc_id || '?' END AS ask FROM documents")(
    docs(ask=lambda: text.ask_from_title(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("MYQ If I asked "), F.col("doc_id"), F.lit(" ?"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("[myq] for Asking "), F.col("doc_id"))).otherwise("no mark"), ["myq"]))
)
query("closer_by_hash", "SELECT doc_id, (['What now?', 'Any advice?', 'Was I wrong?'])[CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 3 + 1 AS BIGINT)] AS closer FROM documents")(docs(closer=lambda: text.closer_by_hash("doc_id", ["What now?", "Any advice?", "Was I wrong?"])))
query("strip_wrapper", "SELECT doc_id, CASE WHEN starts_with(text, 'The ') THEN substr(text, 5) ELSE text END AS bare FROM documents")(docs(bare=lambda: text.strip_wrapper("text", "The ")))
query("strip_speaker", "SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM conversations")(
    lambda spark, sf_dir: load(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_speaker(F.concat(F.initcap("role"), F.lit(': "'), "text", F.lit('"'))).alias("bare"))
)
# Answers by their patterns, over whole texts: lines, the last of them, lines that are nothing but an answer, labels that stand as words.
_RAW = "coalesce(raw, '')"
_NOISE, _TAIL, _WORD = r"""[ \t>*_"''`#-]*""", r"""[ \t.,;:!?*_"''`)\]]*""", r"[\p{L}\p{M}\p{N}\p{Pc}]"
_LAST = f"coalesce(list_filter(regexp_split_to_array({_RAW}, '\\r?\\n'), lambda x: trim(x) <> '')[-1], '')"
_ONLY = rf"nullif(upper(regexp_extract({_LAST}, '(?i)^{_NOISE}Answer:\s*\*{{0,2}}\s*(A|B){_TAIL}$', 1)), '')"
_BARE = rf"nullif(upper(regexp_extract({_LAST}, '(?i)^{_NOISE}(A|B){_TAIL}$', 1)), '')"
_ANSWERS = rf"list_transform(regexp_extract_all({_RAW}, '(?im)^{_NOISE}Answer:[\s\x{{0B}}\x{{85}}\x{{A0}}]*\*{{0,2}}[\s\x{{0B}}\x{{85}}\x{{A0}}]*(A|B)(?:$|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])', 1), lambda x: upper(x))"
_SAID = f"trim({_RAW}, ' ' || chr(10) || chr(9) || chr(13))"
_NAMED = f"list_filter(['A', 'B'], lambda k: regexp_matches({_SAID}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}])' || k || '([^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]|$)'))"
_PLAIN = f"CASE WHEN upper({_SAID}) IN ('A', 'B') THEN upper({_SAID}) WHEN len({_NAMED}) = 1 THEN {_NAMED}[1] END"
query("answer_lines", oracle(f"SELECT rid, array_to_string({_ANSWERS}, ',') AS labels FROM replies"))(over("replies", "rid", labels=lambda: F.array_join(text.answer_lines("raw", AB), ",")))
query("terminal_answer", oracle(f"SELECT rid, {_ONLY} AS label FROM replies"))(over("replies", "rid", label=lambda: text.terminal_answer("raw", AB)))
query("terminal_choice", oracle(f"SELECT rid, coalesce({_ONLY}, {_BARE}) AS label FROM replies"))(over("replies", "rid", label=lambda: text.terminal_choice("raw", AB)))
query("multi_answer_flag", oracle(f"SELECT rid, len(list_distinct({_ANSWERS})) > 1 AS multiple FROM replies"))(over("replies", "rid", multiple=lambda: text.multi_answer_flag("raw", AB)))
query("parse_forced_choice", oracle(f"SELECT rid, coalesce({_PLAIN}, 'unparseable') AS label, coalesce({_ONLY}, {_BARE}, 'unparseable') AS terminal, coalesce({_ONLY}, 'unparseable') AS reasoning FROM replies"))(
    over("replies", "rid", label=lambda: text.parse_forced_choice("raw", AB), terminal=lambda: text.parse_forced_choice("raw", AB, "terminal"), reasoning=lambda: text.parse_forced_choice("raw", AB, "reasoning"))
)
query("parse_freeform", oracle(f"SELECT rid, coalesce({_ONLY}, {_BARE}, {_PLAIN}, CASE WHEN rid % 5 = 0 THEN 'A' ELSE 'unparseable' END) AS label FROM replies"))(over("replies", "rid", label=lambda: text.parse_freeform("raw", F.when(F.col("rid") % 5 == 0, "a"), AB)))
query("parse_forecast", "SELECT event_id, CASE k % 4 WHEN 0 THEN 'MORE' WHEN 1 THEN 'LESS' WHEN 2 THEN 'SAME' ELSE 'unparseable' END AS label FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")(
    lambda spark, sf_dir: derived(spark, sf_dir, "acts").withColumn("raw", F.concat(F.lit("Thinking.\nAnswer: "), F.element_at(F.array(*map(F.lit, ("more", "LESS", "Same", "unsure"))), (F.col("k") % 4 + 1).cast("int")))).select("event_id", text.parse_forced_choice("raw", ["MORE", "LESS", "SAME"], "terminal").alias("label"))
)
query("parse_action", oracle("SELECT pos, CASE WHEN (choice = 'first') = (ord = 'forward') THEN 'first' ELSE 'second' END AS action FROM choices"))(
    lambda spark, sf_dir: derived(spark, sf_dir, "choices").select("pos", text.parse_action(F.when(F.col("choice") == "first", "I take Action 1.").otherwise("action 2"), "ord").alias("action"))
)
query("degenerate_loop", "SELECT doc_id, len(w) >= 40 AND len(list_distinct(w)) / len(w) < 0.35 AS looping FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)")(docs(looping=lambda: text.degenerate_loop("text")))
query("rejoin_reasoning", oracle("SELECT rid, CASE WHEN raw IS NOT NULL AND rid % 2 = 0 THEN '<think>r</think>' || chr(10) || raw ELSE coalesce(raw, CASE WHEN rid % 2 = 0 THEN 'r' END) END AS whole FROM responses"))(over("responses", "rid", whole=lambda: text.rejoin_reasoning(F.when(F.col("rid") % 2 == 0, "r"), "raw")))
query("split_think", oracle("""SELECT cid, CASE WHEN strpos(content, '</think>') > 0 THEN regexp_replace(split_part(content, '</think>', 1), '^\\s*<think>', '') WHEN strpos(content, '<think>') > 0 THEN split_part(content, '<think>', 2) ELSE content END AS reasoning,
  CASE WHEN strpos(content, '</think>') > 0 THEN substr(content, strpos(content, '</think>') + 8) ELSE '' END AS visible FROM completions"""))(over("completions", "cid", reasoning=lambda: text.split_think("content")["reasoning"], visible=lambda: text.split_think("content")["visible"]))
query("truncate_reasoning", oracle("SELECT cid, CASE cid % 8 WHEN 1 THEN '<think>... [total 22 symbols]</think>' || split_part(content, '</think>', 2) WHEN 6 THEN '<think>... [total 17 symbols]</think>' ELSE content END AS short FROM completions"))(over("completions", "cid", short=lambda: text.truncate_reasoning("content", 20)))
_FENCED = r"regexp_extract_all(coalesce(content, ''), '(?s)```([a-zA-Z0-9_+-]*)\n(.*?)```', {})"
_STRIPPED = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_AFTER = _STRIPPED.format("substr(content, strpos(content, '</think>') + 8)")
_CODE = _STRIPPED.format(f"CASE WHEN len({_FENCED.format(2)}) > 0 THEN {_FENCED.format(2)}[-1] ELSE coalesce(content, '') END")
_FENCES = "(length(coalesce(content, '')) - length(replace(coalesce(content, ''), '```', ''))) // 3"
_OPEN = rf"(regexp_matches(coalesce(content, ''), '```[a-zA-Z0-9_+-]*\n') AND {_FENCES} % 2 = 1)"
_REST = _STRIPPED.format(r"regexp_split_to_array(content, '```[a-zA-Z0-9_+-]*\n')[-1]")
_BEST = f"CASE WHEN {_STRIPPED.format('content')} = '' THEN '' WHEN {_OPEN} THEN {_REST} ELSE {_CODE} END"
_STATE = f"CASE WHEN {_STRIPPED.format('content')} = '' THEN 'empty' WHEN {_OPEN} OR coalesce(finish_reason, '') = 'length' THEN 'truncated' WHEN ({_CODE}) = '' THEN 'empty' ELSE 'ok' END"
_OWN = f"list_filter(list_zip({_FENCED.format(1)}, {_FENCED.format(2)}), lambda x: lower(x[1]) IN ('python', 'py'))"
query("extract_code", oracle(f"SELECT cid, {_CODE} AS code FROM programs"))(over("programs", "cid", code=lambda: text.extract_code("content")))
query("extract_code_first", oracle(rf"SELECT cid, regexp_replace(regexp_extract(CASE WHEN strpos(content, '</think>') > 0 THEN {_AFTER} ELSE content END, '(?is)```(\s*({text.TAGS})\s*\n)?(.*?)```', 3), '(?is)(#+|//+) YOUR CODE HERE', '', 'g') AS code FROM programs"))(over("programs", "cid", code=lambda: text.extract_code_first("content")))
query("extract_code_status", oracle(f"SELECT cid, {_BEST} AS code, {_STATE} AS status FROM programs"))(
    over("programs", "cid", code=lambda: text.extract_code_status("content", "finish_reason")["code"], status=lambda: text.extract_code_status("content", "finish_reason")["status"])
)
query("extract_code_lang", oracle(f"SELECT cid, CASE WHEN {_STATE} = 'ok' AND len({_OWN}) > 0 THEN {_STRIPPED.format(_OWN + '[-1][2]')} ELSE {_BEST} END AS code, {_STATE} AS status FROM programs"))(
    over("programs", "cid", code=lambda: text.extract_code_lang("content", "finish_reason", ["python", "py"])["code"], status=lambda: text.extract_code_lang("content", "finish_reason", ["python", "py"])["status"])
)
query("exact_fence", oracle(rf"SELECT cid, regexp_full_match(content, '(?s)\s*```[A-Za-z0-9_+#.-]*[ \t]*\n.*\n```\s*') AND {_FENCES} = 2 AS exact FROM programs"))(over("programs", "cid", exact=lambda: text.exact_fence("content")))
query("bullets_to_prose", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'One item. Last ' || doc_id || chr(10) || '</think>A' WHEN 1 THEN 'first second' || chr(10) || '</think>B' ELSE 'no tag' END AS prose FROM documents")(
    docs(prose=lambda: text.bullets_to_prose(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Plan:\n- **One** item.\n\n 3. Last "), F.col("doc_id"), F.lit("</think>A"))).when(F.col("doc_id") % 3 == 1, "first\n second\n</think>B").otherwise("no tag")))
)
query("semantic_answer", oracle("SELECT event_id, CASE label WHEN 'A' THEN a WHEN 'B' THEN b END AS chosen FROM votes"))(over("votes", "event_id", chosen=lambda: text.semantic_answer("label", F.array(F.lit("A"), F.lit("B")), F.array("a", "b"))))
query("render_prompt", oracle("SELECT DISTINCT a, b, 'Prefer item ' || a || ' or item ' || b || '?' AS prompt FROM votes"))(lambda spark, sf_dir: derived(spark, sf_dir, "votes").select("a", "b", text.render_prompt("Prefer item {a} or item {b}?", a="a", b="b").alias("prompt")).distinct())
query("label_order_rewrite", "SELECT doc_id, 'Say LESS, SAME or MORE on ' || doc_id AS prompt FROM documents")(docs(prompt=lambda: text.label_order_rewrite(F.concat(F.lit("Say MORE, LESS or SAME on "), F.col("doc_id")), ["MORE", "LESS", "SAME"], 1)))
query("truncate_str", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 297) || '...' ELSE text END AS short FROM documents")(docs(short=lambda: text.truncate_str("text")))
query("slug", "SELECT doc_id, coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z0-9_.-]+', '-', 'g'), '-'), ''), 'none') AS slug FROM documents")(docs(slug=lambda: text.slug("text")))
query("sanitize", "SELECT doc_id, nullif(lower(trim(regexp_replace(source || '/' || lang || ' ' || doc_id, '[^A-Za-z0-9_-]+', '-', 'g'), '-')), '') AS name FROM documents")(docs(name=lambda: text.safe_tag(F.concat("source", F.lit("/"), "lang", F.lit(" "), "doc_id"))))
query("plang_fuzzy", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' WHEN 2 THEN 'csharp' WHEN 3 THEN 'go' END AS language FROM documents")(docs(language=lambda: text.plang_fuzzy(F.element_at(F.array(*map(F.lit, ("Python ", "C++", "c#", "Go", "cobol"))), (F.col("doc_id") % 5 + 1).cast("int")))))
query("field_leak", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, 'token') THEN 'token' END, CASE WHEN contains(text, 'License') THEN 'License' END], lambda x: x IS NOT NULL), ',') AS leaks FROM documents")(docs(leaks=lambda: F.array_join(text.field_leak("text", ["token", "License"]), ",")))
query("compose", "SELECT doc_id, regexp_replace(text, '\\s+$', '') || chr(10) || chr(10) || 'What now?' AS prompt FROM documents")(docs(prompt=lambda: text.compose("text", "What now?")))
query("seq_ratio")(lambda spark, sf_dir: rounded(load(spark, sf_dir, "conversations").withColumn("after", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("after IS NOT NULL").select("conv_id", "turn", arrays.seq_ratio("text", "after").alias("ratio"))))
_CHAT = "'User: ' || arg_max(text, turn) FILTER (role = 'user') || chr(10) || 'Assistant:' || chr(10) || arg_max(text, turn) FILTER (role = 'assistant')"
query("chat_render", f"SELECT conv_id, md5(t) AS h FROM (SELECT conv_id, {_CHAT} AS t FROM conversations GROUP BY conv_id) WHERE t IS NOT NULL AND length(t) <= 1500 AND NOT contains(lower(t), 'tionere') AND NOT contains(lower(t), 'license')")(
    lambda spark, sf_dir: chats(load(spark, sf_dir, "conversations")).select("conv_id", F.md5(text.chat_render("messages", 1500, ["TionEre", "license"]).cast("binary")).alias("h")).filter("h IS NOT NULL")
)


def _review_text():
    return F.concat(F.lit("# Title\n"), F.lit("## a"), F.col("doc_id"), F.lit("\nPrompt text one\nVerdict: keep\n## b"), F.col("doc_id"), F.lit("\nSecond\nVerdict: drop\n"))


def _review(spark, sf_dir):
    sections = load(spark, sf_dir, "documents").select("doc_id", F.explode(text.parse_md_sections(F.regexp_replace(_review_text(), "^# Title\n", ""))).alias("s"))
    return sections.select("doc_id", "s.*")


_SECTIONS = "SELECT doc_id, 'a' || doc_id AS id, 'Prompt text one' AS prompt, 'KEEP' AS verdict FROM documents UNION ALL SELECT doc_id, 'b' || doc_id, 'Second', 'DROP' FROM documents"
query("parse_md_sections", _SECTIONS)(_review)
query("apply_review", f"SELECT route, count(*) AS n FROM (SELECT CASE WHEN verdict = 'DROP' THEN 'dropped' WHEN length(prompt) < 8 THEN 'screened' WHEN doc_id % 10 = 0 THEN 'unsure' ELSE 'kept' END AS route FROM ({_SECTIONS})) GROUP BY route")(
    lambda spark, sf_dir: _review(spark, sf_dir).groupBy(F.when(F.col("verdict") == "DROP", "dropped").when(F.length("prompt") < 8, "screened").when(F.col("doc_id") % 10 == 0, "unsure").otherwise("kept").alias("route")).agg(F.count("*").alias("n"))
)

# Output comparison over whole texts that differ in blanks, case, line ends, numbers and flags.
_TOKENS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '\s+'), lambda x: x <> '')"
_TEXT_LINES = r"list_transform(regexp_split_to_array(regexp_replace(coalesce({}, ''), '\s+$', ''), '\r\n|\r|\n'), lambda x: regexp_replace(x, '\s+$', ''))"
_TRIMMED = "list_transform(string_split(trim(coalesce({}, ''), ' ' || chr(10) || chr(9) || chr(13)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)))"
_NUMERIC, _ODD = f"regexp_full_match({{}}, '{compare.NUMBER}')", f"regexp_full_match({{}}, '{compare.NOT_FINITE}')"
_SAME_NUMBER = f"""CASE WHEN ({_NUMERIC.format('z[1]')} OR {_ODD.format('z[1]')}) AND ({_NUMERIC.format('z[2]')} OR {_ODD.format('z[2]')})
  THEN NOT {_ODD.format('z[1]')} AND NOT {_ODD.format('z[2]')} AND abs(TRY_CAST(z[1] AS DOUBLE) - TRY_CAST(z[2] AS DOUBLE)) <= greatest(1e-6, 1e-6 * greatest(abs(TRY_CAST(z[1] AS DOUBLE)), abs(TRY_CAST(z[2] AS DOUBLE)))) ELSE z[1] = z[2] END"""
_FLAGS = "(z[1] IN ('True', 'true') AND z[2] IN ('True', 'true')) OR (z[1] IN ('False', 'false') AND z[2] IN ('False', 'false'))"
_DECIMALS = f"(len({_TOKENS.format('z[1]')}) > 0 AND len({_TOKENS.format('z[1]')}) = len({_TOKENS.format('z[2]')}) AND len(list_filter(list_zip({_TOKENS.format('z[1]')}, {_TOKENS.format('z[2]')}), lambda t: NOT coalesce(abs(TRY_CAST(t[1] AS DECIMAL(38,18)) - TRY_CAST(t[2] AS DECIMAL(38,18))) <= 0.00001, false))) = 0)"
_BOTH = lambda form: f"len({form.format('got')}) = len({form.format('want')}) AND len(list_filter(list_zip({form.format('got')}, {form.format('want')}), lambda z: NOT ({{}}))) = 0"
query("out_tokens", oracle(f"SELECT oid, {_TOKENS.format('got')} = {_TOKENS.format('want')} AS equal FROM pairs"))(over("pairs", "oid", equal=lambda: compare.out_tokens("got", "want")))
query("out_exact_lines", oracle(f"SELECT oid, {_TEXT_LINES.format('got')} = {_TEXT_LINES.format('want')} AS equal FROM pairs"))(over("pairs", "oid", equal=lambda: compare.out_exact_lines("got", "want")))
query("out_ci_tokens", oracle(f"SELECT oid, {_TOKENS.format('lower(got)')} = {_TOKENS.format('lower(want)')} AS equal FROM pairs"))(over("pairs", "oid", equal=lambda: compare.out_ci_tokens("got", "want")))
query("out_float_tokens", oracle("SELECT oid, " + _BOTH(_TOKENS).format(_SAME_NUMBER) + " AS equal FROM pairs"))(over("pairs", "oid", equal=lambda: compare.out_float_tokens("got", "want")))
query("out_lcb", oracle("SELECT oid, " + _BOTH(_TRIMMED).format(f"z[1] = z[2] OR {_FLAGS} OR {_DECIMALS}") + " AS equal FROM pairs"))(over("pairs", "oid", equal=lambda: compare.out_lcb("got", "want")))


def _passed(spark, sf_dir):
    """Test results of each problem in order, up to the first failure."""
    s = derived(spark, sf_dir, "samples").groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("sample", "part", "correct"))).alias("t"))
    return s.select("problem", F.transform("t", lambda x: x["correct"]).alias("passed"))


query("pass_fraction", oracle("SELECT problem, round(avg(correct::INT), 6) AS fraction FROM samples GROUP BY problem"))(lambda spark, sf_dir: rounded(_passed(spark, sf_dir).select("problem", compare.pass_fraction("passed").alias("fraction"))))
query("stop_at_failure", oracle("SELECT problem, CASE WHEN list_position(list(correct ORDER BY sample, part, correct), false) > 0 THEN list_position(list(correct ORDER BY sample, part, correct), false) ELSE count(*) END AS n_run FROM samples GROUP BY problem"))(
    lambda spark, sf_dir: _passed(spark, sf_dir).select("problem", F.size(compare.prefix_to_first_failure("passed")).cast("bigint").alias("n_run"))
)
query("screen_then_full", oracle("SELECT problem, round(CASE WHEN avg(correct::INT) FILTER (sample <= 2) = 1.0 THEN avg(correct::INT) END, 6) AS score FROM samples GROUP BY problem"))(
    lambda spark, sf_dir: rounded(derived(spark, sf_dir, "samples").groupBy("problem").agg(F.avg(F.when(F.col("sample") <= 2, F.col("correct").cast("double"))).alias("s"), F.avg(F.col("correct").cast("double")).alias("f")).select("problem", compare.screen_then_full("s", "f").alias("score")))
)
_STATUS = "CASE k % 8 WHEN 1 THEN 'TimeoutExpired' WHEN 2 THEN 'OutOfMemory' WHEN 3 THEN 'Exception' WHEN 4 THEN 'SyntaxError' WHEN 5 THEN 'ValueError' WHEN 6 THEN 'AbnormalTermination' ELSE 'Done' END"
query("run_status", oracle(f"SELECT pos, {_STATUS} AS status FROM runs"))(over("runs", "pos", status=lambda: compare.run_status("exit_code", "stderr")))
query("build_status", oracle("SELECT pos, CASE k % 8 WHEN 1 THEN 'BuildTimeOut' WHEN 6 THEN 'BuildFailed' WHEN 0 THEN 'BuildDone' WHEN 7 THEN 'BuildDone' ELSE 'SyntaxError' END AS status FROM runs"))(over("runs", "pos", status=lambda: compare.build_status("exit_code", "stderr")))
_PAIRS = "SELECT x.id AS a, y.id AS b, {} AS p FROM utilities x JOIN utilities y ON x.id < y.id".format(maths.normal_cdf_sql("(x.mean - y.mean) / sqrt(x.variance + y.variance + 1e-5)"))


def _preferences(spark, sf_dir):
    u = derived(spark, sf_dir, "utilities")
    x, y = u.toDF("a", "ma", "va"), u.toDF("b", "mb", "vb")
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", maths.preference_probability("ma", "va", "mb", "vb").alias("p"))


query("normal_cdf", oracle(f"SELECT a, b, round(p, 6) AS p FROM ({_PAIRS})"))(lambda spark, sf_dir: rounded(_preferences(spark, sf_dir)))
query("log_loss_acc", oracle(f"SELECT count(*) AS n, round(avg(-(y * ln(greatest(least(p, 1 - 1e-5), 1e-5)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-5), 1e-5)))), 6) AS log_loss, round(avg(((p >= 0.5) = (y >= 0.5))::INT), 6) AS accuracy FROM (SELECT p, ((a + b) % 2)::DOUBLE AS y FROM ({_PAIRS}))"))(
    lambda spark, sf_dir: rounded(_preferences(spark, sf_dir).withColumn("y", ((F.col("a") + F.col("b")) % 2).cast("double")).agg(F.count("*").alias("n"), F.avg(maths.log_loss("p", "y")).alias("log_loss"), F.avg(((F.col("p") >= 0.5) == (F.col("y") >= 0.5)).cast("double")).alias("accuracy")))
)


query("zscore_util", oracle("SELECT id, round((mean - (SELECT avg(mean) FROM utilities)) / ((SELECT stddev_samp(mean) FROM utilities) + 1e-5), 6) + 0 AS z FROM utilities"))(lambda spark, sf_dir: rounded(rollups.zscores(derived(spark, sf_dir, "utilities"), "mean").select("id", "z")))
query("pearson", "SELECT p_brand AS brand, round(CASE WHEN count(*) >= 2 AND stddev_pop(p_size) > 0 AND stddev_pop(p_retailprice) > 0 THEN corr(p_size, p_retailprice) END, 6) + 0 AS r FROM part GROUP BY p_brand")(
    lambda spark, sf_dir: rounded(load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(rollups.pearson("p_size", "p_retailprice").alias("r")))
)

_DELTAS = "SELECT item, avg(x) FILTER (arm = 'arm') - avg(x) FILTER (arm = 'base') AS d FROM (SELECT p_brand AS item, CASE WHEN p_size % 2 = 0 THEN 'arm' ELSE 'base' END AS arm, p_retailprice AS x FROM part) GROUP BY item"


def _bootstrap(spark, sf_dir):
    scores = load(spark, sf_dir, "part").select(F.col("p_brand").alias("item"), F.when(F.col("p_size") % 2 == 0, "arm").otherwise("base").alias("arm"), F.col("p_retailprice").alias("x"))
    return rounded(rollups.paired_bootstrap(rollups.paired_deltas(scores, "item", "arm", "x", "base", "arm"), "item"), 4)


query("paired_bootstrap", f"WITH d AS (SELECT d, row_number() OVER (ORDER BY sha256('0:' || item), item) - 1 AS i, count(*) OVER () AS n FROM ({_DELTAS}) WHERE d IS NOT NULL), g AS (SELECT b AS draw, CAST('0x' || substr(sha256(b || ':' || j), 1, 8) AS BIGINT) % (SELECT max(n) FROM d) AS i FROM generate_series(0, 9999) x(b), generate_series(0, (SELECT max(n) - 1 FROM d)) y(j)), m AS (SELECT draw, avg(d) AS m FROM g JOIN d USING (i) GROUP BY draw), r AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM m) SELECT (SELECT count(*) FROM d) AS n_paired, round((SELECT avg(d) FROM d), 4) AS mean_delta, round(max(m) FILTER (r = 250), 4) AS low, round(max(m) FILTER (r = 9750), 4) AS high FROM r")(_bootstrap)

_ARMS = "WITH s AS (SELECT avg(finished::INT) FILTER (arm = 'base') AS t0, avg(reward) FILTER (arm = 'base' AND finished) AS q0, avg(finished::INT) FILTER (arm = 'arm') AS t1, avg(reward) FILTER (arm = 'arm' AND finished) AS q1 FROM arms) "


def _decompose(spark, sf_dir):
    arm = lambda a, c: F.avg(F.when(F.col("arm") == a, c))
    done, value = F.col("finished").cast("double"), F.when(F.col("finished"), F.col("reward"))
    s = derived(spark, sf_dir, "arms").agg(arm("base", done).alias("t0"), arm("base", value).alias("q0"), arm("arm", done).alias("t1"), arm("arm", value).alias("q1"))
    return rounded(s.select(maths.decompose("t0", "q0", "t1", "q1").alias("x")).select("x.*"))


query("decompose", oracle(_ARMS + "SELECT round((t1 - t0) * q0, 6) + 0 AS from_termination, round(t1 * (q1 - q0), 6) + 0 AS from_quality, round(t1 * q1 - t0 * q0, 6) + 0 AS delta FROM s"))(_decompose)
query("drift_label", oracle("SELECT id, CASE WHEN mean - 0.948 > 0.002 THEN 'MORE' WHEN mean - 0.948 < -0.002 THEN 'LESS' ELSE 'SAME' END AS drift FROM utilities"))(over("utilities", "id", drift=lambda: maths.drift_label(F.col("mean") - 0.948, 0.002)))
_BAND = "CASE WHEN {n} > 500 THEN 0 WHEN {n} > 256 THEN (500 - {n})::DOUBLE / 244 WHEN {n} >= 32 THEN 1 ELSE 0.4 + 0.6::DOUBLE * {n} / 32 END"
query("band_score", oracle(f"SELECT pos, round({_BAND.format(n='(output_tokens * 2)')}, 6) AS band FROM attempts"))(lambda spark, sf_dir: rounded(derived(spark, sf_dir, "attempts").select("pos", maths.band_score(F.col("output_tokens") * 2).alias("band"))))
query("format_reward", oracle(f"SELECT pos, round(CASE WHEN api_error THEN -0.2 ELSE 0.3 * ({_BAND.format(n='output_tokens')}) + CASE WHEN pos % 2 = 0 THEN 0.5 + 0.2 * (pass_rate >= 0.5)::INT ELSE 0.7 END END, 6) + 0 AS reward FROM attempts"))(
    lambda spark, sf_dir: rounded(derived(spark, sf_dir, "attempts").select("pos", maths.format_reward(~F.col("api_error"), maths.band_score("output_tokens"), F.col("pass_rate") >= 0.5, F.col("pos") % 2 == 0).alias("reward")))
)
query("scale_unit", oracle("SELECT record_id % 10 AS grp, round(1 / stddev_samp(elapsed_seconds), 6) AS scale, abs(stddev_samp(elapsed_seconds) / stddev_samp(elapsed_seconds) - 1) <= 0.1 AS fits FROM attempts GROUP BY 1"))(
    lambda spark, sf_dir: rounded(derived(spark, sf_dir, "attempts").groupBy((F.col("record_id") % 10).alias("grp")).agg((1 / F.stddev_samp("elapsed_seconds")).alias("scale"), F.stddev_samp("elapsed_seconds").alias("sd")).select("grp", "scale", (F.abs(F.col("sd") * F.col("scale") - 1) <= 0.1).alias("fits")))
)
query("kv_budget", oracle("SELECT pos, (input_tokens + 1) * (output_tokens + 64) <= 100000 AS fits FROM attempts"))(over("attempts", "pos", fits=lambda: maths.kv_budget(F.col("input_tokens") + 1, "output_tokens", 64, 100000)))

query("cyclic_rotations", "SELECT r, labels FROM (VALUES (0, 'MORE,LESS,SAME'), (1, 'LESS,SAME,MORE'), (2, 'SAME,MORE,LESS')) t(r, labels)")(
    lambda spark, sf_dir: spark.range(1).select(F.posexplode(text.cyclic_rotations(F.array(*map(F.lit, ("MORE", "LESS", "SAME"))), 3)).alias("r", "x")).select("r", F.array_join("x", ",").alias("labels"))
)


def _tables(spark, sf_dir):
    """Small tables of numbers: matrices, jagged ones and empty ones by order."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q")))).alias("t"))
    row = lambda x: F.when(F.col("l_orderkey") % 3 == 0, F.array(x["l_partkey"].cast("string"))).otherwise(F.array(x["l_partkey"].cast("string"), x["q"].cast("string")))
    rows = F.transform("t", lambda x: F.when((F.col("l_orderkey") % 3 == 2) & (x["q"] % 2 == 0), F.array(x["l_partkey"].cast("string"))).otherwise(row(x)))
    return lines.select(F.col("l_orderkey").alias("id"), rows.alias("rows"))


_ROWS = "WITH r AS (SELECT l_orderkey AS id, l_linenumber, l_partkey, CAST(l_quantity AS INT) AS q, CASE WHEN l_orderkey % 3 = 0 OR (l_orderkey % 3 = 2 AND CAST(l_quantity AS INT) % 2 = 0) THEN CAST(l_partkey AS VARCHAR) ELSE l_partkey || ' ' || CAST(l_quantity AS INT) END AS line FROM lineitem), t AS (SELECT id, string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, q) AS body, count(*) AS n, min(len(string_split(line, ' '))) AS lo, max(len(string_split(line, ' '))) AS hi FROM r GROUP BY id) "
query("classify_value", _ROWS + "SELECT id, CASE WHEN lo = hi THEN 'matrix' ELSE 'jagged' END AS kind FROM t")(lambda spark, sf_dir: _tables(spark, sf_dir).select("id", arrays.classify_value("rows").alias("kind")))
query("is_matrix", _ROWS + "SELECT id, lo = hi AS is_matrix FROM t")(lambda spark, sf_dir: _tables(spark, sf_dir).select("id", (arrays.classify_value("rows") == "matrix").alias("is_matrix")))
query("resolve_type", _ROWS + "SELECT id % 100 AS task, CASE WHEN min(lo = hi) = max(lo = hi) THEN CASE WHEN min(lo = hi) THEN 'matrix' ELSE 'jagged' END ELSE 'jagged' END AS kind FROM t GROUP BY 1")(
    lambda spark, sf_dir: _tables(spark, sf_dir).groupBy((F.col("id") % 100).alias("task")).agg(F.collect_set(arrays.classify_value("rows")).alias("k")).select("task", arrays.resolve_type("k").alias("kind"))
)
query("task_category", _ROWS + "SELECT id % 100 AS task, CASE WHEN bool_or(lo = hi) THEN 'matrix' ELSE 'two_dim' END AS category FROM t GROUP BY 1")(
    lambda spark, sf_dir: _tables(spark, sf_dir).groupBy((F.col("id") % 100).alias("task")).agg(F.collect_set(arrays.classify_value("rows")).alias("k")).select("task", arrays.task_category("k").alias("category"))
)
for _name, _head in (("convert_v1", "body"), ("convert_v2", "n || chr(10) || body"), ("convert_v3", "CASE WHEN lo = hi THEN n || ' ' || hi ELSE CAST(n AS VARCHAR) END || chr(10) || body")):
    query(_name, _ROWS + f"SELECT id, {_head} AS stdin FROM t")(lambda spark, sf_dir, f=getattr(arrays, _name): _tables(spark, sf_dir).select("id", f("rows").alias("stdin")))
query("parse_raw_json", "SELECT event_id, CAST(event_id AS VARCHAR) AS first, props AS second FROM events")(
    lambda spark, sf_dir: load(spark, sf_dir, "events").select("event_id", arrays.parse_raw_json(F.concat(F.col("event_id"), F.lit("\n\n"), F.col("props"))).alias("m")).select("event_id", F.col("m")["param_0"].alias("first"), F.col("m")["param_1"].alias("second"))
)
def _examples(spark, sf_dir):
    """Problem texts with named inputs, plain ones, nested lists, commas inside quotes and a block without an output."""
    t = F.concat(F.lit("Sum it.\nExample 1:\nInput: nums = ["), "o_custkey", F.lit(", 2], s = \"a, b\", m = [[1, 2], [3]]\nOutput: 'x'\nExample 2:\nInput: ["), "o_orderkey", F.lit("],7\nOutput: 7\nExample 3:\nInput: a = 1\nExample 4:\nInput: a b\nOutput: not json"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.explode(arrays.parse_examples(t)).alias("e")).select("o_orderkey", "e.*")


query("parse_examples", """SELECT o_orderkey, unnest([1, 2, 4]) AS example_id, unnest(['{"nums": [' || o_custkey || ', 2], "s": "a, b", "m": [[1, 2], [3]]}', '{"_param_0": [' || o_orderkey || '], "_param_1": 7}', '{"_param_0": "a b"}']) AS input, unnest(['"x"', '7', '"not json"']) AS output FROM orders""")(_examples)
query("pyrepr_list", "SELECT o_orderkey, 'a,' || o_custkey AS items FROM orders")(lambda spark, sf_dir: load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(arrays.pyrepr_list(F.concat(F.lit("['a', 'nan', '"), "o_custkey", F.lit("']"))), ",").alias("items")))


def _ids(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"] % 5).alias("ids"))


_IDS = "SELECT l_orderkey, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey"
query("eos_terminated", f"SELECT l_orderkey, list_contains(ids, 0) OR list_contains(ids, 4) AS done FROM ({_IDS})")(lambda spark, sf_dir: _ids(spark, sf_dir).select("l_orderkey", arrays.eos_terminated("ids", [0, 4]).alias("done")))
query("mask_after_eos", f"SELECT l_orderkey, array_to_string(CASE WHEN list_contains(ids, 0) THEN list_concat(ids[1:list_position(ids, 0)], list_transform(range(0, len(ids) - list_position(ids, 0)), lambda i: 99::BIGINT)) ELSE ids END, ',') AS masked FROM ({_IDS})")(
    lambda spark, sf_dir: _ids(spark, sf_dir).select("l_orderkey", F.array_join(F.transform(arrays.mask_after_eos("ids", [0], 99), lambda x: x.cast("string")), ",").alias("masked"))
)
query("run_timestamp", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")(lambda spark, sf_dir: load(spark, sf_dir, "events").select("event_id", text.run_timestamp("ts").alias("stamp")))
query("parse_timestamp", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS seen FROM events")(
    lambda spark, sf_dir: load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("t")).select("event_id", F.date_format(text.parse_timestamp("t"), "yyyy-MM-dd HH:mm:ss").alias("seen"))
)
query("level_filter", oracle("SELECT id, level FROM utilities, (VALUES ('primary'), ('weak'), ('strong')) l(level) WHERE level = 'primary' OR id % 4 = 0"))(
    lambda spark, sf_dir: level_filter(derived(spark, sf_dir, "utilities").select("id"), ["primary", "weak", "strong"], "primary", F.col("id") % 4 == 0).select("id", "level")
)
query("analysis_tier", oracle("SELECT id, CASE WHEN id < 5 THEN 'primary' WHEN variance > 0.009 THEN 'secondary' ELSE 'exploratory' END AS tier FROM utilities"))(over("utilities", "id", tier=lambda: analysis_tier(F.col("id") < 5, F.col("variance") > 0.009)))
