"""Rule screens, filters and set-level checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text, tokens
from ..operators import guards, rollups
from ..operators.matching import snippet_overlap
from ..operators.screens import MESSAGE_ROLES, canonicalize_tests, chats, domain_terms, message_problems, prompt_classes, prompt_classes_sql, screen_cascade, set_checks, test_io
from ..tables import derived, load, oracle
from .aggregates import rounded

RULES = {"mail": r"[\w.]+@[\w.]+", "shout": r"[A-Z]{12,}", "digits": r"[0-9]{12,}", "license": r"License"}


@query("rule_hits", oracle("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{r}') THEN '{k}' END" for k, r in RULES.items()) + "], lambda x: x IS NOT NULL), ',') AS hits FROM documents"))
def _(spark, sf_dir):
    hits = guards.reasons(*((k, F.col("text").rlike(r)) for k, r in RULES.items()))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(hits, ",").alias("hits"))


CASCADE = [("language", "lang NOT IN ('en', 'fr')"), ("too_short", "n_chars < 200"), ("too_long", "n_chars > 8000"), ("toxic", "coalesce(toxic, 0) = 1"), ("low_quality", "coalesce(quality, 1) = 0")]
_CASE = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in CASCADE) + " ELSE 'kept' END"


@query("screen_cascade", oracle(f"SELECT {_CASE} AS reason, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"))
def _(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return screen_cascade(docs, [(n, F.expr(c)) for n, c in CASCADE]).groupBy("reason").agg(F.count("*").alias("n"))


@query("screen_all", oracle("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CASCADE) + "], lambda x: x IS NOT NULL), ',') AS problems FROM documents LEFT JOIN labels USING (doc_id)"))
def _(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", F.array_join(guards.reasons(*((n, F.expr(c)) for n, c in CASCADE)), ",").alias("problems"))


@query("len_window", oracle("SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 200 AND 2000"))
def _(spark, sf_dir):
    return load(spark, sf_dir, "documents").filter(F.length("text").between(200, 2000)).select("doc_id", "n_chars")


@query("lang_toxic_filter", oracle("SELECT coalesce(CASE WHEN lang <> 'en' THEN 'language' WHEN toxic = 1 THEN 'toxic' WHEN contains(text, '@example') OR contains(text, '@mail') THEN 'redacted' END, 'kept') AS reason, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"))
def _(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    redacted = F.contains("text", F.lit("@example")) | F.contains("text", F.lit("@mail"))
    return screen_cascade(docs, [("language", F.col("lang") != "en"), ("toxic", F.col("toxic") == 1), ("redacted", redacted)]).groupBy("reason").agg(F.count("*").alias("n"))


@query("null_degenerate", oracle("SELECT count(*) FILTER (raw IS NULL) AS missing, count(*) FILTER (length(trim(raw)) < 3) AS degenerate, count(*) AS n FROM responses"))
def _(spark, sf_dir):
    return derived(spark, sf_dir, "responses").agg(F.count_if(F.col("raw").isNull()).alias("missing"), F.count_if(F.length(F.trim("raw")) < 3).alias("degenerate"), F.count("*").alias("n"))


@query("quote_filter", oracle("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND NOT regexp_matches(text, '\"|“|”')"))
def _(spark, sf_dir):
    return load(spark, sf_dir, "conversations").filter((F.col("role") == "user") & ~F.col("text").rlike('"|“|”')).select("conv_id", "turn")


@query("prompt_exclusion", oracle(f"SELECT doc_id, reasons FROM (SELECT doc_id, {prompt_classes_sql('text')} AS reasons FROM documents) WHERE reasons <> ''"))
def _(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.array_join(prompt_classes("text"), ",").alias("reasons"))
    return d.filter("reasons <> ''")


_TESTS = "SELECT o_custkey AS record_id, o_orderkey AS pos, CAST(o_orderkey % 7 AS VARCHAR) AS input, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE CAST(o_orderkey % 7 + (o_orderkey % 91 = 0)::INT AS VARCHAR) END AS output FROM orders"


@query("test_io_clean", oracle(f"WITH t AS ({_TESTS}), d AS (SELECT DISTINCT record_id, input, output FROM t) SELECT record_id, count(*) AS n_unique, max(k) > 1 AS conflict, bool_or(blank) AS blank, count(*) >= 3 AS enough FROM (SELECT *, count(*) OVER (PARTITION BY record_id, input) AS k, output = '' AS blank FROM d) GROUP BY record_id"))
def _(spark, sf_dir):
    return test_io(_tests(spark, sf_dir), least=3).select("record_id", "n_unique", "conflict", "blank", "enough")


def _tests(spark, sf_dir):
    return load(spark, sf_dir, "orders").selectExpr("o_custkey AS record_id", "o_orderkey AS pos", "cast(o_orderkey % 7 AS string) AS input", "CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE cast(o_orderkey % 7 + CASE WHEN o_orderkey % 91 = 0 THEN 1 ELSE 0 END AS string) END AS output")


_REASONS = f"""WITH t AS ({_TESTS}), d AS (SELECT DISTINCT record_id, input, output FROM t), s AS (SELECT record_id, count(*) AS n, max(k) > 1 AS conflict, bool_or(output = '') AS blank FROM (SELECT *, count(*) OVER (PARTITION BY record_id, input) AS k FROM d) GROUP BY record_id)
SELECT record_id, array_to_string(list_filter([CASE WHEN blank THEN 'blank_output' END, CASE WHEN conflict THEN 'conflicting_outputs' END, CASE WHEN n < 3 THEN 'too_few_tests' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s"""


@query("canonicalize_row", oracle(_REASONS))
def _(spark, sf_dir):
    return canonicalize_tests(_tests(spark, sf_dir), least=3).select("record_id", F.array_join("reasons", ",").alias("reasons"))


@query("validate_formal", oracle(f"SELECT reasons = '' AS valid, count(*) AS n FROM ({_REASONS}) GROUP BY 1"))
def _(spark, sf_dir):
    return canonicalize_tests(_tests(spark, sf_dir), least=3).groupBy((F.size("reasons") == 0).alias("valid")).agg(F.count("*").alias("n"))


@query("cohort_contam", oracle(f"WITH t AS ({_TESTS}) SELECT bucket, count(*) AS n FROM (SELECT record_id, CASE WHEN record_id % 11 = 0 THEN 'bad_type' WHEN count(*) < 3 THEN 'no_tests' WHEN bool_or(input LIKE '%6') THEN 'contaminated' ELSE 'clean' END AS bucket FROM t GROUP BY record_id) GROUP BY bucket"))
def _(spark, sf_dir):
    g = _tests(spark, sf_dir).groupBy("record_id").agg(F.collect_list("input").alias("inputs"))
    bucket = guards.first_reason(("bad_type", F.col("record_id") % 11 == 0), ("no_tests", F.size("inputs") < 3), ("contaminated", F.exists("inputs", lambda x: F.rtrim(x).endswith("6"))))
    return g.select(F.coalesce(bucket, F.lit("clean")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("trailing_marker", oracle(f"WITH t AS ({_TESTS}) SELECT record_id, bool_or(regexp_matches(input, '5\\s*$')) AS marked FROM t GROUP BY record_id"))
def _(spark, sf_dir):
    g = _tests(spark, sf_dir).groupBy("record_id").agg(F.collect_list("input").alias("inputs"))
    return g.select("record_id", F.exists("inputs", lambda x: x.rlike(r"5\s*$")).alias("marked"))


@query("messages_valid", oracle("""SELECT conv_id, array_to_string(list_filter([CASE WHEN count(*) < 2 THEN 'too_few' END, CASE WHEN bool_or(role NOT IN ('system', 'user', 'assistant')) THEN 'role' END, CASE WHEN bool_or(trim(text) = '') THEN 'empty' END, CASE WHEN NOT bool_or(role = 'user') THEN 'no_user' END, CASE WHEN arg_max(role, turn) <> 'assistant' THEN 'last_not_assistant' END], lambda x: x IS NOT NULL), ',') AS problems FROM conversations GROUP BY conv_id"""))
def _(spark, sf_dir):
    return chats(load(spark, sf_dir, "conversations")).select("conv_id", F.array_join(message_problems("messages"), ",").alias("problems"))


@query("domain_terms", oracle("SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])license([^a-z0-9_]|$)') THEN 'license' END, CASE WHEN contains(lower(text), '2.0') THEN '2.0' END, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])token([^a-z0-9_]|$)') THEN 'token' END], lambda x: x IS NOT NULL), ',') AS terms FROM documents"))
def _(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(domain_terms("text", ["license", "2.0", "token"]), ",").alias("terms"))


_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query("snippet_overlap", oracle(f"SELECT DISTINCT doc_id FROM documents, (SELECT {_NORM.format('text')} AS s FROM benchmark) b WHERE length(s) >= 25 AND contains({_NORM.format('documents.text')}, s)"))
def _(spark, sf_dir):
    return snippet_overlap(load(spark, sf_dir, "documents"), "doc_id", load(spark, sf_dir, "benchmark"), "item_id").select("doc_id").distinct()


@query("date_range", oracle("SELECT problem, contest_date FROM graded WHERE contest_date BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"))
def _(spark, sf_dir):
    return derived(spark, sf_dir, "graded").filter("contest_date BETWEEN TIMESTAMP_NTZ '1995-01-01' AND TIMESTAMP_NTZ '1996-12-31'").select("problem", "contest_date")


@query("eq_filters", oracle("SELECT problem, n, c FROM graded WHERE platform = 'F' AND difficulty IN ('1-URGENT', '2-HIGH')").replace("SELECT problem, n, c", "SELECT problem, n, CAST(c AS BIGINT) AS c"))
def _(spark, sf_dir):
    return derived(spark, sf_dir, "graded").filter("platform = 'F' AND difficulty IN ('1-URGENT', '2-HIGH')").select("problem", "n", "c")


@query("score_band", oracle("SELECT record_id FROM rollouts WHERE reward IS NOT NULL GROUP BY record_id HAVING max(reward) >= 0.6 AND min(reward) <= 0.3 AND max(reward) - min(reward) >= 0.4 - 1e-9"))
def _(spark, sf_dir):
    s = derived(spark, sf_dir, "rollouts").filter("reward IS NOT NULL").groupBy("record_id").agg(F.collect_list("reward").alias("s"))
    return s.filter((F.array_max("s") >= 0.6) & (F.array_min("s") <= 0.3) & (F.array_max("s") - F.array_min("s") >= 0.4 - 1e-9)).select("record_id")


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@query("token_budget_words", oracle(f"SELECT doc_id, {_WORDS} AS n_tokens FROM documents WHERE {_WORDS} <= 256"))
def _(spark, sf_dir):
    """The fallback without a tokenizer."""
    return load(spark, sf_dir, "documents").select("doc_id", text.word_count("text").alias("n_tokens")).filter("n_tokens <= 256")


def _prompt():
    return F.concat(F.lit("User: "), F.coalesce("text", F.lit("")), F.lit("\nAssistant:\n"))


@query("token_budget")
def _(spark, sf_dir):
    """Rendered prompts of at most 512 ids of a public tokenizer; beyond SQL, a test counts them again."""
    return load(spark, sf_dir, "documents").select("doc_id", tokens.token_count(_prompt(), "byte_bpe_50k.json").alias("n_tokens")).filter("n_tokens <= 512")


@query("multi_tokenizer_gate")
def _(spark, sf_dir):
    """Whether a rendered prompt has at most 600 ids under every one of four tokenizers of three kinds; beyond SQL, a test counts them again."""
    worst = tokens.worst_count(_prompt(), ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
    return load(spark, sf_dir, "documents").select("doc_id", worst.alias("worst")).withColumn("fits", F.col("worst") <= 600)
