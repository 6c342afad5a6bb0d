"""Text functions: normalisers, answer parsers, code extraction, reasoning blocks.  All are built-in column expressions unless told."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that may stand before an answer on its line, and after it.
NOISE = r"""[ \t>*_"'`#-]*"""
TAIL = r"""[ \t.,;:!?*_"'`)\]]*"""
FENCE = "```"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def normalize_casefold(c: Column | str) -> Column:
    """Full case folding, then words joined by one space (an Arrow function: neither Spark nor SQL folds ß to ss)."""
    from .arrays import casefolded

    return casefolded(col(c))


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda w: w != "")).cast("bigint")


def nonempty_lines(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"\r?\n"), lambda x: F.trim(x) != "")


def last_line(c: Column | str) -> Column:
    lines = nonempty_lines(c)
    return F.when(F.size(lines) > 0, F.element_at(lines, -1))


def _choices(choices: list[str]) -> str:
    return "|".join(re.escape(x) for x in choices)


def canonical(found: Column, choices: list[str]) -> Column:
    """The choice that equals a found label whatever its case; null if none does."""
    out = F.lit(None).cast("string")
    for c in reversed(choices):
        out = F.when(F.upper(found) == c.upper(), F.lit(c)).otherwise(out)
    return out


def _group(text: Column, pattern: str, choices: list[str], group: int = 1) -> Column:
    return canonical(F.regexp_extract(text, pattern, group), choices)


def answer_lines(c: Column | str, choices: list[str]) -> Column:
    """Labels named on lines that start with `Answer:`, in order."""
    pattern = rf"(?imU)^{NOISE}Answer:\s*\*{{0,2}}\s*({_choices(choices)})(?=$|[^\w])"
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(1)), lambda x: canonical(x, choices))


def answer_only(line: Column, choices: list[str]) -> Column:
    return _group(line, rf"(?i)^{NOISE}Answer:\s*\*{{0,2}}\s*({_choices(choices)}){TAIL}$", choices)


def terminal_answer(c: Column | str, choices: list[str]) -> Column:
    """The label if the last non-empty line is nothing but `Answer: label`."""
    return answer_only(F.coalesce(last_line(c), F.lit("")), choices)


def terminal_choice(c: Column | str, choices: list[str]) -> Column:
    """As terminal_answer, or a bare label on the last line."""
    line = F.coalesce(last_line(c), F.lit(""))
    return F.coalesce(answer_only(line, choices), _group(line, rf"(?i)^{NOISE}({_choices(choices)}){TAIL}$", choices))


def multi_answer_flag(c: Column | str, choices: list[str]) -> Column:
    return F.size(F.array_distinct(answer_lines(c, choices))) > 1


def plain_choice(c: Column | str, choices: list[str]) -> Column:
    """The text itself as a label, or the only one of the labels that stands in it as a word; case doesn't matter."""
    text = F.trim(F.coalesce(col(c), F.lit("")), F.lit(" \n\t\r"))
    named = F.array_compact(F.array(*(F.when(text.rlike(rf"(?iU)(^|[^\w]){re.escape(x)}([^\w]|$)"), F.lit(x)) for x in choices)))
    return F.coalesce(canonical(text, choices), F.when(F.size(named) == 1, F.element_at(named, 1)))


def parse_forced_choice(c: Column | str, choices: list[str], mode: str = "plain") -> Column:
    """Mode terminal: last line only; reasoning: last line, else the last answer line is no vote; plain: see plain_choice.  No label is 'unparseable'."""
    found = {"terminal": lambda: terminal_choice(c, choices), "reasoning": lambda: terminal_answer(c, choices), "plain": lambda: plain_choice(c, choices)}[mode]()
    return F.coalesce(found, F.lit("unparseable"))


def parse_action(c: Column | str, order: Column | str) -> Column:
    """`Action 1` or `Action 2`, swapped back where the order is 'reverse'."""
    n = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?i)action\s*([12])", 1)
    straight = F.when(n == "1", "first").when(n == "2", "second")
    return F.when(col(order) == "reverse", F.when(straight == "first", "second").when(straight == "second", "first")).otherwise(straight)


def degenerate_loop(c: Column | str, least_words: int = 40, ratio: float = 0.35) -> Column:
    words = F.filter(F.split(col(c), r"\s+"), lambda w: w != "")
    return (F.size(words) >= least_words) & (F.size(F.array_distinct(words)) / F.size(words) < ratio)


#: A label by itself, an answer line in any dress, the instruction quoted back, and how a finished text ends.
LABEL_TOKEN = r"(?<![A-Za-z0-9_])([AB])(?![A-Za-z0-9_])"
ANSWER_DRESSED = r"(?i)^[\s>*_#`\-]*(?:answer|final answer|choice)\s*[:\-]?\s*\**\s*([AB])\b"
INSTRUCTION_ECHO = r"(?i)(answer\s*[:\-]?\s*[\"'`]?A[\"'`]?\s*(?:or|/|,)\s*[\"'`]?(?:answer\s*[:\-]?\s*)?B)|(on (?:its|your) own line)|(exactly as)"
SENTENCE_END = r"[.!?\"')\]]\s*$"


#: Words that tell no option from another.
STOP_WORDS = """
a an and are as at be been being but by can could did do does for from had has have he her hers him his how i if in
into is it its me my no not of on or our ours she should so that the their theirs them then there these they this
to was we were what when where which who whom why will with would you your yours
""".split()


def recover(c: Column | str, endorse: bool = True, first: Column | str | None = None, second: Column | str | None = None, margin: int = 3) -> Column:
    """struct(tier, label): why a dropped response has no vote, or which weaker rule finds one; the first that holds.

    Texts that name neither label are compared with the words of the two options, if given: `semantic`, or `semantic_below_margin` without a label.
    """
    text = F.trim(F.coalesce(col(c), F.lit("")), F.lit(" \n\t\r"))
    tail = F.trim(F.coalesce(last_line(text), F.lit("")), F.lit(" \t\r"))
    found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(LABEL_TOKEN), F.lit(1)))
    closing = F.try_element_at(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != ""), F.lit(-1))
    dressed = F.upper(F.regexp_extract(tail, ANSWER_DRESSED, 1))
    short = F.when(F.length(tail) <= 4, found(tail))
    one = lambda xs: F.when(F.size(xs) == 1, F.element_at(xs, 1))
    pair = lambda tier, label=None: F.struct(F.lit(tier).alias("tier"), (F.lit(None).cast("string") if label is None else label).alias("label"))
    both = F.when(one(found(closing)).isNotNull(), pair("terminal_endorse", one(found(closing)))).otherwise(pair("ambiguous")) if endorse else pair("both_labels_skipped")
    if first is None or second is None:
        neither = pair("semantic_skipped")
    else:
        meant = semantic_label(text, first, second, margin)
        neither = F.when(meant.isNull(), pair("semantic_below_margin")).otherwise(pair("semantic", meant))
    return (
        F.when(text == "", pair("empty"))
        .when(text.contains("<think>"), pair("has_think"))
        .when(degenerate_loop(text), pair("degenerate_loop"))
        .when(~text.rlike(SENTENCE_END), pair("truncated"))
        .when(text.rlike(INSTRUCTION_ECHO), pair("instruction_echo"))
        .when(dressed != "", pair("terminal_label", dressed))
        .when(one(short).isNotNull(), pair("terminal_label", one(short)))
        .when(F.size(found(text)) == 1, pair("single_label", one(found(text))))
        .when(F.size(found(text)) == 2, both)
        .otherwise(neither)
    )


def content_words(c: Column | str) -> Column:
    """Distinct lower-case words of a-z and ' with three characters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z']+"), F.lit(0))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*map(F.lit, STOP_WORDS)))


def semantic_label(c: Column | str, first: Column | str, second: Column | str, margin: int = 3) -> Column:
    """The option whose own words, those the other one lacks, a text uses more often by the margin; else null."""
    a, b, body = content_words(first), content_words(second), content_words(c)
    gap = F.size(F.array_intersect(body, F.array_except(a, b))) - F.size(F.array_intersect(body, F.array_except(b, a)))
    return F.when((gap >= margin) & (gap > 0), "A").when(F.abs(gap) >= margin, "B")


#: Pronouns of a writer's own matter, and how boilerplate refusals start.
FIRST_PERSON = r"(?iU)\b(i|i'm|im|i've|i'd|i'll|my|me|mine|myself|we|we're|our|us)\b"
REFUSAL = r"(?iU)^i\s*('m|am)?\s*(sorry[,.]?\s*)?(but\s+)?(cannot|can't|can not|won't|will not|am not able to|'m not able to)\b"


def first_person_hits(c: Column | str) -> Column:
    """How often a text speaks of its writer."""
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(FIRST_PERSON)).cast("bigint")


def refuses(c: Column | str) -> Column:
    """Whether a turn starts as a refusal; one in the middle of a dialogue doesn't count."""
    return _strip(F.coalesce(col(c), F.lit(""))).rlike(REFUSAL)


def rejoin_reasoning(reasoning: Column | str, content: Column | str) -> Column:
    r, c = col(reasoning), col(content)
    return F.when(r.isNotNull() & c.isNotNull(), F.concat(F.lit("<think>"), r, F.lit("</think>\n"), c)).otherwise(F.coalesce(c, r))


def split_think(c: Column | str, open_prompt: bool = True) -> Column:
    """struct(reasoning, visible), split at the closing tag; without one the text is reasoning if the prompt or an opening tag opened a block."""
    text = F.coalesce(col(c), F.lit(""))
    close, opened = F.instr(text, "</think>"), F.instr(text, "<think>")
    before = F.substring(text, F.lit(1), close - 1)
    stripped = F.ltrim(before)
    reasoning = F.when(stripped.startswith("<think>"), F.substring(stripped, F.lit(8), F.length(stripped))).otherwise(before)
    rest = F.substring(text, close + 8, F.length(text))
    after_open = F.substring(text, opened + 7, F.length(text))
    pair = lambda a, b: F.struct(a.alias("reasoning"), b.alias("visible"))
    return F.when(close > 0, pair(reasoning, rest)).when(opened > 0, pair(after_open, F.lit(""))).otherwise(pair(text, F.lit("") if open_prompt else text))


def truncate_reasoning(c: Column | str, keep: int = 300) -> Column:
    """Reasoning that ends at or beyond `keep` is cut so that it fills `keep` characters with a note of its length; an open block is closed first."""
    text = F.trim(col(c), F.lit(" \n\t\r"))
    start, close = F.instr(text, "<think>"), F.instr(text, "</think>")
    whole = F.when((start > 0) & (close == 0), F.concat(text, F.lit("</think>"))).otherwise(text)
    end = F.instr(whole, "</think>") - 1
    size = F.when(start > 0, end - 7).otherwise(end)
    note = F.concat(F.lit("... [total "), size.cast("string"), F.lit(" symbols]</think>"))
    left = F.greatest(F.when(start > 0, start + 6).otherwise(F.lit(0)), F.lit(keep) - F.length(note))
    cut = F.concat(F.substring(whole, F.lit(1), left), note, F.substring(whole, end + 9, F.length(whole)))
    return F.when((end >= keep) & (text != ""), cut).otherwise(whole)


def _blocks(text: Column, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s){FENCE}([a-zA-Z0-9_+-]*)\n(.*?){FENCE}"), F.lit(group))


def _strip(x: Column) -> Column:
    return F.trim(x, F.lit(" \n\t\r\x0b\x0c"))


def extract_code(c: Column | str) -> Column:
    """The last fenced block, else the text, trimmed."""
    text = F.coalesce(col(c), F.lit(""))
    bodies = _blocks(text, 2)
    return _strip(F.when(F.size(bodies) > 0, F.element_at(bodies, -1)).otherwise(text))


#: Language tags of a fenced block.
TAGS = "python|java|c\\+\\+|cpp|csharp|c\\#|ts|js|typescript|javascript|rust|ruby|go|php|scala|kotlin"


def extract_code_first(c: Column | str) -> Column:
    """After any reasoning block the first fenced block of a known language or none, without placeholder comments; else empty."""
    text = F.coalesce(col(c), F.lit(""))
    close = F.instr(text, "</think>")
    after = F.when(close > 0, _strip(F.substring(text, close + 8, F.length(text)))).otherwise(text)
    block = F.regexp_extract(after, rf"(?is){FENCE}(\s*({TAGS})\s*\n)?(.*?){FENCE}", 3)
    return F.regexp_replace(block, "(?is)(#+|//+) YOUR CODE HERE", "")


def fence_count(c: Column | str) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return ((F.length(text) - F.length(F.replace(text, F.lit(FENCE), F.lit("")))) / 3).cast("int")


def extract_code_status(c: Column | str, finish_reason: Column | str) -> Column:
    """struct(code, status): truncated if a block is open or the length limit ended the text, empty without code, else ok; the code is the best there is."""
    text = F.coalesce(col(c), F.lit(""))
    opened = text.rlike(rf"{FENCE}[a-zA-Z0-9_+-]*\n") & (fence_count(text) % 2 == 1)
    rest = F.element_at(F.split(text, rf"{FENCE}[a-zA-Z0-9_+-]*\n"), -1)
    code = F.when(opened, _strip(rest)).otherwise(extract_code(text))
    status = F.when(_strip(text) == "", "empty").when(opened | (F.coalesce(col(finish_reason), F.lit("")) == "length"), "truncated").when(code == "", "empty").otherwise("ok")
    return F.struct(F.when(_strip(text) == "", "").otherwise(code).alias("code"), status.alias("status"))


def extract_code_lang(c: Column | str, finish_reason: Column | str, tags: list[str]) -> Column:
    """As extract_code_status, but of a text that is ok the last block with one of the tags wins over the last one."""
    text = F.coalesce(col(c), F.lit(""))
    plain = extract_code_status(text, finish_reason)
    own = F.filter(F.arrays_zip(_blocks(text, 1).alias("tag"), _blocks(text, 2).alias("body")), lambda x: F.lower(x["tag"]).isin(tags))
    return F.struct(F.when((plain["status"] == "ok") & (F.size(own) > 0), _strip(F.element_at(own, -1)["body"])).otherwise(plain["code"]).alias("code"), plain["status"].alias("status"))


def exact_fence(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(rf"(?s)^\s*{FENCE}[A-Za-z0-9_+#.-]*[ \t]*\n.*\n{FENCE}\s*$") & (fence_count(c) == 2)


#: How a bullet starts, and emphasis marks.
BULLET, EMPHASIS = r"^\s*(?:[-*•]\s+|\d{1,2}[.)]\s+)+", r"\*\*|__"


def bullets_to_prose(c: Column | str) -> Column:
    """Reasoning before the closing tag as prose: only its bullets if it has any, else all its lines, without marks; texts without the tag stay."""
    text = col(c)
    close = F.instr(text, "</think>")
    lines = F.transform(nonempty_lines(F.substring(text, F.lit(1), close - 1)), lambda x: _strip(x))
    bullets = F.filter(lines, lambda x: x.rlike(BULLET))
    source = F.when(F.size(bullets) > 0, bullets).otherwise(lines)
    bare = F.filter(F.transform(source, lambda x: _strip(F.regexp_replace(F.regexp_replace(x, BULLET, ""), EMPHASIS, ""))), lambda x: x != "")
    return F.when(close > 0, F.concat(F.array_join(bare, " "), F.lit("\n"), F.substring(text, close, F.length(text)))).otherwise(text)


def scrub_sentences(c: Column | str, banned: list[str]) -> Column:
    """struct(text, scrubbed): sentences with a banned word go; a text without any stays as it is."""
    text = F.coalesce(col(c), F.lit(""))
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    pattern = "(?i)(^|[^A-Za-z0-9_])(" + "|".join(re.escape(b) for b in banned) + ")([^A-Za-z0-9_]|$)"
    kept = F.filter(parts, lambda s: (F.trim(s) != "") & ~s.rlike(pattern))
    joined = _strip(F.regexp_replace(F.array_join(kept, " "), r"\s+([,.!?])", "$1"))
    changed = F.size(kept) < F.size(parts)
    return F.struct(F.when(changed, joined).otherwise(text).alias("text"), changed.alias("scrubbed"))


def ask_from_title(c: Column | str, marks: list[str], opening: str = "Would I be wrong") -> Column:
    """A title that opens with one of the marks and a connector as a plain question; null if it doesn't."""
    pattern = rf"(?is)^\W*(?:{'|'.join(map(re.escape, marks))})\b\W*(if|for|to|when|by)\b\s*(.+?)\s*\??$"
    title = _strip(F.coalesce(col(c), F.lit("")))
    rest = _strip(F.regexp_extract(title, pattern, 2))
    lowered = F.when(rest.rlike("^[A-HJ-Z][^A-Z ]*( |$)"), F.concat(F.lower(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))).otherwise(rest)
    return F.when(rest != "", F.concat(F.lit(opening + " "), F.lower(F.regexp_extract(title, pattern, 1)), F.lit(" "), lowered, F.lit("?")))


def compose(body: Column | str, ask: Column | str) -> Column:
    """The ask as a closing paragraph."""
    return F.concat(F.regexp_replace(col(body), r"\s+$", ""), F.lit("\n\n"), ask if isinstance(ask, Column) else F.lit(ask))


def closer_by_hash(key: Column | str, closers: list[str]) -> Column:
    """One of the closers by the first eight hexadecimal digits of the key's SHA-256."""
    n = F.conv(F.substring(F.sha2(col(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint") % len(closers)
    return F.element_at(F.array(*map(F.lit, closers)), (n + 1).cast("int"))


def strip_wrapper(c: Column | str, prefix: str) -> Column:
    return F.when(col(c).startswith(prefix), F.substring(col(c), F.lit(len(prefix) + 1), F.length(col(c)))).otherwise(col(c))


def strip_speaker(c: Column | str) -> Column:
    """Drops a leading `Name:` and quotes around the rest."""
    bare = F.regexp_replace(_strip(F.coalesce(col(c), F.lit(""))), r"^\s*[A-Z][\w' -]{0,30}:\s+", "")
    return F.when(bare.rlike('(?s)^["“].*["”]$') & (F.length(bare) >= 2), _strip(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)


def clean_html_text(c: Column | str, closed: bool = False) -> Column:
    """Two rounds of all named and numeric entities (an Arrow function; `closed`: only those with their semicolon), zero-width characters out, blank lines squeezed."""
    from .arrays import html_unescape, html_unescape_closed

    text = (html_unescape_closed if closed else html_unescape)(F.coalesce(col(c), F.lit("")))
    return _strip(F.regexp_replace(F.regexp_replace(text, r"[\x{200B}-\x{200F}\x{FEFF}]|&#x200[bB];", ""), "\n{3,}", "\n\n"))


def field_leak(c: Column | str, fields: list[str]) -> Column:
    """Names of hidden fields that a text mentions."""
    return F.array_compact(F.array(*(F.when(F.contains(col(c), F.lit(f)), F.lit(f)) for f in fields)))


def truncate_str(c: Column | str, most: int = 300) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most - 3), F.lit("..."))).otherwise(col(c))


def slug(c: Column | str) -> Column:
    """A name safe for files; `none` if nothing is left."""
    cleaned = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("none")), "[^A-Za-z0-9_.-]+", "-"), F.lit("-"))
    return F.when(cleaned == "", "none").otherwise(cleaned)


def safe_tag(c: Column | str) -> Column:
    """A lower-case name safe for paths; null if nothing is left."""
    tag = F.lower(F.trim(F.regexp_replace(col(c), "[^A-Za-z0-9_-]+", "-"), F.lit("-")))
    return F.when(tag != "", tag)


def render_prompt(template: str, **columns: Column | str) -> Column:
    """A template with {name} places filled by columns."""
    out = F.lit(template)
    for k, v in columns.items():
        out = F.replace(out, F.lit("{" + k + "}"), col(v).cast("string"))
    return out


def rotated(labels: list[str], turn: int) -> list[str]:
    return labels[turn:] + labels[:turn]


def cyclic_rotations(labels: Column, count: int) -> Column:
    """The first `count` rotations of a label array, 1 to its size."""
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.concat(F.slice(labels, i + 1, n - i), F.slice(labels, F.lit(1), i)))


def label_order_rewrite(c: Column | str, labels: list[str], turn: int) -> Column:
    """The listing `X, Y or Z` of labels in a prompt, rotated."""
    listing = lambda xs: ", ".join(xs[:-1]) + " or " + xs[-1]
    return F.replace(col(c), F.lit(listing(labels)), F.lit(listing(rotated(labels, turn))))


def semantic_answer(label: Column | str, labels: Column | str, options: Column | str) -> Column:
    """What a label stands for: the option in its place."""
    at = F.array_position(col(labels), col(label)).cast("int")
    return F.when(at > 0, F.get(col(options), at - 1))


#: Language names and their aliases.
LANGUAGES = {"cpp": ["c++", "cpp"], "csharp": ["c#", "csharp"], "javascript": ["javascript", "js"], "typescript": ["typescript", "ts"], "python": ["python"], "java": ["java"], "rust": ["rust"], "go": ["go"], "ruby": ["ruby"], "php": ["php"], "scala": ["scala"], "kotlin": ["kotlin"]}


def plang_fuzzy(c: Column | str) -> Column:
    """The language an alias stands for; null if it isn't known."""
    key = F.lower(F.trim(col(c)))
    out = F.lit(None).cast("string")
    for name, aliases in LANGUAGES.items():
        out = F.when(key.isin(aliases), F.lit(name)).otherwise(out)
    return out


def parse_freeform(c: Column | str, judged: Column | str, choices: list[str]) -> Column:
    """A label that the text itself settles, else the one a judge has given, else 'unparseable'."""
    return F.coalesce(terminal_choice(c, choices), plain_choice(c, choices), canonical(F.trim(col(judged)), choices), F.lit("unparseable"))


def parse_md_sections(c: Column | str) -> Column:
    """Review documents: array of struct(id, prompt, verdict) from `## id` sections with a `Verdict:` line."""
    parts = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?m)^## "), lambda s: F.trim(s) != "")
    body = lambda s: F.substring(s, F.instr(s, "\n") + 1, F.length(s))
    return F.transform(parts, lambda s: F.struct(F.trim(F.substring_index(s, "\n", 1)).alias("id"), F.trim(F.regexp_replace(body(s), r"(?m)^Verdict:.*$", ""), F.lit(" \n")).alias("prompt"), F.upper(F.regexp_extract(s, r"(?m)^Verdict:\s*(\w+)", 1)).alias("verdict")))


def chat_render(messages: Column | str, most_chars: int | None = None, banned: list[str] | None = None) -> Column:
    """`User: ...` and `Assistant:` with the last content of each role, from array of struct(role, text).

    Null without either role, if the result has more than `most_chars` characters (it is never cut), or if it holds a banned term, whatever its case.
    """
    last = lambda role: F.try_element_at(F.filter(col(messages), lambda m: m["role"] == role), F.lit(-1))["text"]
    whole = F.concat(F.lit("User: "), last("user"), F.lit("\nAssistant:\n"), last("assistant"))
    fine = F.exists(col(messages), lambda m: m["role"] == "user") & F.exists(col(messages), lambda m: m["role"] == "assistant")
    if most_chars is not None:
        fine = fine & (F.length(whole) <= most_chars)
    for term in banned or []:
        fine = fine & ~F.contains(F.lower(whole), F.lit(term.lower()))
    return F.when(fine, whole)


def run_timestamp(c: Column | str) -> Column:
    """A compact UTC stamp; the session's time zone is to be UTC."""
    return F.date_format(col(c), "yyyyMMdd'T'HHmmss'Z'")


def parse_timestamp(c: Column | str) -> Column:
    """The time that an ISO text tells, with or without fractions and an offset (Z too); null if it is none."""
    return F.coalesce(*(F.try_to_timestamp(col(c), F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd")))
