"""Secret scan by assignment-aware lexing.

Three base patterns find assigned secrets, access keys and long hexadecimal runs.  Beside them a lexer reads source and configuration lines into
name-literal pairs (name = value, name: value, name: type = value, "name": "value", name => value), with quoted literals, bare words, concatenations and references.
A value may start on the next line: a quoted literal that is no name there, or a word that stands alone.
Constants are propagated: `k = "..."` and later `password = k + "..."` make the literals of both count for `password`.  A literal is scored
by how sensitive the best name it reaches is and by its length, variety and entropy; those over `LEAST_SCORE` are added as spans of kind `literal`,
unless a base span holds them already.

Places are code points, ends exclusive; a base span is the whole match.  Defined cases: null text is empty; a text without findings gives zero counts and empty lists; repeated rows are
judged each; names that are assigned more than once pass on every literal; reference cycles end; columns beyond doc_id and text are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_slices, table

KINDS = ("assign", "access", "hex", "literal")
LEAST_SCORE = 0.45


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run's end is the same from any start, so short runs hold no longer match
HEX = re.compile(r"[0-9a-f]{32,}")

OPERATOR = re.compile(r"[=:]")
PAIR = re.compile(r"""(?<![A-Za-z0-9_.$-])["']?([A-Za-z_$][A-Za-z0-9_.$-]*+)["']?[ \t]*+(:=|=>|=(?![=>])|:(?![:=/]))[ \t]*+""")  # possessive: no run is read twice
TYPED = re.compile(r"([A-Za-z0-9_.|&*?<>\[\](),' \t]++)=(?![=>])[ \t]*+")
TYPE = re.compile(r"(?:[&*]*(?:const|mut|static|dyn|final|readonly|unsigned)[ \t]++|&'[a-z_]++[ \t]++)*+[&*]*+[A-Za-z_][A-Za-z_.]*+[0-9]{0,3}[?&*]*+")
NEXT = re.compile(r"(?:[(\\][ \t]*+)?\r?\n[ \t]*+")
ALONE = re.compile(r"[ \t]*+[,;)]*+[ \t]*+(?:\r?\n|\r?\Z)")
NAMED = re.compile(r"[ \t]*+[:=]")
TERM = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([A-Za-z0-9_.$+/=@!#%^&*~-]+)""")
PLUS = re.compile(r"[ \t]*+(?:\+|\.\.|\.)[ \t]*+(?:(?=[\"'`A-Za-z_$])|\\?\r?\n[ \t]*+(?=[\"'`]))")
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*\Z")
#: How sensitive a name is that holds one of these words.
SENSITIVE = ((1.0, ("password", "passwd", "passphrase", "pwd", "private_key", "client_secret", "secret")), (0.9, ("api_key", "apikey", "access_key", "auth_token", "access_token", "token", "credential", "bearer")), (0.5, ("auth", "_key", "signature", "signing", "salt", "cert")))
PLACEHOLDER = re.compile(r"(?i)example|changeme|change_me|placeholder|your[_-]|dummy|sample|redacted|\*{3}|x{4}|^\$|^<|^%|\{\{|^(true|false|null|none|undefined)$")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the three base patterns, ascending."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    plain = name.lower().replace("-", "_")
    return next((w for w, words in SENSITIVE if any(x in plain for x in words)), 0.0)


def literal_score(literal: str, weight: float) -> float:
    if len(literal) < 8 or " " in literal or PLACEHOLDER.search(literal):
        return 0.0
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit)) + (not literal.isalnum())
    return weight * (0.4 * min(1, entropy / 3.5) + 0.3 * min(1, n / 16) + 0.3 * min(1, (kinds - 1) / 2))


def is_type(text: str) -> bool:
    """Whether text reads as a type: words that | joins, with anything in brackets behind them."""
    depth, out = 0, []
    for c in text:
        depth += (c in "[<(") - (c in "]>)")
        if depth < 0:
            return False
        if not depth and c not in "]>)":
            out.append(c)
    return not depth and all(TYPE.fullmatch(x.strip()) for x in "".join(out).split("|"))


class Lexed:
    """Name-literal pairs of a text and the names that reach each literal."""

    def __init__(self, text: str):
        self.names: list[tuple[str, list[tuple[str, int, int]], list[str]]] = []  # name, literals, references
        done = -1
        for m in OPERATOR.finditer(text):
            if m.start() < done:
                continue
            a = max(text.rfind("\n", 0, m.start()) + 1, done)
            b = text.find("\n", m.start())
            to = len(text) if b < 0 else b
            done = max(to, self._line(text, a, to))

    def _line(self, text: str, at: int, to: int) -> int:
        """Reads the pairs of a line and tells where it ended; a value may lie on later lines."""
        while m := PAIR.search(text, at, to):
            at, literals, references = m.end(), [], []
            if m.group(2) == ":" and (typed := TYPED.match(text, at, to)) and is_type(typed.group(1)):
                at = typed.end()
            if (below := NEXT.match(text, at)) and (t := TERM.match(text, below.end())):
                bare = t.group(4) is not None
                if not PAIR.match(text, t.start()) and (ALONE.match(text, t.end()) if bare else not NAMED.match(text, t.end())):
                    at = below.end()
            while t := TERM.match(text, at):
                group = next(k for k in (1, 2, 3, 4) if t.group(k) is not None)
                value = t.group(group)
                if group == 4 and NAME.match(value):
                    references.append(value)
                literals.append((value, t.start(group), t.end(group), group == 4))
                at = t.end()
                plus = PLUS.match(text, at)
                if not plus:
                    break
                at = plus.end()
            self.names.append((m.group(1), literals, references))
            at = max(at, m.end())
        return at

    def findings(self) -> list[tuple[int, int, str, float]]:
        """(start, end, name, score) of every literal, with the most sensitive name that it reaches."""
        if not any(name_weight(n) for n, _, _ in self.names):
            return []
        defined = {n for n, _, _ in self.names}
        users: dict[str, set[str]] = {}
        for n, _, references in self.names:
            for r in references:
                if r in defined and r != n:
                    users.setdefault(r, set()).add(n)
        best = {n: (name_weight(n), n) for n in defined}
        ready = deque(sorted(defined, key=lambda n: (-best[n][0], n)))
        sources: dict[str, list[str]] = {}
        for r, ns in users.items():
            for n in ns:
                sources.setdefault(n, []).append(r)
        while ready:  # the most sensitive name flows back to what its value is made of
            n = ready.popleft()
            for r in sources.get(n, ()):
                if best[n][0] > best[r][0]:
                    best[r] = best[n]
                    ready.append(r)
        out = []
        for n, literals, _ in self.names:
            weight, target = best[n]
            for value, a, b, bare in literals:
                if weight and not (bare and value in defined):
                    score = literal_score(value, weight * (0.9 if bare else 1.0))
                    if score >= LEAST_SCORE:
                        out.append((a, b, target, score))
        return sorted(set(out))


FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
FINDINGS = "array<struct<kind:string,start:long,end:long,name:string,score:double>>"


def find(text: str) -> list[dict]:
    base = base_spans(text)
    out = [{"kind": KINDS[k], "start": a, "end": b, "name": None, "score": 1.0} for a, k, b in base]
    if "=" in text or ":" in text:
        starts, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))  # how far the base spans up to one go
        for a, b, name, score in Lexed(text).findings():
            k = bisect_right(starts, a)
            if not k or reach[k - 1] < b:
                out.append({"kind": "literal", "start": a, "end": b, "name": name, "score": score})
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))


def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, "text", 16 << 20):
        found = [find(x or "") for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(FINDING))], names=["doc_id", "findings"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, findings) of every row: spans by start, then kind as in KINDS."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan_rows, f"doc_id long, findings {FINDINGS}")


def masked(text: str | None, mask: str = "[SECRET]") -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for x in find(text):
        if x["end"] <= at:
            continue
        if x["start"] >= at:
            out += [text[at : x["start"]], mask]
        at = x["end"]
    return "".join([*out, text[at:]]) if out else text


def mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, "text", 16 << 20):
        k = batch.schema.get_field_index("text")
        clean = pa.array([masked(x) for x in batch.column(k).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([clean if i == k else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with every finding in text replaced by a mark; all rows and columns stay."""
    return docs.mapInArrow(mask_rows, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"] != "literal")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("findings")).alias("spans"))
