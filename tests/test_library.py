"""Operators that SQL can't express against plain versions, and sinks and streams over restarts."""

import difflib
import itertools
import math
import random
import time
from collections import Counter, defaultdict

import pytest
from duck import assert_same
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions import text, tokens
from lodestone.operators import allocation, graphs, guards, matching, ranking, rollups, traces, validation
from lodestone.sources import readers, writers
from lodestone.streaming import attempts
from lodestone.tables import derived

FOLDER = "/root/testdata/sf0.001"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_long_texts_meet_snippets_in_seconds(spark):
    rnd = random.Random(1)
    long = words(rnd, 20_000)
    parts = long.split()
    snippets = [(0, " ".join(parts[9000:9020])), (1, " ".join(parts[5:15])[2:-2]), (2, "not in the long text at all, never"), (3, "abcdefghabcdefghabcdefghabcdefgh"), (4, "xxabcdefghabcdefgh yyabcdefghabcdefgh"), (5, "ends here with three"), (6, "aaaaaaaaaaaaaaaa mid bbbbbbbbbbbbbbbbbb")]
    texts = [(0, long), (1, "pre" + snippets[3][1] + "post"), (2, "1" + snippets[4][1] + "2 z"), (3, "x" + snippets[6][1] + "y"), (None, snippets[0][1]), (5, None), (6, "")]
    began = time.time()
    t, s = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(snippets, "i long, text string")
    got = {(r.k, r.i) for r in matching.snippet_overlap(t, "k", s, "i").collect()}
    assert time.time() - began < 30
    norm = lambda x: " ".join(x.split()).lower()
    assert got == {(k, i) for k, x in texts if x for i, y in snippets if len(norm(y)) >= 25 and norm(y) in norm(x)}
    assert matching.snippet_overlap(t, "k", s.limit(0), "i").count() == 0 and matching.snippet_overlap(t.limit(0), "k", s, "i").count() == 0


def test_similar_pairs_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        if k % 4 == 3:
            parts = rows[rnd.randrange(len(rows))][2].split(" ")
            for _ in range(rnd.randrange(0, 4)):
                parts[rnd.randrange(len(parts))] = words(rnd, 1)
            rows.append((k, f"g{k % 2}", " ".join(parts)))
        else:
            rows.append((k, f"g{k % 2}", words(rnd, 30)))
    rows += [(100, "g0", None), (101, "g0", ""), (102, None, rows[0][2]), (103, None, rows[0][2] + "!")]
    df = spark.createDataFrame(rows, "id long, grp string, text string")
    first = {}
    for k, g, t in sorted(rows, key=lambda r: r[0]):
        first.setdefault((g, t or ""), k)
    want = set()
    for (ga, ta), (gb, tb) in itertools.combinations(first, 2):
        if ga == gb:
            (a, ta), (b, tb) = sorted([(first[ga, ta], ta), (first[gb, tb], tb)])
            if difflib.SequenceMatcher(None, ta, tb).ratio() >= 0.7:
                want.add((ga, a, b))
    assert len(want) > 5
    assert {(r.grp, r.id_a, r.id_b) for r in matching.similar_in_group(df, 0.7).collect()} == want
    links = Counter(x for _, a, b in want for x in (a, b))
    got = {r.id: (r.class_id, r.n_links) for r in matching.linked_in_group(df, 0.7).collect()}
    assert got == {k: (first[g, t or ""], links[first[g, t or ""]]) for k, g, t in rows}


def test_matched_characters_are_those_of_difflib():
    rnd = random.Random(12)
    pairs = []
    for _ in range(400):
        letters = "abcdefghijklmnopqrstuvwxyz"[: rnd.choice((2, 4, 26))]
        x, y = ("".join(rnd.choice(letters) for _ in range(rnd.choice((0, 1, 5, 60, 199, 200, 400)))) for _ in range(2))
        if rnd.random() < 0.6:
            y = x
            for _ in range(rnd.randrange(12)):
                at = rnd.randrange(len(y) + 1)
                y = y[:at] + rnd.choice(["Q", "\U0001f600", "ab", "zZ#", ""]) + y[at + rnd.randrange(6) :]
        pairs.append((x, y))
    firsts, seconds = [matching._codes(x) for x, _ in pairs], [matching._Second(y) for _, y in pairs]
    ratios = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    got = matching.matched(firsts, seconds, [0] * len(pairs))
    assert [2.0 * m / len(x + y) if x + y else 1.0 for m, (x, y) in zip(got, pairs, strict=True)] == ratios
    for least in (0.3, 0.7, 0.9):
        needs = [matching.needed(len(x) + len(y), least) for x, y in pairs]
        for whole in (True, False):
            assert [m >= 0 for m in matching.matched(firsts, seconds, needs, whole)] == [r >= least for r in ratios]


def test_texts_that_share_a_half_are_decided_soon(spark):
    rnd = random.Random(13)
    shared = words(rnd, 170)
    rows = [(k, "g", f"{shared} {words(rnd, 170)}") for k in range(300)] + [(900, "g", None), (901, "g", "")]
    rows += [(1000 + k, "g", rows[k][2] + "!") for k in range(5)]
    began = time.time()
    got = {r.id: r.n_links for r in matching.linked_in_group(spark.createDataFrame(rows, "id long, grp string, text string"), 0.7).collect()}
    assert time.time() - began < 90
    texts = {k: t for k, _, t in rows}
    alike = lambda x, y: difflib.SequenceMatcher(None, texts[x], texts[y]).ratio() >= 0.7
    assert all(alike(k, 1000 + k) for k in range(5)) and not any(alike(k, k + 1) for k in range(20))
    assert got == {k: int(k < 5 or k >= 1000) for k in texts}


def altered(rnd, text, every, letters):
    """The text with about one in `every` characters exchanged."""
    out = list(text)
    for at in range(rnd.randrange(every), len(out), every):
        out[at] = rnd.choice(letters)
    return "".join(out)


def many_letters(rnd, n, letters):
    return "".join(rnd.choice(letters) for _ in range(n))


def test_pairs_with_few_common_runs_are_found_in_any_blocks(spark, monkeypatch):
    """Texts with a ratio of 0.7 that share hardly a run of eight characters, on both sides of difflib's length for frequent characters and in many blocks."""
    rnd = random.Random(17)
    rows, wide = [], [chr(0x4E00 + k) for k in range(300)]
    for size, letters in ((120, "abcdefghijklmnopqrstuvwxyz"), (190, wide[:40]), (210, wide), (600, wide), (600, [*"etaoinshr ", *wide])):
        base = many_letters(rnd, size, letters)
        for _ in range(6):
            cut = altered(rnd, base, rnd.choice((4, 5, 6, 7)), letters)
            rows.append((len(rows), "g" if size % 200 else None, cut[: len(cut) - rnd.choice((0, 0, size // 3))]))
        rows.append((len(rows), "g" if size % 200 else None, base))
    texts = {k: (g, t) for k, g, t in rows}
    assert len({t for _, t in texts.values()}) == len(rows)
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if texts[a][0] == texts[b][0] and difflib.SequenceMatcher(None, texts[a][1], texts[b][1]).ratio() >= 0.7}
    runs = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
    few = [(a, b) for a, b in want if 10 * len(runs(texts[a][1]) & runs(texts[b][1])) < len(runs(texts[a][1]) | runs(texts[b][1]))]
    assert len(few) > 10
    monkeypatch.setattr(matching, "BLOCK_TEXTS", 3)
    df = spark.createDataFrame(rows, "id long, grp string, text string")
    assert [(r.id_a, r.id_b) for r in matching.similar_in_group(df, 0.7).orderBy("id_a", "id_b").collect()] == sorted(want)
    links = Counter(x for pair in want for x in pair)
    assert {r.id: r.n_links for r in matching.linked_in_group(df, 0.7).collect()} == {k: links[k] for k in texts}


def test_bounds_leave_out_no_pair():
    rnd = random.Random(18)
    found = kept = met = 0
    for _ in range(12):
        letters = "abcdefghijklmnopqrstuvwxyz ABCDE,.\n"[: rnd.choice((2, 5, 12, 35))] + rnd.choice(("", "\U0001f600\u00e9\u6f22"))
        draw = lambda n: "".join(rnd.choice(letters if rnd.random() < 0.3 else letters[:8]) for _ in range(n))  # noqa: B023, E731
        base = draw(rnd.choice((30, 150, 199, 205, 500, 900)))
        texts = [draw(300), draw(1)]
        for _ in range(10):
            y = base
            for _ in range(rnd.randrange(len(base) // 6 + 2)):
                at = rnd.randrange(len(y) + 1)
                y = y[:at] + draw(rnd.randrange(3)) + y[at + rnd.randrange(4) :]
            texts.append(y * rnd.choice((1, 1, 1, 2)) or "x")
        ratios = {(i, j): difflib.SequenceMatcher(None, texts[i], texts[j]).ratio() for j in range(len(texts)) for i in range(j)}
        for least in (0.3, 0.7, 0.9, 1.0):
            want = {p for p, r in ratios.items() if r >= least}
            got = {(int(i), k) for on, k in matching.bounded([matching._codes(t) for t in texts], texts, list(range(len(texts))), least) for i in on}
            assert want <= got
            found, kept, met = found + len(want), kept + len(got), met + len(ratios)
    assert 200 < found <= kept < met


CUT = [(1, "R&amp;D &amp;quot;x&amp;quot; cut&amp</title>&copy 1 &copy; 2"), (2, "&amp;amp</title>\n\n\n\n&middot;&am"), (3, None), (4, ""), (5, "&amp;amp;amp; &amp;copy &quot; \u200b")]


def held_against_sql_on_cut_entities(spark, tmp_path, name):
    spark.createDataFrame(CUT, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/spark")
    next((tmp_path / "spark").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    return assert_same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], str(tmp_path))


def test_clean_html_text_on_cut_entities(spark, tmp_path):
    assert held_against_sql_on_cut_entities(spark, tmp_path, "clean_html_text") == len(CUT)
    got = spark.createDataFrame([("a&lt;b &#38;amp &notit; &#x26;copy &lt",)], "t string").select(text.clean_html_text("t", closed=True).alias("c"), text.clean_html_text("t").alias("o")).first()
    assert got.c == "a<b &amp &notit; &copy &lt" and got.o == "a<b & ¬it; © <"


def test_html_unescape_on_cut_entities(spark, tmp_path):
    assert held_against_sql_on_cut_entities(spark, tmp_path, "html_unescape") == len(CUT)


def test_greedy_assign_against_the_plain_walk(spark):
    rnd = random.Random(8)
    rows = [(f"f{q % 3}", q, q * 10 + s, f"f{q % 3}|{s}", f"f{q % 3}|{s}|{rnd.randrange(3)}") for q in range(90) for s in range(3)]
    df = spark.createDataFrame(rows, "family string, question long, record long, cell string, slot string")
    tie = {r.question: r.h for r in df.select("question", allocation.hash_key(42, "question").alias("h")).distinct().collect()}
    share = {r.family: r.alloc for r in allocation.largest_remainder(df.groupBy("family").agg(F.count("*").alias("n")), "family", 50).collect()}
    want = []
    for family in sorted(share):
        pool, slots, cells, taken = [r for r in rows if r[0] == family], Counter(), Counter(), set()
        for turn in range(share[family]):
            best = min((r for r in pool if r[1] not in taken), key=lambda r: (slots[r[4]], cells[r[3]], tie[r[1]], r[1], r[2]))
            taken.add(best[1])
            slots[best[4]] += 1
            cells[best[3]] += 1
            want.append((*best, turn))
    assert sorted(tuple(r) for r in allocation.greedy_assign(df, 50).collect()) == sorted(want)
    with pytest.raises(guards.GuardError):
        allocation.greedy_assign(df, 91).collect()


def test_token_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    names = ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"]
    counts = {d.doc_id: [tokens.counter(n)(f"User: {d.text or ''}\nAssistant:\n") for n in names] for d in docs}
    assert {tuple(r) for r in registry.QUERIES["token_budget"](spark, FOLDER).collect()} == {(k, v[0]) for k, v in counts.items() if v[0] <= 512}
    assert {tuple(r) for r in registry.QUERIES["multi_tokenizer_gate"](spark, FOLDER).collect()} == {(k, max(v), max(v) <= 600) for k, v in counts.items()}
    odd = spark.createDataFrame([(None,), ("",), ("<|endoftext|>",)], "t string").select(tokens.token_count("t", names[0])).collect()
    assert [r[0] for r in odd][:2] == [0, 0] and odd[2][0] > 1


def test_ratios_of_all_turns(spark):
    turns = defaultdict(dict)
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        turns[r.conv_id][r.turn] = r.text
    want = {}
    for c, x in turns.items():
        for a, b in itertools.pairwise(sorted(x)):
            want[c, a] = round(difflib.SequenceMatcher(None, x[a], x[b]).ratio(), 6)
    assert {(r.conv_id, r.turn): r.ratio for r in registry.QUERIES["seq_ratio"](spark, FOLDER).collect()} == pytest.approx(want, abs=1e-6)


def known_answers(spark, n):
    true = {i: (i - n / 2) / 3 for i in range(n)}
    rows = [(a, b, 0.5 * (1 + math.erf((true[a] - true[b]) / 2))) for a in true for b in true if a < b]
    return spark.createDataFrame([(i,) for i in true], "id long"), spark.createDataFrame(rows, "a long, b long, probability_a double")


def test_a_fit_over_partitions_is_the_same_fit(spark):
    _, edges = known_answers(spark, 6)
    one = {r.id: (r["mean"], r.variance) for r in graphs.fit_thurstone(edges, epochs=12).collect()}
    many = {r.id: (r["mean"], r.variance) for r in graphs.fit_spread(edges.repartition(3), epochs=12).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-9) for k in one)


def test_active_loop_reaches_its_target_and_the_order(spark):
    options, answers = known_answers(spark, 10)
    fitted, edges = graphs.active_loop(options, answers, 4, 5, multiplier=1.0)
    want = graphs.target_edges(10, 1.0)
    assert want == 33 and edges.distinct().count() == edges.count() and want <= edges.count() < want + 5
    means = [r["mean"] for r in fitted.orderBy("id").collect()]
    assert means == sorted(means)
    every = graphs.active_loop(options, answers, 4, 30, multiplier=9.0, epochs=50)[1]
    assert every.count() == 45  # no pair is left
    sure = graphs.active_loop(options, answers, 4, 5, multiplier=0.1, threshold=0.5, epochs=50)[1]
    assert sure.count() == 45


def test_bootstrap_of_few_items(spark):
    one = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "item string, arm string, v double")
    deltas = rollups.paired_deltas(one, "item", "arm", "v", "x", "y")
    assert [tuple(r) for r in deltas.collect()] == [("a", 1.0)] and rollups.paired_bootstrap(deltas, "item").count() == 0


def test_recovery_by_the_words_of_options(spark):
    rows = [("The lively garden party pleased everyone.", "a garden party, lively", "quiet reading alone"), ("Nothing here fits.", "garden", "reading"), ("So quiet, reading alone.", "a garden party", "quiet reading alone")]
    got = spark.createDataFrame(rows, "t string, x string, y string").select(text.recover("t", True, "x", "y").alias("r")).collect()
    assert [(r.r.tier, r.r.label) for r in got] == [("semantic", "A"), ("semantic_below_margin", None), ("semantic", "B")]


def test_a_clean_trace_set_passes_every_gate(spark):
    thought = "We weigh both chores by the time that they take and by the weather of the day. "
    rows = [(k, 0, ["A", "B"], "AB"[k % 2], True, f"{thought * 4}Case {k} is settled.</think>\n\nAnswer: {'AB'[k % 2]}") for k in range(6)]
    df = spark.createDataFrame(rows, "record_id long, sibling int, labels array<string>, answer string, verifiable boolean, completion string")
    source = spark.createDataFrame([(k, k, "Option A:\nx\n\nOption B:\ny\n") for k in range(6)], "record_id long, content_id long, prompt string")
    gate = {r.gate: r for r in traces.trace_gate(df, source, 6).collect()}
    assert set(gate) == set(traces.GATES) and all(r.passed for r in gate.values()) and not any(r.warning for r in gate.values())
    assert not traces.trace_gate(df, source, 5).filter("NOT passed").isEmpty()
    assert {r[0] for r in df.select(traces.trace_problem("completion", text.word_count(traces.halves("completion")[0]))).collect()} == {None}


def test_caps_and_first_rows(spark):
    rows = [(k, None if k % 3 == 0 else "hot" if k % 3 == 1 else f"a{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, author string")
    kept = {r.id for r in ranking.cap_per_key(df, "author", 2, "id").collect()}
    assert kept == {k for k, a in rows if a != "hot"} | {1, 4}
    assert {tuple(r) for r in ranking.dedup_first(df.select("author", "id"), ["author"], "id").collect()} == {("hot", 1), (None, 0)} | {(a, k) for k, a in rows if a and a != "hot"}
    assert ranking.dedup_drop_all(df, "author").count() == 1000


def test_torn_logs(spark):
    path = writers.scratch(spark, "log")
    lines = [f'{{"id": {k}}}' for k in range(2000)]
    spark.createDataFrame([(x,) for x in [*lines, '{"id": 20']], "value string").coalesce(1).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several tasks read one file
    try:
        assert readers.scan_torn_tail(spark, path, "id long").count() == 2000
        broken = writers.scratch(spark, "log")
        spark.createDataFrame([(x,) for x in [*lines[:500], '{"id": 20', *lines[500:]]], "value string").coalesce(1).write.text(broken)
        with pytest.raises(guards.GuardError):
            readers.scan_torn_tail(spark, broken, "id long")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_versions_of_a_table(spark):
    path = writers.scratch(spark, "table")
    with pytest.raises(FileNotFoundError):
        writers.read_atomic(spark, path)
    for k in range(4):
        writers.sink_atomic(spark.range(k + 1), path)
        before = writers.read_atomic(spark, path)
        assert before.count() == k + 1
    spark.range(50).write.parquet(f"{path}/left-by-a-crash")  # without its mark it isn't there
    assert writers.read_atomic(spark, path).count() == 4 and len(writers._versions(spark, path)) == 2


def test_shards(spark):
    path = writers.scratch(spark, "shards")
    writers.sink_shards(spark.range(3), path, "train", 5)
    assert {r.id for r in readers.scan_shards_complete(spark, path, "train", ["id"]).collect()} == {0, 1, 2}
    with pytest.raises(guards.GuardError):
        readers.scan_shards_complete(spark, path, "dev", ["id"])


def test_latest_goes_on_after_a_restart(spark):
    log, folder, progress = (writers.scratch(spark, n) for n in ("log", "state", "progress"))
    rows = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 7).alias("k"), F.col("id").alias("pos"))
    run = lambda: attempts.latest(attempts.read(spark, log, "k long, pos long", 1), folder, progress, ["k"], "pos", 2)
    want = {}
    for lo in range(0, 50, 10):
        rows(lo, lo + 10).coalesce(1).write.mode("append").parquet(log)
        want |= {k % 7: k for k in range(lo, lo + 10)}
        assert {r.k: r.pos for r in run().collect()} == want


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://somewhere:7077", "none"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        writers.scratch(Session(), "x")


def test_derived_traces_break_every_gate(spark):
    rows = derived(spark, "/root/testdata/sf0.01", "traces").withColumn("labels", F.split("labels", ","))
    source = rows.select(F.when(F.col("record_id") % 100 == 98, -1 - F.col("record_id")).otherwise(F.col("record_id")).alias("record_id"), "content_id", "prompt")
    gates = {r.gate: r.n for r in traces.trace_gate(rows.drop("content_id", "prompt", "label"), source, 1).collect()}
    assert all(gates.values())


def test_snippets_without_broadcasts(spark, monkeypatch):
    texts = [(k, f"one two three {k % 5} four five six seven eight {k}") for k in range(40)]
    snippets = [(i, f"three {i} four five six seven") for i in range(7)]
    t, s = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(snippets, "i long, text string")
    run = lambda: {(r.k, r.i) for r in matching.snippet_overlap(t, "k", s, "i").collect()}
    one = run()
    assert one == {(k, k % 5) for k in range(40)}
    monkeypatch.setattr(matching, "MOST_BROADCAST", 0)
    assert run() == one


def test_checks_of_empty_tables(spark):
    heads = "line_no long, id string, intervention_id string, task string, language_id string, split string, source string, license string, messages array<struct<role:string,content:string>>"
    bench = spark.createDataFrame([(1, "a snippet of more than twenty-five characters")], "item_id long, text string")
    assert validation.dataset_problems(spark.createDataFrame([], heads), {"task": "x"}, "train", bench, "item_id").count() == 0
    odd = spark.createDataFrame([(1, "a", "i", "x", "l", "train", "s", "m", None), (2, "b", "i", "x", "l", "train", "s", "m", []), (3, "c", "i", "x", "l", "train", "s", "m", [(None, None), ("assistant", "fine")])], heads)
    got = {r.line_no: r.problems for r in validation.dataset_problems(odd, {"task": "x"}, "train", bench, "item_id").collect()}
    assert got == {1: ["missing messages"], 2: ["too_few"], 3: ["role", "content", "no_user", "duplicate_prompt"]}
    rows = "line_no long, schema string, mock_note string, record_id string, dataset_id string, teacher_model string, teacher_pass_rate double, messages array<struct<role:string,content:string>>"
    source = spark.createDataFrame([("r", "d", "ask")], "record_id string, dataset_id string, expected string")
    assert validation.distill_problems(spark.createDataFrame([], rows), source).count() == 0
    good = spark.createDataFrame([(1, validation.DISTILL_SCHEMA, None, "r", "d", "t", 1.0, [("user", "ask"), ("assistant", "```python\nx\n```")]), (2, None, None, None, None, None, None, None)], rows)
    assert {r.line_no: r.problems for r in validation.distill_problems(good, source).collect()} == {1: [], 2: ["schema", "record_id"]}
    cache = spark.createDataFrame([], "question_id long, prompt string, output_list array<string>, code_list array<string>")
    assert {r.problem: r.n for r in validation.cache_preflight(cache, spark.range(2).toDF("question_id"), 2, "go").collect()}["missing"] == 2
    traced = "record_id long, sibling int, labels array<string>, answer string, verifiable boolean, completion string"
    gates = traces.trace_gate(spark.createDataFrame([], traced), spark.createDataFrame([], "record_id long, content_id long, prompt string")).collect()
    assert len(gates) == len(traces.GATES) and all(r.n == 0 and r.passed for r in gates)
    assert spark.createDataFrame([(None, None)], "v string, s array<string>").select(validation.cell_problems("v", "s")).first()[0] == ["sets"]
