"""Identities that hold whatever the data, and cases that define semantics."""

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import arrays, compare, maths, text
from lodestone.operators import allocation, graphs, guards, pairwise, ranking, rollups
from lodestone.sources import readers, writers


def votes(spark, rows):
    return spark.createDataFrame(rows, "a int, b int, direction string, label string")


def test_swapping_direction_and_label_changes_nothing(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), 3 + rnd.randrange(3), rnd.choice(["original", "flipped"]), rnd.choice(["A", "B", None])) for _ in range(200)]
    swap = {"original": "flipped", "flipped": "original", "A": "B", "B": "A", None: None}
    turned = [(a, b, swap[d], swap[x]) for a, b, d, x in rows]
    get = lambda r: {(x.a, x.b): round(x.probability_a, 12) for x in pairwise.edge_prob(votes(spark, r)).collect()}
    straight = get(rows)
    assert straight == get(turned)
    reverse = get([(b, a, swap[d], x) for a, b, d, x in rows])
    assert all(abs(p + (1 - p) - 1) < 1e-12 and abs(reverse[b, a] - p) < 1 for (a, b), p in straight.items())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(1, 40))
def test_step_split_adds_up(sizes, stages):
    total = sum(sizes)
    parts = ranking.step_split(total, stages)
    assert sum(parts) == total and max(parts) - min(parts) <= 1 and parts == sorted(parts, reverse=True)


def test_largest_remainder_adds_up(spark):
    counts = spark.createDataFrame([("a", 7), ("b", 7), ("c", 1), ("d", 85)], "k string, n long")
    got = {r.k: r.alloc for r in allocation.largest_remainder(counts, "k", 33).collect()}
    assert sum(got.values()) == 33 and all(abs(got[k] - 33 * n / 100) < 1 for k, n in (("a", 7), ("b", 7), ("c", 1), ("d", 85)))


def test_equal_cells(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 9), ("c", 2), ("d", 9)], "k string, n long")
    for want in (0, 3, 8, 17, 18, 25, 40):
        got = {r.k: r.keep for r in allocation.equal_cells(counts, "k", want).collect()}
        cells = {"a": 5, "b": 9, "c": 2, "d": 9}
        while sum(cells.values()) > want:  # the walk: always from the largest, the last by key first
            top = max(cells.values())
            cells[max(k for k, v in cells.items() if v == top)] -= 1
        assert got == cells, want


def test_hash_sample_is_prefix_stable(spark):
    df = spark.range(500).toDF("id")
    some = lambda n: {r.id for r in allocation.hash_order_sample(df, "id", n).collect()}
    assert some(20) < some(21) < some(90)
    ranks = sorted(r["_rank"] for r in allocation.hash_rank(df, "id", 42).collect())
    assert ranks == list(range(1, 501))


def test_ranked_is_a_permutation(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("k"), "id")
    rows = ranking.ranked(df, "k", "id").orderBy("_rank").collect()
    assert [r["_rank"] for r in rows] == list(range(1, 1001)) and [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


def test_pass_at_k(spark):
    rows = [(n, c) for n in range(1, 7) for c in range(n + 1)]
    df = spark.createDataFrame(rows, "n int, c int").select("n", "c", *(maths.pass_at_k("n", "c", k).alias(f"k{k}") for k in (1, 2, 3)))
    for r in df.collect():
        assert abs(r.k1 - r.c / r.n) < 1e-12
        for k in (1, 2, 3):
            if r.n >= k:
                want = 1 - math.comb(r.n - r.c, k) / math.comb(r.n, k)
                assert abs(r[f"k{k}"] - want) < 1e-12


def test_decompose_adds_up(spark):
    r = spark.sql("SELECT 0.3D t0, 0.7D q0, 0.9D t1, 0.2D q1").select(maths.decompose("t0", "q0", "t1", "q1").alias("x")).first().x
    assert abs(r.from_termination + r.from_quality - r.delta) < 1e-12


def test_normal_cdf(spark):
    rows = spark.range(-40, 41).select((F.col("id") / 8).alias("x")).select("x", maths.normal_cdf("x").alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 2e-7 for r in rows)


CASES = [("10.00001", "10.00002", True), ("10.0001", "10.0002", False), ("10.01 20.02 30.03", "10.01\n20.02\n30.03", False), (" 10.01 \n", "10.01", True), ("True", "True", True), ("True", "true", True), ("True", "false", False), ("", "", True), ("1", "", False)]


@pytest.mark.parametrize("got,want,same", CASES)
def test_out_lcb(spark, got, want, same):
    assert spark.createDataFrame([(got, want)], "g string, w string").select(compare.out_lcb("g", "w")).first()[0] is same


@pytest.mark.parametrize(
    "raw,label",
    [(None, None), ("", None), ("Answer: A", "A"), ("x\n**Answer: b**\n\n", "B"), ("Answer: A (or B).", None), ('"Answer: A" on its own line.', None), ("> Answer: A", "A"), ("Answer: A\nbut", None)],
)
def test_terminal_answer(spark, raw, label):
    assert spark.createDataFrame([(raw,)], "t string").select(text.terminal_answer("t", ["A", "B"])).first()[0] == label


def test_truncated_is_never_rejected(spark):
    rows = [(1, 0.5, "a"), (1, None, "cut"), (1, 0.9, "b"), (2, None, "x")]
    got = {r.k: r for r in rollups.best_worst(spark.createDataFrame(rows, "k int, reward double, text string"), "k").collect()}
    assert (got[1].chosen, got[1].rejected, got[1].n_truncated) == ("b", "a", 1) and got[2].rejected is None


def test_converters(spark):
    df = spark.createDataFrame([([["1", "2"], ["3", "4"]],), ([["1"], ["2", None]],), ([],)], "r array<array<string>>")
    got = df.select(*(f("r").alias(f.__name__) for f in (arrays.convert_v1, arrays.convert_v2, arrays.convert_v3))).collect()
    assert list(got[0]) == ["1 2\n3 4", "2\n1 2\n3 4", "2 2\n1 2\n3 4"]
    assert list(got[1]) == ["1\n2 null", "2\n1\n2 null", "2\n1\n2 null"]
    assert list(got[2]) == ["", "0", "0"]


def test_even_indices(spark):
    got = spark.range(0, 12).select("id", maths.even_indices(F.col("id").cast("int"), 4).alias("x")).collect()
    for r in got:
        want = list(range(r.id)) if r.id <= 4 else list(dict.fromkeys(round(i * (r.id - 1) / 3) for i in range(4)))
        assert r.x == want


def test_parsers(spark):
    df = spark.createDataFrame([("['a', 'nan', 3]",), ("a, b,nan",), (None,)], "c string")
    assert [r[0] for r in df.select(arrays.pyrepr_list("c")).collect()] == [["a", "3"], ["a", "b"], []]


EXAMPLES = [
    ("\nExample 1:\nInput: nums = [1,2,3], target = 6\nOutput: 2\n\nExample 2:\nInput: nums = [1,1,1], target = 3\nOutput: 3\n", [(1, {"nums": [1, 2, 3], "target": 6}, 2), (2, {"nums": [1, 1, 1], "target": 3}, 3)]),
    ('Example 1:\nInput: target = "a, b", words = ["a","b"], costs = [1,2]\nOutput: [[1],[2]]', [(1, {"target": "a, b", "words": ["a", "b"], "costs": [1, 2]}, [[1], [2]])]),
    ('Example 1:\nInput: grid = [[1,2],[3,4]], s = "hello", b = true, f = 3.14\nOutput: null', [(1, {"grid": [[1, 2], [3, 4]], "s": "hello", "b": True, "f": 3.14}, None)]),
    ('example 7:\nINPUT: [1,2],"hello",42\noutput: \'x\'', [(1, {"_param_0": [1, 2], "_param_1": "hello", "_param_2": 42}, "x")]),
    ("Example 1:\nInput: [1,2,3]\nno more\nExample 2:\nInput: n = 5\nOutput: plain text", [(2, {"n": 5}, "plain text")]),
    ("Input: 1\nOutput: 2", []),
    (None, []),
]


@pytest.mark.parametrize("doc,want", EXAMPLES)
def test_parse_examples(spark, doc, want):
    got = spark.createDataFrame([(doc,)], "t string").select(arrays.parse_examples("t")).first()[0]
    assert [(e.example_id, json.loads(e.input), json.loads(e.output)) for e in got] == want


def test_trim_to_balance(spark):
    rows = [(0, "x", i) for i in range(50)] + [(0, "y", 100 + i) for i in range(20)] + [(1, "x", 200 + i) for i in range(5)] + [(1, "y", 300 + i) for i in range(5)]
    left = allocation.trim_to_balance(spark.createDataFrame(rows, "cell int, answer string, id int"), "cell", "answer", "id", 0.05).groupBy("cell", "answer").count().collect()
    n = {(r.cell, r.answer): r["count"] for r in left}
    assert n[0, "y"] == 20 and n[0, "x"] / (n[0, "x"] + 20) <= 0.55 + 1e-9 and n[0, "x"] >= 20 and n[1, "x"] == n[1, "y"] == 5


def test_choose_swaps(spark):
    rows = [("a", i, i < 17) for i in range(20)]
    out = allocation.choose_swaps(spark.createDataFrame(rows, "cell string, id int, first boolean"), "cell", "id").collect()
    firsts = sum((i < 17) != r.flipped for i, r in sorted((r.id, r) for r in out))
    assert abs(firsts - (20 - firsts)) <= 1


def test_fit_recovers_order(spark):
    rnd = random.Random(3)
    true = {i: i / 2 for i in range(8)}
    rows = [(a, b, 0.5 * (1 + math.erf((true[a] - true[b]) / 2))) for a in true for b in true if a < b]
    rnd.shuffle(rows)
    fit = graphs.fit_thurstone(spark.createDataFrame(rows, "a long, b long, probability_a double"), epochs=600).orderBy("mean").collect()
    assert [r.id for r in fit] == list(range(8)) and abs(sum(r["mean"] for r in fit)) < 1e-6


def test_regular_graph(spark):
    options = spark.range(0, 20, 2).toDF("id")
    for degree in (2, 3, 4):
        d = graphs.degree(graphs.regular_graph(options, degree)).collect()
        assert len(d) == 10 and {r.degree for r in d} == {degree}


def test_guards(spark):
    with pytest.raises(guards.GuardError):
        readers.scan_unique_by_id(spark.createDataFrame([(1,), (1,)], "id int"), "id")
    path = writers.scratch(spark, "strict")
    spark.createDataFrame([('{"a": 1, "a": 2}',)], "value string").write.text(path)
    with pytest.raises(guards.GuardError):
        readers.scan_json_strict(spark, path, "a int")
    with pytest.raises(guards.GuardError):
        writers.hash_pin(spark, path, {"nothing": "0"})
    frozen = writers.scratch(spark, "frozen")
    writers.sink_freeze(spark.range(3), frozen)
    with pytest.raises(Exception, match="already exists"):
        writers.sink_freeze(spark.range(3), frozen)


def test_torn_line_inside_a_log_is_an_error(spark):
    path = writers.scratch(spark, "torn")
    spark.createDataFrame([('{"id": 1}',), ('{"id": ',), ('{"id": 3}',)], "value string").coalesce(1).write.text(path)
    with pytest.raises(guards.GuardError):
        readers.scan_torn_tail(spark, path, "id long")


def test_options_in_three_shapes(spark):
    rows = [('["x", "y"]',), ('{"a": ["x"], "_note": ["n"], "b": ["y", "z"]}',), ('{"a": {"p": ["x"]}, "_n": {"q": ["m"]}}',)]
    got = [[(o.category, o.option) for o in r[0]] for r in spark.createDataFrame(rows, "s string").select(readers.flatten_options(F.col("s"))).collect()]
    assert got == [[("", "x"), ("", "y")], [("a", "x"), ("b", "y"), ("b", "z")], [("a.p", "x")]]


def test_snippet_overlap_matches_contains(spark):
    from lodestone.operators import matching

    texts = spark.createDataFrame([(1, "Some words here that the snippet of words repeats at length today"), (2, "nothing"), (3, "xsome words here that the snippet of words repeatsy")], "doc_id int, text string")
    snippets = spark.createDataFrame([(10, "some  words here that THE snippet of words repeats"), (11, "thesnippetwithoutanyspaceinit"), (12, "short")], "item_id int, text string")
    assert sorted((r.doc_id, r.item_id) for r in matching.snippet_overlap(texts, "doc_id", snippets, "item_id").collect()) == [(1, 10), (3, 10)]
    cut = matching.snippet_overlap(texts, "doc_id", snippets, "item_id", prefix=30)
    assert sorted((r.doc_id, r.item_id) for r in cut.collect()) == [(1, 10), (3, 10)]


CODE = [
    (None, ""), ("<think>abc</think>", ""), ("abc</think>", ""), ("<think>a</think>```code```", "code"), ("<think>a</think>```\n\ncode\n\ncode\n```", "code\n\ncode"), ("```python\na=4```", "a=4"), ("```python\n\n\n```", ""),
    ("<think>```rust\nb1```</think>```rust\na=14```", "a=14"), ("```# YOUR CODE HERE\nv=55```", "v=55"), ("```//// your code here\nif k=4:```", "if k=4:"), ("```python\nabc=10``` then ```rust\ncc=10```", "abc=10"), ("```   python  \ncc=44\n```", "cc=44"),
]


@pytest.mark.parametrize("content,code", CODE)
def test_extract_code_first(spark, content, code):
    assert spark.createDataFrame([(content,)], "t string").select(text.extract_code_first("t")).first()[0].strip() == code


@pytest.mark.parametrize("head,tail,keep", [("<think>", "</think>", 45), ("<think>", "</think>", 300), ("", "</think>", 234), ("<think>", "", 200), ("", "</think>", 45)])
def test_truncate_reasoning_fills_its_length(spark, head, tail, keep):
    got = spark.createDataFrame([(head + "abc" * 300 + tail,)], "t string").select(text.truncate_reasoning("t", keep)).first()[0]
    assert "[total 900 symbols]" in got and len(got) == keep


@pytest.mark.parametrize("content,short,keep", [(None, None, 100), ("", "", 100), ("</think>", "</think>", 100), ("<think>abc</think>```x```", "<think>abc</think>```x```", 100), ("<think>" + "abc" * 300 + "</think>", "<think>... [total 900 symbols]</think>", 20), ("abc" * 300 + "</think>", "... [total 900 symbols]</think>", 20)])
def test_truncate_reasoning(spark, content, short, keep):
    assert spark.createDataFrame([(content,)], "t string").select(text.truncate_reasoning("t", keep)).first()[0] == short


@pytest.mark.parametrize("got,want,same", [("1 2", "1  2\n", True), ("nan", "nan", False), ("inf", "inf", False), ("1.0000001 x", "1 x", True), ("1.1", "1", False), ("x", "y", False), ("1d", "1", False), ("1e3", "1000", True)])
def test_out_float_tokens(spark, got, want, same):
    assert spark.createDataFrame([(got, want)], "g string, w string").select(compare.out_float_tokens("g", "w")).first()[0] is same


def test_band_score(spark):
    rows = spark.createDataFrame([(0,), (16,), (32,), (256,), (378,), (500,), (501,)], "n int").select(maths.band_score("n")).collect()
    assert [round(r[0], 6) for r in rows] == [0.4, 0.7, 1.0, 1.0, 0.5, 0.0, 0.0]


def test_recover(spark):
    raws = ["", "<think>x", "so " * 50, "cut off", "Answer: A or B.", "I say.\n**Choice: b**.", "(A).", "I like A.", "A and B are fine. I take B.", "A or B? Both A and B.", "Neither one."]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, t string").select("k", text.recover("t").alias("x")).orderBy("k").collect()
    assert [(r.x.tier, r.x.label) for r in got] == [
        ("empty", None), ("has_think", None), ("degenerate_loop", None), ("truncated", None), ("instruction_echo", None), ("terminal_label", "B"), ("terminal_label", "A"), ("single_label", "A"), ("terminal_endorse", "B"), ("ambiguous", None), ("semantic_skipped", None),
    ]
