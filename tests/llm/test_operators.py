"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import ann, common, components, decontam, licenses, packing, quality, secrets, simhash, substrings, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# ---------------------------------------------------------------- 1 SimHash


def plain_fingerprint(t):
    words = WORD.findall(lower(t or ""))
    if not words:
        return 0
    counts, shingles = [0] * 64, [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps):
    """Smallest place that chains of at most four bits reach."""
    x = np.array(fps, dtype=np.uint64)
    label = list(range(len(x)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 4).tolist():
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_simhash(some):
    rows = some.orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components(fps)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(some).collect()}
    assert got == {r.doc_id: (simhash.signed(f), rows[c].doc_id) for r, f, c in zip(rows, fps, want, strict=True)}
    kept = sorted(r.doc_id for r in simhash.one_of_each(some).collect())
    assert kept == sorted({rows[c].doc_id for c in want})


def test_simhash_odd(odd, odd_rows, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[0].fp == of[1].fp == of[2].fp == 0 and of[5].component_id == of[6].component_id == 5 and of[8].component_id == 5
    assert [r.component_id for r in got if r.doc_id is None and r.fp != 0] == [5]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sum(r.doc_id == 5 for r in kept.collect()) == 1


def test_every_component_keeps_one_row(spark):
    rnd = random.Random(11)
    a, b, c, d = (" ".join(str(rnd.randrange(10**6)) for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a), (None, b), (2, b), (9, b), (3, c), (3, c), (3, d), (4, d), (None, d), (7, c)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, a), (2, b), (3, c), (3, d)], key=str)


def test_crowded_nodes_get_lower_ones(spark):
    rnd = random.Random(2)
    fps = set()
    for _ in range(3):
        base = rnd.getrandbits(64)
        for _ in range(700):
            x = base
            for b in rnd.sample(range(64), rnd.randrange(9)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = plain_components(fps)
    table = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    placed = simhash.nodes_of(table, cap=100).repartition("node").sortWithinPartitions("node", simhash.gray_rank(F.col("fp")))
    links = placed.mapInArrow(simhash.link_nodes, "a long, b long").distinct()
    got = {r.node: r.component for r in components.components(links).collect()}
    groups = defaultdict(list)
    for x, c in zip(fps, want, strict=True):
        groups[c].append(simhash.signed(x))
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (100, 100), (7, 7), (99, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


def test_hubs_and_hot_keys(spark):
    star = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(5000, 5031), 5000)}
    big = spark.createDataFrame([(k, 7 if k % 3 == 0 else k) for k in range(6000)], "id long, fp long")
    small = spark.createDataFrame([(k, k * 2) for k in range(0, 6000)], "fp long, twice long")
    assert [r[0] for r in common.hot_keys(big, "fp", 6000).collect()] == [7] and common.hot_keys(big.filter("fp <> 7"), "fp", 4000) is None
    joined = {(r.id, r.fp, r.twice) for r in common.join_hot(big, small, "fp", 6000).collect()}
    assert joined == {(k, f, 2 * f) for k in range(6000) for f in [7 if k % 3 == 0 else k]}


def test_a_third_of_all_rows_are_copies(spark):
    rnd = random.Random(4)
    words = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in ("n", "st", "l", "mo")]
    one = sentence(rnd, 60, words)
    rows = [(k, one if k % 3 == 0 else sentence(rnd, 40, words)) for k in range(2400)] + [(None, one)] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id is None or r.doc_id % 3 == 0} == {0}
    kept = simhash.one_of_each(df).collect()
    assert sum(r.text == one for r in kept) == 1 and {r.doc_id for r in kept} == {r.component_id for r in got}


# ---------------------------------------------------------------- 2 secrets


def plain_secrets(t):
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
    assign = re.compile(f"({either})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


SECRET_PARTS = ["password", "PassWd", "secret", "token", "api_key", "apikey", "APIKEY", "KelvinK", "toKen", ":", "=", " ", '"', "'", "abcdefgh", "AKIA", "AKIA1234567890AB", "0123456789abcdef", "é", "\n", "-", ".", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PARTS), max_size=40).map("".join))
def test_base_spans(t):
    assert secrets.base_spans(t) == plain_secrets(t)
    found = secrets.find(t)
    assert [(x["start"], secrets.KINDS.index(x["kind"]), x["end"]) for x in found if x["kind"] != "literal"] == plain_secrets(t)
    assert found == sorted(found, key=lambda x: (x["start"], secrets.KINDS.index(x["kind"]), x["end"]))


def test_constants_reach_sensitive_names():
    t = 'k = "Zx9Qw3rT7uIo"\nother = "Zx9Qw3rT7uIx"\ndb_pass_phrase = k\ndb_password = k + suffix\nhost: example.com\nclient_credential => \'qwErty12345zx\'\npassword_hint = changeme1'
    found = {t[x["start"] : x["end"]]: x["kind"] for x in secrets.find(t)}
    assert found["Zx9Qw3rT7uIo"] == "literal" and found["qwErty12345zx"] == "literal" and "Zx9Qw3rT7uIx" not in found and "example.com" not in found
    assert secrets.find("a = b\nb = a\npassword1 = a\n") == []


@pytest.mark.parametrize(
    "before, after",
    [
        ("db_pwd" + " " * 13 + '= "', '"'),
        ("db_pwd =" + "\t" * 20 + '"', '"'),
        ("x" * 100 + '_pwd = "', '"'),
        ('pwd: str = "', '"'),
        ('pwd: Optional[Dict[str, str]] | None = "', '"'),
        ("const PWD: &'static str = \"", '";'),
        ('pwd =\n    "', '"'),
        ('pwd = (\r\n    "', '"\n)'),
        ('pwd: str = \\\n  "', '"'),
        ('"pwd":\n  "', '",\n'),
        ("pwd:\n  ", "\n"),
        ('pwd = "short"' + " " * 12 + '+ "', '"'),
        ('pwd = "short" +\n  "', '"'),
        ('k    :    str =\n "', '"\npassword = k\n'),
    ],
)
def test_values_far_from_their_names(before, after):
    found = secrets.find(before + "Zx9kQw7LmT2p" + after)
    assert [(x["kind"], x["start"], x["end"]) for x in found] == [("literal", len(before), len(before) + 12)]
    assert "Zx9kQw7LmT2p" not in secrets.masked(before + "Zx9kQw7LmT2p" + after)


def test_names_and_types_are_no_values():
    assert secrets.find('pwd: Optional[str] = None\npwd:\n  Database9Url: x\n"pwd":\n "Database9Url": 1\nnote: set name = "Zx9kQw7LmT2p"\n') == []
    found = secrets.find('note: the pwd = "Zx9kQw7LmT2p", pwd: Zx9kQw7LmT2p = 1')
    assert [x["name"] for x in found] == ["pwd", "pwd"]


def test_secrets_odd(odd, odd_rows, none):
    got = secrets.scan(odd).collect()
    assert len(got) == len(odd_rows) and {r.doc_id: len(r.findings) for r in got if r.doc_id is not None}[13] == 1
    assert secrets.scan(none).count() == 0
    masked = secrets.mask_secrets(odd)
    assert masked.columns == odd.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[13] == '[SECRET]"' and texts[0] is None and texts[14] == odd_rows[14][1]


# ---------------------------------------------------------------- 3 quality, 5 toxicity


def labelled(spark, n=900):
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        words = [rnd.choice(["ban", "lon", "mist", "rota", "sel", "tu"]) + rnd.choice(["a", "be", "co"]) for _ in range(rnd.randrange(5, 60))]
        bad, toxic = rnd.random() < 0.3, rnd.random() < 0.3
        if bad:
            words = [w + "%%%" if rnd.random() < 0.5 else w for w in words]
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "rotten"]))
        rows.append((k, " ".join(words) + ".", "en", "s", 0))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    good = quality.quality(docs, quality.learn(docs, labels)).select("doc_id", "score").collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == (truth[r.doc_id].quality == 1) for r in good if held_out(r.doc_id)]) > 0.95
    model = toxicity.learn(docs, labels)
    toxic = toxicity.toxicity(docs, model).collect()
    assert np.mean([(r.score >= toxicity.THRESHOLD) == (truth[r.doc_id].toxic == 1) for r in toxic if held_out(r.doc_id)]) > 0.95
    assert toxicity.clean_documents(docs, model).count() == sum(r.score < toxicity.THRESHOLD for r in toxic)


def test_long_clean_texts_are_not_toxic(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels)
    plain = "sun river stone lamp\n" * 20_000
    bad = next(r.worst_sentence for r in toxicity.toxicity(docs, model).orderBy(F.desc("score")).limit(1).collect())
    rows = spark.createDataFrame([(1, plain), (2, plain + bad), (3, ""), (4, None)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.toxicity(rows, model).collect()}
    assert score[1] == score[3] == score[4] < 0.001 and score[2] >= toxicity.THRESHOLD
    assert {r.doc_id for r in toxicity.clean_documents(rows, model).collect()} == {1, 3, 4}


def test_all_offending_sentences_are_located(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels)
    scored = toxicity.toxicity(docs, model).orderBy(F.desc("worst_score")).limit(1).collect()[0]
    bad = scored.worst_sentence
    texts = [f"Sún river. {bad}. stone\n\u65e5\u672c {bad}! lamp {bad}", "sun river. stone", "", None, f"{bad}.", f"é. {bad}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in toxicity.toxicity(rows, model).collect()}
    cut = {k: [texts[k][s.start : s.end] for s in r.sentences] for k, r in got.items()}
    assert cut == {0: [bad, f"\u65e5\u672c {bad}", f"lamp {bad}"], 1: [], 2: [], 3: [], 4: [bad], 5: [bad]}
    assert all((len(r.sentences) > 0) == (r.score >= toxicity.THRESHOLD) for r in got.values())
    known = toxicity.Bags(pa.array(["x"])).grams
    known = np.unique(known[known != 0])
    weak = toxicity.Model(known, np.full(len(known), 8.0 / len(known)), -9.0)  # sigmoid(-1) = 0.27 a sentence: only together over the threshold
    bags = toxicity.Bags(pa.array(["x. x. x. x", "x", "x. y. x. x"]))
    logits = weak.sentence_logits(bags)
    score = weak.score(bags, logits)[0]
    assert [len(s) for s in weak.offending(bags, logits, 0.5)] == [2, 0, 1] and ((score >= 0.5) == [True, False, True]).all()


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(spark, 300)
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert (a.hashes == b.hashes).all() and (a.weights == b.weights).all() and a.bias == b.bias
    p, q = quality.learn(docs, labels), quality.learn(docs, turned)
    assert p.rules == q.rules and p.weights == q.weights and p.bias == q.bias


def test_rules_compile_to_the_same_score(spark):
    docs, labels = labelled(spark, 400)
    model = quality.learn(docs, labels)
    rows = quality.quality(docs, model).collect()
    x = np.array([[r[k] for k in quality.STATISTICS] for r in rows])
    assert np.allclose(model.score(x), [r.score for r in rows], atol=1e-9) and model.rules


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (6, 1, 0)], [(1, None, None), (None, 0, 1)]])
def test_classifiers_with_few_labels(spark, odd, odd_rows, none, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for rows in (quality.quality(odd, quality.learn(odd, table)).select("score").collect(), toxicity.toxicity(odd, toxicity.learn(odd, table)).select("score").collect()):
        assert len(rows) == len(odd_rows) and len({round(r.score, 6) for r in rows}) == 1 and 0 <= rows[0].score <= 1
    assert quality.quality(none, quality.learn(none, table)).count() == 0
    model = toxicity.learn(none, table)
    assert toxicity.toxicity(none, model).count() == 0
    assert toxicity.clean_documents(odd, model).columns == odd.columns


# ---------------------------------------------------------------- 4 substrings


def plain_cut(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(least.get(key, k), k)
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if least[tuple(w[i : i + width])] < k for j in range(i, i + width)}
        out.append((k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("width", [3, 10, 50])
def test_substrings(some, width):
    rows = [(r.doc_id, r.text) for r in some.collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(some, width).collect())
    assert got == plain_cut(rows, width)


def gone_words(packed, width):
    """Removed places by document, from runs and intervals, by plain counting."""
    gone, least, held = defaultdict(set), {}, []
    for r in packed.to_pylist():
        if r["hashes"] is None:
            gone[r["doc_id"]] |= set(range(r["s"], r["e"]))
        for k, h in enumerate(r["hashes"] or []):
            held.append((h, r["doc_id"], r["s"] + k))
            least[h] = min(least.get(h, r["doc_id"]), r["doc_id"])
    for h, d, at in held:
        if d > least[h]:
            gone[d] |= set(range(at, at + width))
    return {k: len(v) for k, v in gone.items() if v}


@pytest.mark.parametrize("remembered", [1, 40, 1 << 20])
def test_substrings_in_small_slices(some, monkeypatch, remembered):
    rows = sorted((r.doc_id, r.text) for r in some.collect())
    random.Random(2).shuffle(rows)  # smaller ids after larger ones
    table = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(range(len(rows)), pa.int64())], names=["doc_id", "text", "_key"])
    monkeypatch.setattr(substrings, "small_slices", lambda it, c: common.small_slices(it, c, 3000))
    monkeypatch.setattr(substrings, "REMEMBERED", remembered)
    want = {k: n for k, _, n, _ in plain_cut(rows, 10) if n}
    assert gone_words(pa.Table.from_batches(substrings.pack_windows(iter([table]), 10)), 10) == want
    parts = [pa.Table.from_batches(substrings.pack_windows(iter([table]), 10, part, 3)) for part in range(3)]
    assert all(len(p) for p in parts)
    for p in parts:  # a key is in one pass only
        others = {k for q in parts if q is not p for k in q.filter(pa.compute.is_valid(q.column("hashes"))).column("least").to_pylist()}
        assert not others & set(p.filter(pa.compute.is_valid(p.column("hashes"))).column("least").to_pylist())
    assert gone_words(pa.concat_tables(parts), 10) == want


def test_passes_over_large_inputs(some, monkeypatch):
    assert substrings.passes_and_partitions(1) == (1, 1) and substrings.passes_and_partitions(10**14)[0] > 20 and substrings.passes_and_partitions(10**14)[1] <= substrings.MOST_PARTITIONS
    monkeypatch.setattr(substrings, "passes_and_partitions", lambda size: (3, 2))
    rows = [(r.doc_id, r.text) for r in some.collect()]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(some, 10).collect()) == plain_cut(rows, 10)


def test_a_passage_in_most_documents(spark):
    rnd = random.Random(6)
    words = [a + b for a in "bcdfgh" for b in "aeiou"]
    passage = sentence(rnd, 80, words)
    rows = [(k, f"{sentence(rnd, 60, words)} x{k} {passage} y{k} {sentence(rnd, 55, words)}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()}
    assert got == {k: 0 if k == 0 else 80 for k in range(600)}


def test_substrings_odd(odd, odd_rows, none):
    got = substrings.remove_repeats(odd).collect()
    assert len(got) == len(odd_rows)
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[0].n_words == of[1].n_words == of[2].n_words == 0 and of[6].n_removed == of[6].n_words == 120 and of[5].n_removed == 0 and of[9].n_words == 60_000 and of[9].n_removed == 0
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 120]
    assert substrings.remove_repeats(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabAéñ\x1f\xa0.Z9", max_size=40), max_size=8))
def test_words(texts):
    for kinds, low, pattern in ((common.SPACED, False, r"[^\x20\x09-\x0D]+"), (common.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = common.Words(pa.array(texts, pa.string()), kinds, low)
        got = [[bytes(w.data[w.start[i] : w.end[i]]).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
        assert got == [re.findall(pattern, lower(t) if low else t) for t in texts]
        hashes = common.word_hashes(w, block=16)
        flat = [x for ws in got for x in ws]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


# ---------------------------------------------------------------- 6 WARC


PAGES = "page_id long, url string, html string, extra int"


def test_warc_round_trip(spark):
    rnd = random.Random(1)
    bodies = ["", None, "<p>x</p>", "line\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc", "é" * 2000, "z" * 100_000]
    rows = [(k, rnd.choice([None, "", "http://www.Example.com/a?b=1", f"https://m.example.org/{k % 7}", "http://bad:port:x/", "http://h/\r\nX: y"]), rnd.choice(bodies), k) for k in range(60)]
    path = common.new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    got = warc.capture_history(spark, path).collect()
    least = {}
    for k, _, b, _ in rows:
        least[b or ""] = min(least.get(b or "", k), k)
    assert len(got) == len(rows)
    for r in got:
        body = rows[r.page_id][2] or ""
        first = least[body]
        assert (r.payload_bytes, r.payload_digest) == (len(body.encode()), base64.b32encode(hashlib.sha1(body.encode()).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    order = [(r.urlkey, r.timestamp, r.page_id) for r in got]
    assert order == sorted(order)


def test_places_in_the_index_can_be_sought(spark):
    rnd = random.Random(7)
    rows = [(k, f"http://h{k % 5}.org/{k}", "same" * 300 if k % 3 else "".join(rnd.choice("abc <p>é") for _ in range(rnd.randrange(900))), k) for k in range(2300)]
    rows.append((9999, "http://long.org/", "x" * (17 << 20), 1))
    path = common.new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), path)
    files = {p.name: p.read_bytes() for p in Path(path.removeprefix("file://")).glob("part-*")}
    got = warc.capture_history(spark, path).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        one = gzip.decompress(files[r.file][r.offset : r.offset + r.length])  # the member alone
        headers, block = warc.parse_record(one)
        assert headers["warc-record-id"] == f"<urn:page:{r.page_id}>" and (r.record_type == "revisit" or bytes(block).endswith(rows[min(r.page_id, 2300)][2].encode()))
    assert sum(len(gzip.decompress(f)) for f in files.values()) == sum(len(x) for f in files.values() for _, _, x in warc.open_members(f))
    assert max(Counter(r.file for r in got).values()) <= warc.RECORDS_PER_FILE
    with pytest.raises(ValueError):
        list(warc.open_members(next(iter(files.values()))[:-1]))


def test_ranges_merge_pieces_of_runs():
    rnd = random.Random(3)
    entries = [{"urlkey": f"k{rnd.randrange(9)}", "timestamp": f"t{rnd.randrange(3)}", "page_id": rnd.choice([None, k]), "file": f"f{k % 4}", "offset": k} for k in range(500)]
    pieces = [sorted(entries[a : a + 37], key=warc.order_of) for a in range(0, 500, 37)]
    batches = [pa.RecordBatch.from_pylist(x, schema=warc._ENTRY) for p in pieces for x in (p[:11], p[11:])]
    out = pa.Table.from_batches(list(warc.merge_rows(iter(batches)))).to_pylist()
    assert [warc.order_of(x) for x in out] == sorted(map(warc.order_of, entries)) and list(warc.merge_rows(iter([]))) == []


def test_warc_odd(spark):
    path = common.new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.capture_history(spark, path).count() == 0
    rows = [(None, None, "same", 1), (3, None, "same", 1), (3, None, "same", 1), (None, None, None, 1)]
    path = common.new_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.capture_history(spark, path).collect())
    assert got == {(3, "response", None): 2, (None, "revisit", 3): 1, (None, "response", None): 1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree(runs, lambda x: x)) == list(heapq.merge(*runs))


def test_url_key():
    assert warc.url_key("http://www.Example.com:80/A?q=1#f") == "com,example)/a?q=1" and warc.url_key(None) == "" and warc.url_key("https://b.a.org:8080") == "org,a,b:8080)/"


# ---------------------------------------------------------------- 7 nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[100:160] = x[100]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(np.float64)
    got = defaultdict(dict)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hit = 0
    for q in range(0, 3000, 20):
        score = (x * x[q]).sum(axis=1)
        best = [k for k in np.lexsort((np.arange(3000), -score)).tolist() if k != q][:20]
        found = [got[q][k] for k in range(1, 21)]
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and all(abs(score[k] - s) < 1e-12 for k, s in found)
        hit += len(set(best) & {k for k, _ in found})
    assert hit / (150 * 20) >= 0.9


def recall(spark, vectors, k=20):
    """Share of the true neighbours found, by id, with every score exact and every order right."""
    rows = [r for r in vectors.select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    place = {v: k for k, v in enumerate(ids.tolist())}
    got = defaultdict(list)
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    asked = [v for v in ids.tolist() if v % 20 == 0]
    assert sorted(got) == sorted(asked)
    hit = 0
    for q in asked:
        score = (x * x[place[q]]).sum(axis=1)
        best = [v for v in ids[np.lexsort((ids, -score))[: k + 1]].tolist() if v != q][:k]
        assert got[q] == sorted(got[q], key=lambda f: (-f[1], f[0])) and all(score[place[v]] == s for v, s in got[q]) and len(got[q]) == k
        hit += len(set(best) & {v for v, _ in got[q]})
    return hit / (k * len(asked))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    assert recall(spark, spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")) >= 0.9


def test_large_groups_of_copies_are_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 32))
    copies = rng.random(9000) < 1 / 3
    x[copies] = rng.normal(size=32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(spark, df) >= 0.93
    members = np.flatnonzero(copies).tolist()
    found = defaultdict(list)
    for r in ann.nearest(df.repartition(7), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert all(found[q] == [m for m in members if m != q][:20] for q in members if q % 20 == 0)


def test_results_do_not_follow_partitions_shards_or_blocks(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    answers = lambda t: sorted(tuple(r) for r in ann.nearest(t, F.col("vec_id") % 20 == 0).collect())
    one = answers(df)
    monkeypatch.setattr(ann, "SHARD", 150)
    monkeypatch.setattr(ann, "BLOCK", 30)
    assert answers(df.repartition(5)) == one
    monkeypatch.setattr(ann, "DIRECTORY_BYTES", 0)
    assert answers(df) == one


def test_clusters_need_a_small_share(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16)) * 5
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(spark, df) >= 0.93
    pivots = ann.Pivots(x[: ann.SAMPLE], 1.0)
    sample = ann.Files(pivots.nearest(x[: ann.SAMPLE]), ann.PIVOTS)
    index = spark.createDataFrame([(k, v.tolist(), bytes(pivots.nearest(x[k : k + 1])[0].astype(np.uint16))) for k, v in enumerate(x)], "rep long, embedding array<double>, prefix binary")
    assert ann.measured_share(spark, index, index, sample, pivots, 20) < 0.05


def test_ranges_hold_all_live_shards(spark, monkeypatch):
    rnd = random.Random(1)
    live = {k * 3: rnd.random() < 0.4 for k in range(200)}
    table = spark.createDataFrame([(k,) for k in live], "shard long")
    want = {k for k, v in live.items() if v}
    assert {r.shard for r in table.filter(ann.live_ranges(live)).collect()} == want
    monkeypatch.setattr(ann, "MOST_RANGES", 5)
    assert {r.shard for r in table.filter(ann.live_ranges(live)).collect()} >= want
    assert table.filter(ann.live_ranges(dict.fromkeys(live, False))).count() == 0


def test_directory_skips_only_what_nothing_reaches():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 6)) * 0.1 + c for c in np.eye(6) * 4])
    pivots = ann.Pivots(x, float(np.linalg.norm(x, axis=1).max()), 48, 8)
    near = pivots.nearest(x)
    orders = pivots.nearest(x[::50], query=True)
    skipped = 0
    for shard in np.split(np.argsort(near[:, 0], kind="stable"), 12):
        files = ann.Files(near[shard], 48)
        for reach in (-60, -30, -10):
            could = ann.reachable(files.best, orders, np.full(len(orders), reach))
            does = np.array([(files.footrule(o) <= reach).any() for o in orders])
            assert not (does & ~could).any()
            skipped += int((~could).sum())
    assert skipped


def test_nearest_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [2.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (40, []), (None, [1.0, 1.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("hits", F.lit(1)).withColumn("score", F.lit(2))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 3, 2.0), (0, 2, 11, 1.0), (0, 3, 20, 1.0), (20, 1, 3, 2.0), (20, 2, 0, 1.0), (20, 3, 11, 1.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id = 4"), F.col("vec_id") % 20 == 0).count() == 0


def test_footrule_of_inverted_files():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    pivots = ann.Pivots(x[:40], float(np.linalg.norm(x, axis=1).max()), 30, 12)
    files, order = ann.Files(pivots.nearest(x), 30), pivots.nearest(x[:1])[0]
    ranks = lambda o: {p: i for i, p in enumerate(o.tolist())}
    q = ranks(order)
    plain = []
    for o in pivots.nearest(x):
        r = ranks(o)
        plain.append(sum(abs(r.get(p, 12) - q.get(p, 12)) for p in r.keys() | q.keys()))
    fast = files.footrule(order)
    assert np.ptp(np.array(plain) - fast) == 0


# ---------------------------------------------------------------- 8 decontamination


def plain_hits(docs, bench, width=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, t in bench:
        w = find(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add("null" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for k, t in docs:
        w, hit, items = find(t), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if items_here := windows.get(tuple(w[i : i + n]) if i + n <= len(w) else None):
                    hit |= set(range(i, i + n))
                    items |= items_here
        out.append((k, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def hits(df):
    return sorted(((r.doc_id, r.n_words, sum(s.e - s.s for s in r.spans), sorted(r["items"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_decontamination(spark, some, block):
    texts = [(r.doc_id, r.text) for r in some.collect()]
    rnd = random.Random(3)
    bench = [(k, " ".join(rnd.choice(texts)[1].split(" ")[: rnd.randrange(1, 40)])) for k in range(12)] + [(50, "ban bon."), (51, ""), (52, None), (3, "Ban"), (None, "nothing of this")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert hits(decontam.contaminated_spans(some, table, block_chars=block)) == plain_hits(texts, bench)
    kept = {r.doc_id for r in decontam.clean_documents(some, table, block_chars=block).collect()}
    assert kept == {k for k, _, n, _ in plain_hits(texts, bench) if not n}


@pytest.mark.parametrize("block", [4_000_000, 12])
def test_decontamination_odd(spark, odd, odd_rows, none, block):
    bench = spark.createDataFrame([(1, "one"), (2, "released UNDER the mit licence"), (3, "é ñ")], "item_id long, text string")
    want = plain_hits([(r[0], r[1]) for r in odd_rows], [(1, "one"), (2, "released UNDER the mit licence"), (3, "é ñ")])
    assert hits(decontam.contaminated_spans(odd, bench, block_chars=block)) == want
    assert decontam.contaminated_spans(none, bench, block_chars=block).count() == 0
    assert all(not r.spans for r in decontam.contaminated_spans(odd, bench.limit(0), block_chars=block).collect())
    clean = decontam.clean_documents(odd, bench, block_chars=block)
    assert clean.columns == odd.columns and clean.count() == sum(not n for _, _, n, _ in want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=20), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index(runs, patterns):
    text = [x for r in runs for x in (*r, 0)]
    index = decontam.FMIndex(np.array(text, dtype=np.int64), 4, 3)
    wide = max(map(len, patterns))
    low, high = index.search(np.array([[0] * (wide - len(p)) + p for p in patterns]), np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if text[i : i + len(p)] == p]


# ---------------------------------------------------------------- 9 licenses


def plain_licenses(rows):
    out = []
    for k, t in rows:
        w = licenses.words_of(t or "")
        s = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, text in licenses.TEMPLATES.items():
            tw = licenses.words_of(text)
            mine = {" ".join(tw[i : i + 5]) for i in range(len(tw) - 4)}
            length = licenses.size_class(len(mine))
            best = max(((len(mine & set(s[a : a + length])), -a) for a in range(0, len(s), length // 2)), default=(0, 0))
            if best[0] / len(mine) >= 0.8:
                out.append((k, name, best[0], -best[1]))
    return sorted(out, key=str)


def test_licenses(spark, odd, odd_rows, none):
    rnd = random.Random(8)
    filler = lambda n: " ".join(rnd.choice(["lorem", "ipsum", "dolor", "license", "conditions"]) for _ in range(n))
    rows = []
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        words = text.split(" ")
        rows.append((3 * k, f"{filler(rnd.randrange(90))} {text} {filler(rnd.randrange(90))}"))
        words[len(words) // 2] = "altered"
        rows.append((3 * k + 1, f"{filler(40)}\n{' '.join(words)}\n{filler(5)}"))
        rows.append((3 * k + 2, " ".join(words[: len(words) // 2])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.license, r.n_shared, r.window_start) for r in licenses.scan(df).collect()), key=str)
    assert got == plain_licenses(rows) and {k for k, *_ in got} >= {3 * k for k in range(len(licenses.TEMPLATES))}
    odd_got = sorted(((r.doc_id, r.license, r.n_shared, r.window_start) for r in licenses.scan(odd).collect()), key=str)
    assert odd_got == plain_licenses([(r[0], r[1]) for r in odd_rows])
    assert licenses.scan(none).count() == 0


def test_readme_lists_the_licenses():
    listed = (Path(__file__).parents[2] / "README.md").read_text()
    assert all(f"`{name}`" in listed for name in licenses.TEMPLATES) and f"these {len(licenses.TEMPLATES)} templates" in listed


def test_anchors_cover_a_fifth():
    for text in licenses.TEMPLATES.values():
        w = licenses.words_of(text)
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        a = set(licenses.anchors_of(w))
        assert sum(bool(a & set(x)) for x in s) > 0.2 * len(s)


# ---------------------------------------------------------------- 10 packing


def check_packing(rows, docs, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for k, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % size or size
        edges = [0, *range(first, len(ids) + 1, size)]
        for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[k, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert all(v <= size for v in at.values())
    return len(at), sum(at.values())


def test_packing(some, odd, odd_rows, none):
    docs = [(r.doc_id, r.text) for r in some.collect()]
    bins, total = check_packing(packing.pack_documents(some).collect(), docs, 2048)
    assert bins <= 1.02 * total / 2048 + 1
    bins, total = check_packing(packing.pack_documents(some, size=64).collect(), docs, 64)
    assert bins <= 1.02 * total / 64 + 1
    check_packing(packing.pack_documents(odd).collect(), [(r[0], r[1]) for r in odd_rows], 2048)
    assert packing.pack_documents(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'sté\n\t\r\x0b\x1c\x85\xa0 　9.<|>endoftx")), max_size=60) | st.sampled_from(["<|endoftext|>", "a<|endoftext|> b"]))
def test_ids(text):
    enc = packing.encoder(packing.tokenizer_path(), packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    rooms = []  # item by item
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms[rooms.index(min(fits))] -= length
            else:
                rooms.append(30 - length)
    used, ranks = defaultdict(list), defaultdict(set)
    for length, first, n, seq, offset in packing.plan(counts, 30):
        for i in range(n):
            used[seq + i].append((offset, length))
            ranks[length].add(first + i)
    assert len(used) == len(rooms) and {k: len(v) for k, v in ranks.items()} == counts and all(v == set(range(counts[k])) for k, v in ranks.items())
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 30
