"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence scores p = sigmoid(bias + sum of weights of its distinct words and word prefixes); a document scores
1 - (1 - p0) prod((1 - p) / (1 - p0)) over its sentences above p0 = sigmoid(bias) (noisy-or), so one bad sentence suffices and labels of documents are enough
to learn which.  The bias counts once a document: a sentence adds only what its words add, so plain ones add nothing however many they are.
The highest sentence is reported, and for documents that score `THRESHOLD` or more the offending sentences with their places (code points, ends exclusive):
the fewest, highest first and then in order, without which the rest of the document scores less; every sentence that scores the threshold is one.

Learning: at most `MOST_POSITIVE` + `MOST_NEGATIVE` labelled rows (the smallest hashes of their ids) are the sample; words and prefixes (`PREFIXES` bytes)
that occur in `MIN_ROWS` of them at least, and in labelled ones more often than chance would let any of them (Chernoff's bound over all candidates), are features.  They are
counted in Spark; the driver gets, of the sample, the numbers of those features by sentence and how many sentences have none, never a text.  Weights are fitted by
proximal gradient on the noisy-or likelihood with an L1 term, so few are not zero.
Everything else covers all rows: whole texts are scored where they lie, nothing is shuffled.

Defined cases: a null or empty text has one empty sentence and scores sigmoid(bias); rows without a label, or whose id hashes into
the held-out fold, teach nothing; without any label, or with one kind only, the share of positives (0.5 without labels) is the score of every document;
doc_ids that repeat in labels count as toxic if any of their rows is; a row with a null doc_id teaches nothing and is no held-out one; columns beyond doc_id, text and toxic are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ALNUM, U, Words, fresh, prefix_hashes, small_slices, staged, table

FOLDS = 5
MOST_POSITIVE, MOST_NEGATIVE = 2000, 4000
MIN_ROWS = 5
MOST_BIAS = -9.0  # a document without any feature
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
THRESHOLD = 0.5
BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".!?\n"]] = True


def fold(doc_id) -> "F.Column":
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def sentences(words: Words, column_offsets: np.ndarray) -> np.ndarray:
    """Number of the sentence of every word; a sentence ends at . ! ? or a line break, and with the text."""
    stops = BREAK[words.data]
    count = np.cumsum(stops)
    before = count[words.start] if len(words) else np.zeros(0, np.int64)
    row = words.row_of()
    change = np.r_[True, (before[1:] != before[:-1]) | (row[1:] != row[:-1])] if len(words) else np.zeros(0, bool)
    return np.cumsum(change) - 1


class Bags:
    """Hashes of the words of a slice and of their prefixes, with the sentence and row of each word."""

    def __init__(self, column: pa.Array):
        self.words = Words(column, ALNUM, lower=True)
        self.grams = prefix_hashes(self.words, PREFIXES)
        self.row = self.words.row_of()
        self.sentence = sentences(self.words, self.words.first)
        self.rows = self.words.rows


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """(doc_id, bad, text) of a bounded sample of labelled rows outside the held-out fold: by label the smallest hashes of ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("bad")).dropna()
    known = known.filter(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    picked = None
    for value, n in most.items():
        part = known.filter(F.col("bad") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(fold("doc_id") != 0)
    joined = texts.join(F.broadcast(picked), "doc_id")  # at most the sample's bound
    return staged(joined.groupBy("doc_id", "bad").agg(F.min("text").alias("text")), "sample")


def counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, bad, n): in how many toxic rows of a slice, and in how many of all, a word or prefix occurs."""
    for batch in small_slices(batches, "text", 1 << 20):
        row, found = row_features(Bags(batch.column("text")), None)
        hashes, at = np.unique(found, return_inverse=True)
        bad = np.bincount(at, weights=batch.column("bad").to_numpy()[row] > 0, minlength=len(hashes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(hashes)))], names=["hash", "bad", "n"])


def chosen_features(sample: DataFrame, base: float) -> np.ndarray:
    """Ascending hashes of the features of a sample of which a share `base` is toxic."""
    counts = sample.mapInArrow(counted_rows, "hash long, bad long, n long").groupBy("hash").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    known = staged(counts.filter("bad >= 2"), "features")  # features that no toxic row holds can't be chosen
    least = float(np.log(max(2, known.count())))
    share, good = F.col("bad") / F.col("n"), F.col("n") - F.col("bad")
    surprise = F.col("bad") * F.ln(share / base) + good * F.ln(F.greatest(1 - share, F.lit(1e-12)) / (1 - base))  # minus the log of the chance of such a share, nearly
    told = known.filter((F.col("n") >= MIN_ROWS) & (share > base) & (surprise > least)).select("hash").toArrow()  # noisy-or only adds evidence: features that speak for the label
    return np.sort(told.column("hash").to_numpy().view(np.uint64)) if told.num_rows else np.zeros(0, np.uint64)


INCIDENCE = "doc_id long, bad int, plain long, sizes array<int>, features array<int>"


def incidence_rows(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a sample as numbers: sentences without a chosen feature, and the features of each other sentence, one after the other."""
    for batch in small_slices(batches, "text", 1 << 20):
        bags = Bags(batch.column("text"))
        first = np.flatnonzero(np.r_[True, np.diff(bags.sentence) > 0]) if len(bags.sentence) else np.zeros(0, int)
        row = bags.row[first]
        word, feature = matches(bags, chosen)
        pair = np.unique(bags.sentence[word] * max(1, len(chosen)) + feature)
        live, size = np.unique(pair // max(1, len(chosen)), return_counts=True)
        per_row = lambda at: np.r_[0, np.cumsum(np.bincount(at, minlength=bags.rows))].astype(np.int32)
        plain = np.bincount(row, minlength=bags.rows) - np.bincount(row[live], minlength=bags.rows)
        sizes = pa.ListArray.from_arrays(pa.array(per_row(row[live])), pa.array(size.astype(np.int32)))
        features = pa.ListArray.from_arrays(pa.array(per_row(np.repeat(row[live], size))), pa.array((pair % max(1, len(chosen))).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("bad"), pa.array(plain), sizes, features], names=["doc_id", "bad", "plain", "sizes", "features"])


def matches(bags: Bags, features: np.ndarray, maybe: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) wherever a word or prefix hash is one of the ascending features."""
    if not len(features) or not len(bags.row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = near_table(features) if maybe is None else maybe
    word, gram = np.nonzero(maybe[bags.grams & LOW_BITS])
    found = bags.grams[word, gram]
    near = np.minimum(np.searchsorted(features, found), len(features) - 1)
    hit = features[near] == found
    return word[hit], near[hit]


def row_features(bags: Bags, features: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature); without features given, the hashes themselves."""
    if features is not None:
        word, feature = matches(bags, features)
        pair = np.unique(bags.row[word] * max(1, len(features)) + feature)
        return pair // max(1, len(features)), pair % max(1, len(features))
    word, gram = np.nonzero(bags.grams)
    found, row = bags.grams[word, gram], bags.row[word]
    order = np.lexsort((row, found))
    found, row = found[order], row[order]
    keep = np.r_[True, (found[1:] != found[:-1]) | (row[1:] != row[:-1])] if len(found) else np.zeros(0, bool)
    return row[keep], found[keep]


LOW_BITS = U((1 << 20) - 1)


def near_table(features: np.ndarray) -> np.ndarray:
    """By the lowest 20 bits of a hash whether any feature has them."""
    out = np.zeros(1 << 20, dtype=bool)
    out[features & LOW_BITS] = True
    return out


class Model:
    """Hashes of the words and prefixes with a weight, ascending, their weights, and the bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, constant: float | None = None):
        self.hashes, self.weights, self.bias, self.constant = hashes, weights, bias, constant
        self.maybe = near_table(hashes)

    def sentence_logits(self, bags: Bags) -> np.ndarray:
        """Logit of every sentence of a slice that has words."""
        n = int(bags.sentence[-1]) + 1 if len(bags.sentence) else 0
        out = np.full(n, self.bias)
        if n and len(self.hashes):
            word, feature = matches(bags, self.hashes, self.maybe)
            pair = np.unique(bags.sentence[word] * len(self.hashes) + feature)  # a feature counts once a sentence
            np.add.at(out, pair // len(self.hashes), self.weights[pair % len(self.hashes)])
        return out

    def score(self, bags: Bags, logits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, place of the worst sentence (its first word's byte; -1 without words) and that sentence's score, by row."""
        logits = self.sentence_logits(bags) if logits is None else logits
        score, worst, top = np.zeros(bags.rows), np.full(bags.rows, -1), np.full(bags.rows, sigmoid(np.array(self.bias)))
        if len(logits):
            first = np.flatnonzero(np.r_[True, np.diff(bags.sentence) > 0])
            row = bags.row[first]
            order = np.lexsort((-np.arange(len(logits)), logits, row))
            best = order[np.r_[row[order][1:] != row[order][:-1], True]]
            worst[row[best]], top[row[best]] = first[best], sigmoid(logits[best])
            score = np.bincount(row, weights=added(logits, self.bias), minlength=bags.rows)
        score = -np.expm1(-np.logaddexp(0, self.bias) - score)
        if self.constant is not None:
            score = np.full(bags.rows, self.constant)
        return np.clip(score, 0, 1), worst, top


    def offending(self, bags: Bags, logits: np.ndarray, threshold: float) -> list[list[dict]]:
        """By row the sentences (start, end, score), in order, without which the row scores less than threshold."""
        out: list[list[dict]] = [[] for _ in range(bags.rows)]
        if self.constant is not None or not len(logits):
            return out
        edges = np.flatnonzero(np.r_[True, np.diff(bags.sentence) > 0, True])
        first, last = edges[:-1], edges[1:] - 1
        row, part = bags.row[first], added(logits, self.bias)
        live = np.flatnonzero(part > 0)
        live = live[np.lexsort((live, -part[live], row[live]))[::-1]]  # by row the lowest first
        total = np.cumsum(part[live])
        head = np.flatnonzero(np.r_[True, row[live][1:] != row[live][:-1]]) if len(live) else np.zeros(0, int)
        before = np.repeat(np.r_[0, total][head], np.diff(np.r_[head, len(live)]))
        rest = np.logaddexp(0, self.bias) + total - before  # with all that are lower in the row
        picked = np.sort(live[-np.expm1(-rest) >= threshold])
        if not len(picked):
            return out
        words, p = bags.words, sigmoid(logits)
        for own in np.split(picked, np.flatnonzero(np.diff(row[picked])) + 1):
            r = int(row[own[0]])
            at = int(words.offsets[r])
            points = np.r_[0, np.cumsum((words.data[at : words.offsets[r + 1]] & 0xC0) != 0x80)]  # code points up to a byte
            starts, ends = points[words.start[first[own]] - at], points[words.end[last[own]] - at]
            out[r] = [{"start": a, "end": b, "score": x} for a, b, x in zip(starts.tolist(), ends.tolist(), p[own].tolist(), strict=True)]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def added(logits: np.ndarray, bias: float) -> np.ndarray:
    """What sentences add to a document's -log(1 - score) beside its bias."""
    return np.maximum(np.logaddexp(0, logits) - np.logaddexp(0, bias), 0)


def fit(sample: DataFrame, l1: float = 2e-4, steps: int = 400, rate: float = 0.5) -> Model:
    """Noisy-or likelihood, L1 on word weights; Adam with soft thresholds.  sample: doc_id, bad, text.

    Here every plain sentence holds the bias, so a long clean row says something of it; scores count it once a document.
    """
    facts = sample.agg(F.count("*").alias("n"), F.avg("bad").alias("base")).first()
    if not facts["n"] or facts["base"] in (0, 1):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(facts["base"]) if facts["n"] else 0.5)
    chosen = chosen_features(sample, facts["base"])
    if not len(chosen):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(facts["base"]))
    held = sample.sparkSession.sparkContext.broadcast(chosen)
    rows = sample.mapInArrow(lambda it: incidence_rows(it, held.value), INCIDENCE).toArrow().sort_by("doc_id").combine_chunks()
    y, plain = rows.column("bad").to_numpy().astype(np.float64), rows.column("plain").to_numpy()
    sizes, features = rows.column("sizes").combine_chunks(), rows.column("features").combine_chunks()
    size = sizes.flatten().to_numpy()
    row_live = np.repeat(np.arange(len(y)), sizes.value_lengths().to_numpy())
    n_live, s_at, w_of = len(size), np.repeat(np.arange(len(size)), size), features.flatten().to_numpy()
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, bias = np.zeros(len(chosen)), MOST_BIAS
    m = v = np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        logits = bias + np.bincount(s_at, weights=w[w_of], minlength=n_live)
        p, p0 = sigmoid(logits), float(sigmoid(np.array(bias)))
        log_clean = -np.bincount(row_live, weights=np.logaddexp(0, logits), minlength=len(y)) - plain * np.logaddexp(0, bias)
        toxic = np.maximum(-np.expm1(log_clean), 1e-9)
        pull = balance * np.where(y > 0, np.exp(log_clean) / toxic, -1.0)  # derivative of the likelihood by -log_clean
        g_sentence = pull[row_live] * p
        grad = np.r_[np.bincount(w_of, weights=g_sentence[s_at], minlength=len(chosen)), g_sentence.sum() + (pull * plain).sum() * p0]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = (0.2 * rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = w + move[:-1]
        w = np.maximum(np.abs(w) - l1 * rate * 10, 0) * np.sign(w)
        bias = min(bias + float(move[-1]), MOST_BIAS)
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return Model(chosen[keep], w[keep], bias)


SENTENCE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
SCORED = "doc_id long, score double, worst_sentence string, worst_score double, sentences array<struct<start:long,end:long,score:double>>"


def score_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, "text"):
        bags = Bags(batch.column("text"))
        logits = model.sentence_logits(bags)
        score, worst, top = model.score(bags, logits)
        located = pa.array(model.offending(bags, logits, THRESHOLD), pa.list_(SENTENCE))
        spots = []
        for k in worst.tolist():
            if k < 0:
                spots.append("")
                continue
            upto = int(np.searchsorted(bags.sentence, bags.sentence[k], side="right"))
            spots.append(bytes(bags.words.data[bags.words.start[k] : bags.words.end[upto - 1]]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(spots, pa.string()), pa.array(top), located], names=["doc_id", "score", "worst_sentence", "worst_score", "sentences"])


def bare_rows(batches: Iterator[pa.RecordBatch], model: Model, name: str) -> Iterator[pa.RecordBatch]:
    """Every column as it came, and a score for each row."""
    for batch in small_slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(Bags(batch.column("text")))[0])], names=[*batch.schema.names, name])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(training_rows(docs, labels, "toxic", {1: MOST_POSITIVE, 0: MOST_NEGATIVE}))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, worst_sentence, worst_score, sentences) of every row; sentences are the offending ones, in order."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: score_rows(it, held.value), SCORED)


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score the threshold or more; all columns stay, nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh(docs, "_score")
    scored = docs.mapInArrow(lambda it: bare_rows(it, held.value, name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))
    return scored.filter(F.col(name) < threshold).drop(name)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("sentences", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_sentence", spans.alias("toxic_spans"))
