"""Quality classifier: a sparse ensemble of rules.

Text statistics (counts and shares of bytes, words, lines and repeats) are the only inputs.  Boosted shallow trees on a bounded sample of labelled rows
propose rules: every path from the root is a conjunction of comparisons.  Logistic regression with an L1 term weighs the
rules; the few with a weight are compiled into one Spark column over the statistics, which scores all rows.

Learning: at most `MOST_ROWS` labelled rows (the smallest hashes of their ids) outside the held-out fold; the driver sees their statistics, never texts.
Defined cases: a row with a null doc_id is scored, teaches nothing and is no held-out one; null or empty text has statistics of zero and is scored by the same rules; rows without a label, or whose id hashes into the held-out
fold, teach nothing; with labels of one kind only, or none, their mean (0.5 without labels) is the score of every row;
doc_ids that repeat in labels count as good if any of their rows is; columns beyond doc_id, text and quality are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, U, Words, mixed, small_slices, table, text_buffers, window_hashes, word_hashes
from .toxicity import fold, sigmoid

MOST_ROWS = 8000
THRESHOLD = 0.3
BINS, DEPTH, TREES, LEARNING_RATE = 32, 3, 40, 0.3
STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "mark", "space", "wide", "symbol_tail", "short_words", "new_words", "new_lines", "new_grams", "stops", "loudest")

_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def _among(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = {"upper": _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _among("0123456789"), "symbol": _among("#$%&*+/<=>@[\\]^_`{|}~"), "mark": _among("!\"'(),-.:;?"), "space": ~SPACED, "wide": np.arange(256) >= 128}


def _share_new(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct ones over all, by row; 0 without any."""
    _, first = np.unique(mixed(hashes + row.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(row[first], minlength=rows) / np.maximum(1, np.bincount(row, minlength=rows))


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for every text."""
    raw, offs = text_buffers(column)
    rows = len(offs) - 1
    size = np.diff(offs)
    words, lines = Words(column, SPACED), Words(column, _LINE)
    row, n_words = words.row_of(), np.diff(words.first)
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(n_words), "word_bytes": np.bincount(row, weights=words.end - words.start, minlength=rows) / np.maximum(1, n_words)}
    for name, kind in _CLASSES.items():
        sums = np.r_[0, np.cumsum(kind[raw], dtype=np.int64)]
        out[name] = (sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(1, size)
    tail = raw[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    out["symbol_tail"] = np.bincount(row, weights=_CLASSES["symbol"][tail], minlength=rows) / np.maximum(1, n_words)
    out["short_words"] = np.bincount(row, weights=words.end - words.start < 3, minlength=rows) / np.maximum(1, n_words)
    hashes = word_hashes(words)
    out["new_words"] = _share_new(hashes, row, rows)
    out["new_lines"] = _share_new(word_hashes(lines), lines.row_of(), rows)
    good = np.flatnonzero(row[: max(0, len(row) - 3)] == row[3:])
    out["new_grams"] = _share_new(window_hashes(hashes, 4)[good], row[good], rows)
    out["stops"] = np.bincount(row, weights=_among(".!?")[tail], minlength=rows) / np.maximum(1, n_words)
    out["loudest"] = np.bincount(row, weights=_among("!")[tail], minlength=rows) / np.maximum(1, n_words)
    return np.stack([out[k] for k in STATISTICS], axis=1).astype(np.float64)


def statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, "text"):
        found = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics...) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(statistic_rows, "doc_id long, " + ", ".join(f"{k} double" for k in STATISTICS))


# A rule is a tuple of (statistic, threshold, above): the statistic is greater than the threshold, or it isn't.
Rule = tuple[tuple[int, float, bool], ...]


def grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int = DEPTH, least: float = 5.0) -> tuple[list[Rule], np.ndarray]:
    """A tree by second-order gain; all its paths, and its value for every row."""
    value = np.zeros(len(x))
    rules: list[Rule] = []

    def split(rows: np.ndarray, path: Rule) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        value[rows] = -g / (h + 1.0)
        if path:
            rules.append(path)
        if len(path) == depth:
            return
        best = (1e-6, None)
        for k, at in enumerate(cuts):
            if not len(at):
                continue
            place = np.searchsorted(at, x[rows, k], side="left")  # cut j: x > at[j] where place > j
            gs = np.cumsum(np.bincount(place, weights=gradient[rows], minlength=len(at) + 1))[:-1]
            hs = np.cumsum(np.bincount(place, weights=hessian[rows], minlength=len(at) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(hs < least * 0.05) | (h - hs < least * 0.05)] = 0
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (gain[j], (k, float(at[j])))
        if best[1] is None:
            return
        k, cut = best[1]
        above = x[rows, k] > cut
        split(rows[~above], (*path, (k, cut, False)))
        split(rows[above], (*path, (k, cut, True)))

    split(np.arange(len(x)), ())
    return rules, value


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, cut, above in rule:
        out &= (x[:, k] > cut) == above
    return out


def tidy(rule: Rule) -> Rule:
    """One lower and one upper bound a statistic at most, in a fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for k, cut, above in rule:
        old = bounds.get((k, above), cut)
        bounds[k, above] = max(old, cut) if above else min(old, cut)
    return tuple((k, cut, above) for (k, above), cut in sorted(bounds.items()))


def lasso(a: np.ndarray, y: np.ndarray, l1: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 term by accelerated proximal gradient."""
    scale = np.maximum(a.std(axis=0), 0.02)  # near-constant rules pay more
    z = (a - a.mean(axis=0)) / scale
    u = np.ones(z.shape[1])
    for _ in range(30):  # the largest singular value by power iteration
        u = z.T @ (z @ u)
        u /= np.linalg.norm(u) + 1e-12
    size = 0.25 * 1.1 * np.linalg.norm(z @ u) ** 2 / len(y) + 0.25
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(steps):
        r = (sigmoid(z @ v + c) - y) / len(y)
        new = v - (z.T @ r) / size
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / size, 0)
        new_b = c - r.sum() / size
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w / scale, b - float((w / scale) @ a.mean(axis=0))


class RuleModel:
    def __init__(self, rules: list[Rule], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            out += w * holds(rule, x)
        return sigmoid(out)

    def column(self) -> Column:
        """The score as a Spark column over the statistics."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for k, cut, above in rule:
                c = F.col(STATISTICS[k])
                test = test & ((c > cut) if above else (c <= cut))
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, l1: float = 4e-4) -> RuleModel:
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return RuleModel([], [], float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    rules: dict[Rule, None] = {}
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        p = sigmoid(f)
        paths, value = grow(x, cuts, p - y, p * (1 - p))
        f += LEARNING_RATE * value
        rules.update(dict.fromkeys(map(tidy, paths)))
    a = np.stack([holds(r, x) for r in rules], axis=1)
    spread = np.flatnonzero((a.sum(axis=0) >= 3) & (a.sum(axis=0) <= len(y) - 3))
    w, b = lasso(a[:, spread].astype(np.float64), y, l1)
    names = list(rules)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel([names[spread[k]] for k in kept], w[kept].tolist(), b)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> RuleModel:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_label")).dropna()
    picked = known.filter(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(fold("doc_id") != 0).join(F.broadcast(picked), "doc_id")  # at most `most` rows
    rows = with_statistics(sample).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*STATISTICS, "_label")).alias("x")).select("x.*").collect()
    found = np.array(rows, dtype=np.float64).reshape(-1, len(STATISTICS) + 1)
    found = found[np.lexsort(found.T)]
    return fit(found[:, :-1], found[:, -1])


def quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, statistics..., score) of every row."""
    return with_statistics(docs).withColumn("score", model.column())


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
