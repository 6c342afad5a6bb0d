"""Benchmark decontamination: an FM-index per training shard, searched backwards for every benchmark window.

A shard is a slice of documents (about 4 MB of text).  Its words become symbols; words that no benchmark window holds can't be part
of an occurrence, so the index keeps only maximal runs of benchmark words that are long enough, each ended by a separator.
Windows are searched from their last word to their first by ranks in a wavelet matrix over the Burrows-Wheeler transform,
all windows side by side; occurrences are located by walking back to sampled suffix positions, and overlapping ones merge into spans.
The benchmark travels to the executors in blocks of about `BLOCK_CHARS` characters.  With one block, the usual case, documents are never shuffled.  With more, each block is a job
of its own that writes its hits to the shared folder and then lets go of its broadcast, so at no time is more than one block held; hits meet the documents once at the end.

Defined cases: null or empty text has no words; an item of one to nine words is one window of its words; an item without words never
hits; items with equal item_id count once; a null item_id is named "null"; repeated documents are judged row by row;
columns beyond doc_id/item_id and text are ignored; with an empty benchmark nothing is hit.  Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, fresh, new_path, small_slices, table, word_hashes

WIDTH = 10
BLOCK_CHARS = 4_000_000
SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        now = symbols
        for level in reversed(range(self.depth)):
            bit = (now >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[k] stands before place at[k]."""
        low = np.zeros(len(at), dtype=np.int64)
        at = at.astype(np.int64)
        for level, ones, zeros in zip(reversed(range(self.depth)), self.ones, self.zeros, strict=True):
            bit = ((symbol >> level) & 1).astype(bool)
            at, low = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (at, low))
        return at - low


class FMIndex:
    """Index of a sequence of runs; symbol 0 ends a run and is never searched."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        rank = symbols.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # each separator is a symbol of its own, so that comparisons end with the run
        step = 1
        while True:
            later = np.zeros(n, dtype=np.int64)
            later[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2 if n else 1) + later
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            new = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 or step >= n:
                break
        self.bwt = symbols[order - 1]  # the place before the first one is the last separator
        self.before = np.r_[0, np.cumsum(np.bincount(symbols, minlength=sigma))]
        self.ranks = WaveletMatrix(self.bwt, sigma)
        run_start = np.r_[0, ends[:-1] + 1]
        into = np.arange(n) - np.repeat(run_start, np.diff(np.r_[run_start, n]))
        self.sampled = np.where(into[order] % sample == 0, order, -1)  # a run's first place always is: no walk crosses a separator

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern (right-aligned rows of symbols)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), len(self.bwt), dtype=np.int64)
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] < back) | (high[live] > low[live])]
            live = live[lengths[live] >= back]
            if not len(live):
                break
            c = patterns[live, -back]
            low[live] = self.before[c] + self.ranks.rank(c, low[live])
            high[live] = self.before[c] + self.ranks.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes by their rows."""
        out = np.empty(len(rows), dtype=np.int64)
        left, walked, at = np.arange(len(rows)), 0, rows.astype(np.int64)
        while len(left):
            known = self.sampled[at]
            done = known >= 0
            out[left[done]] = known[done] + walked
            left, at = left[~done], at[~done]
            c = self.bwt[at]
            at = self.before[c] + self.ranks.rank(c, at)
            walked += 1
        return out


class Phrases:
    """The windows of some benchmark items as symbols of their own vocabulary."""

    def __init__(self, item_ids: list, texts: list, width: int = WIDTH):
        words = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        hashes = word_hashes(words)
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        seen: dict[tuple, set[str]] = {}
        for k, item in enumerate(item_ids):
            own = symbols[words.first[k] : words.first[k + 1]].tolist()
            for i in range(max(1, len(own) - width + 1) if own else 0):
                seen.setdefault(tuple(own[i : i + width]), set()).add("null" if item is None else str(item))
        self.lengths = np.array([len(x) for x in seen], dtype=np.int64)
        self.patterns = np.array([[0] * (width - len(x)) + list(x) for x in seen], dtype=np.int64).reshape(len(seen), width)
        self.items = [sorted(x) for x in seen.values()]
        self.sigma = len(self.vocabulary) + 1
        self.shortest = int(self.lengths.min()) if len(seen) else 0

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word place) of every window in a slice; windows never cross rows."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.patterns) or not len(words):
            return none
        hashes = word_hashes(words)
        near = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[near] == hashes
        row = words.row_of()
        head = known & np.r_[True, ~known[:-1] | (row[1:] != row[:-1])]
        tail = known & np.r_[~known[1:] | (row[1:] != row[:-1]), True]
        s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
        long = e - s >= self.shortest
        s, e = s[long], e[long]
        if not len(s):
            return none
        size = e - s + 1  # a separator ends each run
        at = np.r_[0, np.cumsum(size)]
        place = np.arange(at[-1]) + np.repeat(s - at[:-1], size)
        symbols = near[np.minimum(place, len(near) - 1)] + 1
        symbols[at[1:] - 1] = 0
        index = FMIndex(symbols, self.sigma)
        low, high = index.search(self.patterns, self.lengths)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) + np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
        return which, place[index.locate(rows)]


SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
FOUND = "doc_id long, _key long, text string, n_words long, spans array<struct<s:long,e:long>>, items array<string>"


def merged(marks: np.ndarray) -> list[dict]:
    flips = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
    return [{"s": s, "e": e} for s, e in flips.reshape(-1, 2).tolist()]


def scan(batches: Iterator[pa.RecordBatch], phrases: Phrases, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, _key, text) with the merged spans of their words that windows cover, and the items these come from."""
    for batch in small_slices(batches, "text"):
        words = Words(batch.column("text"), ALNUM, lower=True)
        which, place = phrases.occurrences(words)
        row = np.searchsorted(words.first, place, side="right") - 1
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + phrases.lengths[which], -1)
        covered = np.cumsum(edge[:-1]) > 0
        spans, items = [[] for _ in range(words.rows)], [[] for _ in range(words.rows)]
        pair = np.unique(row * max(1, len(phrases.items)) + which)  # by row the windows that hit it, each once
        for own in np.split(pair, np.flatnonzero(np.diff(pair // max(1, len(phrases.items)))) + 1) if len(pair) else ():
            k = int(own[0] // len(phrases.items))
            items[k] = sorted({x for w in (own % len(phrases.items)).tolist() for x in phrases.items[w]})
            spans[k] = merged(covered[words.first[k] : words.first[k + 1]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_key"), batch.column("text") if keep_text else pa.nulls(words.rows, pa.string()), pa.array(np.diff(words.first), pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
            names=[x.split()[0] for x in FOUND.split(", ")],
        )


def join_spans(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, _key, text, spans, items) with the spans of several blocks as merged ones, and n_words."""
    for batch in small_slices(batches, "text"):
        words = Words(batch.column("text"), ALNUM, lower=True)
        n_words = np.diff(words.first)
        spans = batch.column("spans").to_pylist()
        for k, own in enumerate(spans):
            if own:
                marks = np.zeros(int(n_words[k]), dtype=bool)
                for x in own:
                    marks[x["s"] : x["e"]] = True
                spans[k] = merged(marks)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_key"), batch.column("text") if keep_text else pa.nulls(words.rows, pa.string()), pa.array(n_words, pa.int64()), pa.array(spans, SPANS), batch.column("items")],
            names=[x.split()[0] for x in FOUND.split(", ")],
        )


def phrases_of(benchmark: DataFrame, width: int, blocks: int, k: int) -> Phrases:
    own = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()
    return Phrases([r[0] for r in own], [r[1] for r in own], width)


def blocks_of(benchmark: DataFrame, block_chars: int) -> int:
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-int(total) // block_chars))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_key"), "text")


def hits(docs: DataFrame, benchmark: DataFrame, width: int, blocks: int) -> DataFrame:
    """(doc_id, _key, spans, items) of the rows that any of several blocks hits; equal rows have one."""
    spark = docs.sparkSession
    path = new_path(spark, "hits")
    for k in range(blocks):
        sent = spark.sparkContext.broadcast(phrases_of(benchmark, width, blocks, k))
        found = keyed(docs).mapInArrow(lambda it, sent=sent: scan(it, sent.value, False), FOUND)
        found.filter(F.size("spans") > 0).select("doc_id", "_key", "spans", "items").write.mode("append").parquet(path)
        sent.unpersist()
    read = spark.read.schema(", ".join(x for x in FOUND.split(", ") if x.split()[0] in ("doc_id", "_key", "spans", "items"))).parquet(path)
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return read.groupBy("doc_id", "_key").agg(whole("spans"), whole("items"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, keep_text: bool = True, width: int = WIDTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text, n_words, spans, items): merged word spans that benchmark windows cover, and the items they come from."""
    blocks = blocks_of(benchmark, block_chars)
    if blocks == 1:
        sent = docs.sparkSession.sparkContext.broadcast(phrases_of(benchmark, width, 1, 0))
        return keyed(docs).mapInArrow(lambda it: scan(it, sent.value, keep_text), FOUND).drop("_key")
    found = hits(docs, benchmark, width, blocks).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), "spans", "items")
    joined = keyed(docs).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    rows = joined.select("doc_id", "_key", "text", none("spans", "array<struct<s:long,e:long>>"), none("items", "array<string>"))
    return rows.mapInArrow(lambda it: join_spans(it, keep_text), FOUND).drop("_key")


def flag_rows(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    """Every column as it came; the last one becomes true where a window occurs."""
    for batch in small_slices(batches, "text"):
        words = Words(batch.column("text"), ALNUM, lower=True)
        _, place = phrases.occurrences(words)
        hit = batch.columns[-1].to_numpy(zero_copy_only=False).copy()
        hit[np.searchsorted(words.first, place, side="right") - 1] = True
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hit)], names=batch.schema.names)


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; all columns stay."""
    blocks = blocks_of(benchmark, block_chars)
    if blocks == 1:
        name = fresh(docs, "_hit")
        flagged = docs.withColumn(name, F.lit(False))
        sent = docs.sparkSession.sparkContext.broadcast(phrases_of(benchmark, width, 1, 0))
        return flagged.mapInArrow(lambda it: flag_rows(it, sent.value), flagged.schema).filter(~F.col(name)).drop(name)
    number, key = fresh(docs, "_id"), fresh(docs, "_of")
    found = hits(docs, benchmark, width, blocks).select(F.col("doc_id").alias(number), F.col("_key").alias(key))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(number)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")


def op8(spark, sf_dir: str) -> DataFrame:
    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS w, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (w, n)
), words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
