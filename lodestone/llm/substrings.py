"""Substring de-duplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window of `width` consecutive words is hashed with Rabin-Karp modulo 2^64.  Neighbouring windows travel as one row: a run of windows that share their smallest
`GRAM`-word hash, which is the key of the shuffle, so equal windows meet.  There Spark unpacks the runs, takes the smallest doc_id of each window
hash, and what a smaller doc_id holds too becomes removal intervals, merged to maximal ones by document.
A task remembers windows that several of its documents have held, with their smallest doc_id; those of later documents are decided on the spot, so a passage that a
third of all rows share reaches its partition once a task, not once a row.
Partitions hold about `PARTITION` bytes of input up to `MOST_PARTITIONS` of them; then they grow to `LARGEST`, and beyond that the keys are dealt out to
passes over the input, each of which writes its intervals to the shared folder.  Nothing is dropped at any size.

Defined cases: null or empty text has no words; a text shorter than the window is never cut; a window repeated inside one
document only is kept; rows with equal doc_id never remove each other; a null doc_id counts as larger than any other, and rows
with null doc_id don't remove each other; columns beyond doc_id and text are ignored, whatever their names; an empty table gives an empty result.
Two different windows are taken as equal if their 64-bit hashes and their smallest `GRAM`-word hashes are (fewer than n^2 / 2^65 chances among n windows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED, U, Words, input_bytes, mixed, small_slices, staged, window_hashes, word_hashes

WIDTH = 50
GRAM = 16
NO_ID = np.iinfo(np.int64).max
PARTITION, LARGEST, MOST_PARTITIONS = 8 << 20, 64 << 20, 50_000
REMEMBERED = 1 << 20


def passes_and_partitions(size: int) -> tuple[int, int]:
    """How many passes over an input of some bytes, and into how many partitions each deals its windows."""
    passes = -(-size // (LARGEST * MOST_PARTITIONS)) or 1
    return passes, max(1, min(MOST_PARTITIONS, -(-size // (PARTITION * passes))))


def text_bytes(docs: DataFrame) -> int:
    """Catalyst's estimate of the input's size; where that is unknown or from a terabyte on, half the bytes of all texts, counted."""
    size = input_bytes(docs)
    return size if size < 1 << 40 else int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def smallest_of_group(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry the smallest id among entries with its hash."""
    if not len(hashes):
        return ids
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    least = np.minimum.reduceat(ids[order], heads)
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[heads, len(ids)]))
    return out


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Starts of maximal runs in which each column is constant."""
    change = np.zeros(len(columns[0]), dtype=bool)
    if len(change):
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def windows_of(batch: pa.RecordBatch, width: int) -> dict[str, np.ndarray] | None:
    """Window hash, key, row and position of every window of a slice."""
    words = Words(batch.column("text"), SPACED)
    if len(words) < width:
        return None
    hashes = word_hashes(words)
    row = words.row_of()
    good = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
    if not len(good):
        return None
    gram = min(GRAM, width)
    least = sliding_min(window_hashes(hashes, gram), width - gram + 1)
    row = row[good]
    return {"hash": window_hashes(hashes, width)[good], "least": least[good], "row": row, "pos": good - words.first[row]}


class Seen:
    """Window hashes that several documents of a task have held, with their smallest id; at most `most` of them, the latest."""

    def __init__(self, most: int):
        self.most = most
        self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def smallest(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """ids, or what is remembered of their windows where that is smaller."""
        if not len(self.hashes):
            return ids
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, np.minimum(ids, self.ids[at]), ids)

    def add(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        if not len(hashes):
            return
        if len(self.hashes) + len(hashes) <= self.most:
            hashes, ids = np.concatenate([self.hashes, hashes]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, hashes))
        first = order[np.r_[True, hashes[order][1:] != hashes[order][:-1]]][: self.most]
        self.hashes, self.ids = hashes[first], ids[first]


RUN = "least long, doc_id long, _key long, s long, e long, hashes array<long>"


def pack_windows(batches: Iterator[pa.RecordBatch], width: int, part: int = 0, passes: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of documents to runs of windows; rows without hashes are word intervals [s, e) that a task has decided by itself.  Keys of other passes are left out."""
    seen = Seen(REMEMBERED)
    for batch in small_slices(batches, "text"):
        found = windows_of(batch, width)
        if found is None:
            continue
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        keys = batch.column("_key").to_numpy(zero_copy_only=False)
        row, pos, hashes, least = (found[k] for k in ("row", "pos", "hash", "least"))
        if passes > 1:
            own = np.flatnonzero(mixed(least) % U(passes) == U(part))
            row, pos, hashes, least = row[own], pos[own], hashes[own], least[own]
        smallest = seen.smallest(hashes, smallest_of_group(hashes, ids[row]))
        gone = ids[row] > smallest
        out = []
        if gone.any():
            known, first = np.unique(hashes[gone], return_index=True)
            seen.add(known, smallest[gone][first])
            row_gone, pos_gone = row[gone], pos[gone]
            head = runs_of(row_gone, pos_gone - np.arange(len(pos_gone)))
            size = np.diff(np.r_[head, len(row_gone)])
            r, s = row_gone[head], pos_gone[head]
            none = pa.array([None] * len(r), pa.list_(pa.int64()))
            out.append((keys[r] ^ s, ids[r], keys[r], s, s + size + width - 1, none))  # any key will do
        row, pos, hashes, least = (x[~gone] for x in (row, pos, hashes, least))
        head = runs_of(least, row, pos - np.arange(len(pos)))
        if len(head):
            ends = np.r_[head, len(row)]
            r = row[head]
            out.append((least[head].view(np.int64), ids[r], keys[r], pos[head], pos[head] + np.diff(ends), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))))
        for columns in out:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), columns[5]], names=[x.split()[0] for x in RUN.split(", ")])


def counted(runs: DataFrame, width: int, partitions: int) -> DataFrame:
    """(doc_id, _key, spans) of runs of windows: places whose hash a smaller doc_id holds too; intervals that are decided pass through.

    One shuffle, of packed runs by key; smallest ids of hashes and intervals of runs are found inside its partitions.
    """
    met = runs.repartition(partitions, "least").select("least", "doc_id", "_key", "s", "e", F.posexplode_outer("hashes").alias("_at", "hash"))
    smaller = F.min("doc_id").over(Window.partitionBy("hash", "least"))
    gone = met.withColumn("_least_id", smaller).filter(F.col("hash").isNull() | (F.col("doc_id") > F.col("_least_id")))
    places = gone.groupBy("least", "doc_id", "_key", "s", "e").agg(F.array_sort(F.collect_list(F.col("s") + F.col("_at"))).alias("_p"))
    span = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    low, high = F.get("_p", F.lit(0)), F.get("_p", F.size("_p") - 1)
    spans = F.when(F.size("_p") == 0, F.array(span(F.col("s"), F.col("e")))).when(high - low + 1 == F.size("_p"), F.array(span(low, high + width))).otherwise(F.transform("_p", lambda p: span(p, p + width)))
    return places.select("doc_id", "_key", spans.alias("spans"))


def repeated_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, _key, spans): word intervals [s, e), per document, that a smaller doc_id holds too; _key is xxhash64 of the text."""
    passes, partitions = passes_and_partitions(text_bytes(docs))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("_key"))
    found = None
    for part in range(passes):
        own = counted(keyed.mapInArrow(lambda it, part=part: pack_windows(it, width, part, passes), RUN), width, partitions)
        if passes > 1:
            own = staged(own, "intervals")
        found = own if found is None else found.union(own)
    spans = F.array_distinct(F.array_sort(F.flatten(F.collect_list("spans"))))
    return found.groupBy("doc_id", "_key").agg(spans.alias("spans")).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal intervals of sorted ones."""
    out: list[tuple[int, int]] = []
    for x in spans:
        if out and x["s"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["e"]))
        else:
            out.append((x["s"], x["e"]))
    return out


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, "text", 16 << 20):
        n_words, n_removed, kept, spans_out = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # bytes.split() cuts at exactly \x20 and \x09-\x0D
            n_words.append(len(words))
            cut = merged(spans.as_py()) if spans.is_valid else []
            for s, e in reversed(cut):
                del words[s:e]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "replace"))
            spans_out.append([{"s": s, "e": e} for s, e in cut])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans_out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
            names=["doc_id", "n_words", "n_removed", "kept_text", "removed"],
        )


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in cut_rows(batches):
        sums = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("kept_text")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "n_words", "n_removed")), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def with_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    spans = repeated_intervals(docs, width)
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("_key"))
    on = left["doc_id"].eqNullSafe(spans["doc_id"]) & (left["_key"] == spans["_key"])
    return left.join(spans, on, "left").select(left["doc_id"], left["text"], spans["spans"])


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed): the kept words joined by one space, and the removed word intervals."""
    return with_spans(docs, width).mapInArrow(cut_rows, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<s:long,e:long>>")


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return with_spans(table(spark, sf_dir, "documents")).mapInArrow(digest_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 49) AS seq
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)
), hashed AS (SELECT doc_id, i, md5(array_to_string(seq, ' ')) AS h FROM win
), least AS (SELECT h, min(doc_id) AS m FROM hashed GROUP BY h
), cut AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS k FROM hashed JOIN least USING (h) WHERE doc_id > m
), pos AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS k FROM w
), kept AS (
  SELECT pos.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos.k) AS t
  FROM pos ANTI JOIN cut ON pos.doc_id = cut.doc_id AND pos.k = cut.k GROUP BY pos.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
