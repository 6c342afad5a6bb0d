"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64 bits over hashed 4-word shingles.  Two fingerprints link at `LIMIT` = 4 or fewer differing bits.

Index: the top nodes are masked bit patterns.  The 64 bits fall into six blocks; of any two fingerprints that differ in four bits
at most, at least two blocks agree, so the 15 choices of two agreeing blocks find every link.  A node with more than `NODE_CAP`
fingerprints gets lower nodes: its free bits fall into six blocks again.  Two rounds of that leave 28 free bits, three 19, so a node
is bounded.  Within a node fingerprints stand in Gray order, leaves hold 64 of them and factor out the bits they share; a pair of leaves is compared
only if the shared patterns of their parents, then their own, differ in four bits at most; a node of up to eight is one leaf.  A node passes on a spanning set of links, not all
pairs; links between different fingerprints are never lost to components, as all pairs not yet joined are compared.

Defined cases: null or empty text has fingerprint zero, linked like any other; fewer than four words are one shingle; equal texts
share a fingerprint and collapse before the index; rows with null doc_id get fingerprint and component like others (null counts as larger than any id);
columns beyond doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_hot, small_slices, staged, table
from .components import components

LIMIT = 4
SHINGLE = 4
SEED = 42
BLOCKS = 6
NODE_CAP = 8192
LEAF, FAN = 64, 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all shingles of a UTF-8 text, as a signed 64-bit integer."""
    words = text.lower().split()  # of bytes: lower() changes A-Z only, split() cuts at exactly \x20 and \x09-\x0D
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([h(joined, SEED)], dtype=np.uint64)
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(words) - shingle + 1].tolist()
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(start, end[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, "text", 16 << 20):
        found = [fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in batch.column("text")]
        kept = batch.drop_columns("text")
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.int64())], names=[*kept.schema.names, "fp"])


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; keyed: (doc_id, key, fp), where key is the text's hash."""
    key, name = ([F.xxhash64("text").alias("key")], "key long, ") if keyed else ([], "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, "text").mapInArrow(fingerprint_rows, f"doc_id long, {name}fp long")


def gray_rank(fp) -> "F.Column":
    """Place of a code word in Gray order, as a signed number whose order suffices."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


def block_masks(free: int, blocks: int = BLOCKS) -> list[int]:
    """Masks of the choices of two of `blocks` blocks of the set bits of `free`."""
    bits = [i for i in range(64) if free >> i & 1]
    parts = [sum(1 << i for i in p.tolist()) for p in np.array_split(bits, blocks)]
    return [a | b for a, b in combinations(parts, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def nodes_of(fps: DataFrame, cap: int = NODE_CAP, depth: int = 3) -> DataFrame:
    """(node, fp): every fingerprint under the masked patterns of its nodes; nodes over `cap` pass theirs to lower nodes."""
    full = (1 << 64) - 1
    settled, level = None, fps.select("fp", F.lit(str(full)).cast("decimal(20,0)").alias("free"), F.lit(0).cast("long").alias("up"))
    frees = [full]
    for at in range(depth):
        choices = {free: block_masks(free) for free in frees}
        arms = None
        for free, masks in choices.items():
            arm = F.array(*(F.struct(F.lit(str(free & ~m)).cast("decimal(20,0)").alias("free"), F.xxhash64(F.lit(at), F.col("up"), F.lit(signed(m)), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("node")) for m in masks))
            arms = F.when(F.col("free") == F.lit(str(free)).cast("decimal(20,0)"), arm) if arms is None else arms.when(F.col("free") == F.lit(str(free)).cast("decimal(20,0)"), arm)
        level = level.select("fp", F.explode(arms).alias("x")).select("fp", F.col("x.free").alias("free"), F.col("x.node").alias("up"))
        if at == depth - 1:
            break
        hot = [] if not _any_over(level, cap) else level.groupBy("up").count().filter(F.col("count") > cap).select("up")
        if not isinstance(hot, DataFrame):
            break
        cool = level.join(hot, "up", "left_anti").select(F.col("up").alias("node"), "fp")
        settled = cool if settled is None else settled.union(cool)
        level = staged(level.join(hot, "up", "left_semi").select("fp", "free", "up"), "nodes")
        frees = sorted({free & ~m & full for free, masks in choices.items() for m in masks})
    last = level.select(F.col("up").alias("node"), "fp")
    return last if settled is None else settled.union(last)


def _any_over(level: DataFrame, cap: int) -> bool:
    return bool(level.groupBy("up").count().filter(F.col("count") > cap).limit(1).count())


def shared(fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits that are one, and bits that are zero, in all of every `size` neighbours."""
    heads = np.arange(0, len(fps), size)
    return np.bitwise_and.reduceat(fps, heads), ~np.bitwise_or.reduceat(fps, heads)


def spanning_links(fps: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Links (pairs of places) that join all of a node's fingerprints, in Gray order, that chains of at most `limit` bits join."""
    n = len(fps)
    near = np.bitwise_count(fps[1:] ^ fps[:-1]) <= limit
    links = [(i, i + 1) for i in np.flatnonzero(near).tolist()]
    label = np.r_[0, np.cumsum(~near)]
    if label[-1] == 0:
        return links
    ones, zeros = shared(fps, LEAF)
    up_ones, up_zeros = np.bitwise_and.reduceat(ones, np.arange(0, len(ones), FAN)), np.bitwise_and.reduceat(zeros, np.arange(0, len(zeros), FAN))
    apart = lambda o, z, os, zs: np.bitwise_count((o & zs) | (z & os))
    for a in range(len(ones)):
        tops = np.flatnonzero(apart(up_ones[a // FAN], up_zeros[a // FAN], up_ones, up_zeros) <= limit)
        leaves = (tops[:, None] * FAN + np.arange(FAN)).ravel()
        leaves = leaves[(leaves >= a) & (leaves < len(ones))]
        leaves = leaves[apart(ones[a], zeros[a], ones[leaves], zeros[leaves]) <= limit]
        others = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        others = others[others < n]
        for i in range(a * LEAF, min(n, (a + 1) * LEAF)):
            rest = others[(others > i) & (label[others] != label[i])]
            hits = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= limit]
            while len(hits):
                links.append((i, int(hits[0])))
                label[label == label[hits[0]]] = label[i]
                hits = hits[label[hits] != label[i]]
    return links


def link_nodes(batches: Iterator[pa.RecordBatch], limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """Rows (node, fp), sorted by node and Gray rank, to links (a, b); a node may span batches."""

    def work(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
        sizes = np.diff(np.r_[heads, len(node)])
        a, b = [], []
        small = np.repeat(sizes <= 8, sizes)
        for lag in range(1, 8):  # leaves by themselves: their pairs side by side, all such nodes at once
            if len(node) <= lag:
                break
            hit = np.flatnonzero((node[lag:] == node[:-lag]) & small[lag:] & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= limit))
            a.append(fp[hit])
            b.append(fp[hit + lag])
        for at, size in zip(heads[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            if links := spanning_links(fp[at : at + size], limit):
                pairs = np.array(links)
                a.append(fp[at + pairs[:, 0]])
                b.append(fp[at + pairs[:, 1]])
        whole = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in whole], names=["a", "b"])

    held_node, held_fp = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        node = batch.column("node").to_numpy()
        fp = batch.column("fp").to_numpy().view(np.uint64)
        if not len(node):
            continue
        held_node.append(node)
        held_fp.append(fp)
        if node[0] == node[-1] and (len(held_node[0]) == 0 or held_node[0][-1] == node[0]):
            continue  # still the same node
        node, fp = np.concatenate(held_node), np.concatenate(held_fp)
        done = int(np.searchsorted(node != node[-1], False)) if node[0] == node[-1] else int(np.flatnonzero(node != node[-1])[-1]) + 1
        yield work(node[:done], fp[:done])
        held_node, held_fp = [node[done:]], [fp[done:]]
    yield work(np.concatenate(held_node), np.concatenate(held_fp))


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Distinct links (a, b) between distinct fingerprints; they join everything that links of up to `limit` bits join."""
    if not 0 <= limit <= BLOCKS - 2:
        raise ValueError(f"two of {BLOCKS} blocks agree only up to {BLOCKS - 2} differing bits")
    placed = nodes_of(fps).repartition("node").sortWithinPartitions("node", gray_rank(F.col("fp")))
    return placed.mapInArrow(lambda it: link_nodes(it, limit), "a long, b long").distinct()


def members(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows, which have doc_id and fp, with component (a fingerprint) and component_id (the smallest doc_id of the component).

    A fingerprint, or a component, that a large share of the rows has meets its one row by broadcast (join_hot), whatever its size.
    """
    fps = staged(rows, "fingerprints")
    groups = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("fps")).first()
    member = components(links(groups.select("fp"), limit))
    joined = groups.join(member, groups["fp"] == member["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = staged(joined, "components")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = join_hot(joined.select("fp", "component"), least, "component", total["fps"])
    return join_hot(fps, of_fp, "fp", total["rows"])


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of up to `limit` bits reach."""
    return members(fingerprints(docs), limit).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs without near-duplicates: of every component one row stays, that with the smallest doc_id (null ids last), then the smallest hash of the text."""
    none, number, key, turn = (fresh(docs, c) for c in ("_none", "_id", "_hash", "_turn"))
    row_key = [none, number, key]
    told = lambda doc_id, text_hash: (doc_id.isNull().alias(none), F.coalesce(doc_id, F.lit(0)).alias(number), text_hash.alias(key))
    found = members(fingerprints(docs, keyed=True), limit).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = found.groupBy("component").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key")).select(*told(F.col("doc_id"), F.col("key")))
    one = Window.partitionBy(*row_key).orderBy(key)  # the same row again; the limit of ranks works before the shuffle too, so a row repeated many times is no task of its own
    rows = docs.select("*", *told(F.col("doc_id").cast("long"), F.xxhash64("text"))).withColumn(turn, F.row_number().over(one)).filter(F.col(turn) == 1)
    return rows.join(heads, row_key).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
