"""Approximate nearest neighbours by a permutation index.

Equal vectors are one class with its `k` + 1 smallest ids, which is all that any search can ask of it, so a hot group of copies is indexed and searched once.
A class is represented by its `PREFIX` nearest pivots of `PIVOTS`, in order.  The index is the table of classes in order of those permutations, cut into shards of
at most `SHARD`; a shard posts each class in the inverted files of its pivots together with its place there.  A query reads the files of its own
pivots and adds up footrule distances (a pivot outside a prefix counts as place `PREFIX`).  Classes within the query's radius are
candidates and are reranked by the inner product in double precision.

The radius: a bounded sample of classes (`SAMPLE`, the smallest hashes) gives the pivots and, for each query, the distance that a share of the sample lies within.  The
share is measured on the data: for `TRIALS` queries the true neighbours are found among all classes, and it is the smallest share that would have held
`TARGET` of them (`WIDEST` ids of candidates at least).  So the work follows from how well permutations tell these vectors apart, radii
don't depend on shards or partitions, and nothing is cut: all that lies within the radius, ties too, is reranked.

A shard's directory holds, by pivot, the best place any of its classes has; a query whose radius no class with those places could reach skips the shard, and shards
that all queries of a block skip aren't read.  Queries go out in blocks of about `BLOCK` in the same order; each block is a job of its own that writes its hits to the shared
folder, so neither the driver nor a plan grows with their number, and a lost executor costs a part of one block.
Vectors get one more coordinate, sqrt(M^2 - |x|^2) with the largest norm M, so that the largest inner product is the nearest vector.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length from the commonest length (ties: the shorter),
take no part, neither as queries nor as candidates; a query never finds its own vec_id; rows that repeat a vec_id stand for one (the greatest array of components);
ties go to the smaller vec_id; rows with a null vec_id take no part; columns beyond vec_id and embedding are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, staged, table

PIVOTS, PREFIX = 256, 64
SAMPLE, TRIALS, TARGET = 4096, 128, 0.97
SHARD, BLOCK = 8192, 16384
WIDEST = 4  # a radius holds 4 k classes at least
DIRECTORY_BYTES = 64 << 20
K = 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & fine)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def packed(prefixes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in prefixes.astype(np.uint16)], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in column]).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


class Pivots:
    def __init__(self, sample: np.ndarray, norm: float, count: int = PIVOTS, prefix: int = PREFIX):
        self.norm = norm
        order = np.random.default_rng(7).permutation(len(sample))[:count]
        self.points = self.lifted(sample[order])
        self.prefix = min(prefix, len(self.points))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(axis=1)))]

    def nearest(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The numbers of the nearest pivots of every row, nearest first."""
        near = x @ self.points[:, :-1].T if query else self.lifted(x) @ self.points.T
        return np.argsort(-near, axis=1, kind="stable")[:, : self.prefix]


class Files:
    """Pivot inverted files over some prefixes: a file has a slot for each owner with the pivot's place there, or the prefix's length where it isn't posted.

    A quarter of all slots are postings (PREFIX of PIVOTS), so a byte each is less than a list of owners and places, and a query adds up whole files.
    """

    def __init__(self, near: np.ndarray, pivots: int):
        self.n, self.prefix = near.shape
        kind = np.uint8 if self.prefix < 256 else np.uint32
        self.slots = np.full((pivots, self.n), self.prefix, kind)
        self.slots[near.ravel(), np.repeat(np.arange(self.n), self.prefix)] = np.tile(np.arange(self.prefix, dtype=kind), self.n)
        self.best = self.slots.min(axis=1, initial=self.prefix).astype(np.int64)
        self.own, self.kind = np.arange(self.prefix, dtype=kind)[:, None], np.uint16 if self.prefix < 256 else np.uint32

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of every owner to a query's pivots, up to the part that all share.

        A pivot that only the owner has costs prefix - its place; summed over all its pivots that is the same for every owner, and each shared one is taken off
        again: twice what is left of the prefix behind the later of its two places.
        """
        files = self.slots[order]
        np.maximum(files, self.own, out=files)
        return 2 * (files.sum(axis=0, dtype=self.kind).astype(np.int64) - self.prefix * len(order))


def reachable(best: np.ndarray, orders: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Of queries (prefixes, radii) those that some class of a shard could lie within, by the best places of the shard's directory."""
    m = orders.shape[1]
    return -2 * (m - np.maximum(best[orders], np.arange(m))).sum(axis=1) <= radii


def radius(files: Files, order: np.ndarray, share: float, least: int, total: int) -> int:
    """The distance within which the share of the sample lies, and `least` of `total` at least; everything where that is all."""
    want = int(np.ceil(max(share, least / max(1, total)) * files.n))
    return np.iinfo(np.int32).max if want >= files.n else int(np.partition(files.footrule(order), want - 1)[want - 1])


MOST_RANGES = 100


def live_ranges(live: dict[int, bool]) -> Column:
    """Whether a shard lies in one of the runs of shards that some query can reach, by number, as a filter that the scan can use; over `MOST_RANGES` runs the nearest ones become one."""
    shards = sorted(live)
    runs: list[list[int]] = []
    for k, shard in enumerate(shards):
        if live[shard]:
            if runs and k and live[shards[k - 1]]:
                runs[-1][1] = shard
            else:
                runs.append([shard, shard])
    step = -(-len(runs) // MOST_RANGES) or 1
    found = F.lit(False)
    for k in range(0, len(runs), step):
        found = found | F.col("shard").between(runs[k][0], runs[min(k + step, len(runs)) - 1][1])
    return found


CLASS = "rep long, embedding array<double>, ids array<long>, k1 long, k2 long, p0 int, p1 int, prefix binary"


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(k1, k2, rep, embedding, ids): equal vectors with their k + 1 smallest ids; the limit of ranks works before the shuffle too."""
    w = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1)
    return few.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.any_value("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def place_rows(batches: Iterator[pa.RecordBatch], pivots: Pivots) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            near = pivots.nearest(matrix(batch.column("embedding")))
            second = near[:, min(1, near.shape[1] - 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "embedding", "ids", "k1", "k2")), pa.array(near[:, 0].astype(np.int32)), pa.array(second.astype(np.int32)), packed(near)], names=[x.split()[0] for x in CLASS.split(", ")])


def number_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in runs of at most SHARD, numbered."""
    from pyspark import TaskContext

    base, n = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        yield batch.append_column("shard", pa.array(base + (n + np.arange(batch.num_rows)) // SHARD))
        n += batch.num_rows


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole shards of a partition whose rows stand in order of shards."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column("shard")[0].as_py() != shard[a]:
                yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held)


def directory_rows(batches: Iterator[pa.RecordBatch], pivots: int) -> Iterator[pa.RecordBatch]:
    for shard, rows in by_shard(batches):
        best = Files(unpacked(rows.column("prefix").combine_chunks()), pivots).best
        yield pa.RecordBatch.from_arrays([pa.array([shard]), packed(best[None])], names=["shard", "best"])


def exact_top(x: np.ndarray, reps: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k rows with the largest inner product, ties to the smaller rep; row by row, so that equal vectors score the same to the last bit."""
    score = (x * q).sum(axis=1)
    best = np.lexsort((reps, -score))[:k]
    return best, score[best]


def trial_rows(batches: Iterator[pa.RecordBatch], trials: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """(trial, score, rep, distance): of every batch the k true neighbours of each trial query and their footrule distances."""
    ids, queries, orders, pivots = trials
    for batch in batches:
        if not batch.num_rows:
            continue
        x, reps = matrix(batch.column("embedding")), batch.column("rep").to_numpy()
        files = Files(unpacked(batch.column("prefix")), pivots)
        for t in range(len(ids)):
            far = files.footrule(orders[t])
            best, score = exact_top(x, reps, queries[t], k + 1)
            own = best[reps[best] != ids[t]][:k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t)), pa.array((x[own] * queries[t]).sum(axis=1)), pa.array(reps[own]), pa.array(far[own])], names=["trial", "score", "rep", "distance"])


def radius_rows(batches: Iterator[pa.RecordBatch], sample: Files, pivots: Pivots, share: float, least: int, total: int) -> Iterator[pa.RecordBatch]:
    """Queries with the order of their pivots and their radius."""
    for batch in batches:
        if batch.num_rows:
            orders = pivots.nearest(matrix(batch.column("embedding")), query=True)
            radii = np.array([radius(sample, o, share, least, total) for o in orders], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "embedding", "block")), packed(orders), pa.array(radii)], names=["rep", "embedding", "block", "prefix", "radius"])


def search_rows(batches: Iterator[pa.RecordBatch], block: tuple, pivots: int, k: int) -> Iterator[pa.RecordBatch]:
    """(query, score, ids): for each query of a block its k + 1 best classes in every shard."""
    asked, queries, orders, radii = block
    for _, rows in by_shard(batches):
        x, reps = matrix(rows.column("embedding").combine_chunks()), rows.column("rep").to_numpy()
        files = Files(unpacked(rows.column("prefix").combine_chunks()), pivots)
        found_q, found_s, found_r = [], [], []
        for i in np.flatnonzero(reachable(files.best, orders, radii)).tolist():
            near = np.flatnonzero(files.footrule(orders[i]) <= radii[i])
            best, score = exact_top(x[near], reps[near], queries[i], k + 1)
            found_q.append(np.full(len(best), asked[i]))
            found_s.append(score)
            found_r.append(near[best])
        if found_q:
            ids = rows.column("ids").combine_chunks().take(pa.array(np.concatenate(found_r)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_q)), pa.array(np.concatenate(found_s)), ids], names=["query", "score", "ids"])


def measured_share(spark, index: DataFrame, asked: DataFrame, sample: Files, pivots: Pivots, k: int) -> float:
    """The share of the sample that TARGET of the true neighbours of some queries lie within."""
    own = asked.orderBy(F.xxhash64("rep"), "rep").limit(TRIALS).select("rep", "embedding").collect()
    if not own:
        return 1.0
    queries = np.array([r["embedding"] for r in own])
    orders = pivots.nearest(queries, query=True)
    held = spark.sparkContext.broadcast((np.array([r["rep"] for r in own]), queries, orders, len(pivots.points)))
    found = index.select("rep", "embedding", "prefix").mapInArrow(lambda it: trial_rows(it, held.value, k), "trial long, score double, rep long, distance long")
    w = Window.partitionBy("trial").orderBy(F.desc("score"), "rep")
    true = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("trial", "distance").collect()  # TRIALS * k rows
    held.unpersist()
    if not true:
        return 1.0
    at = np.array([r["trial"] for r in true])
    far = np.array([r["distance"] for r in true])
    shares = np.concatenate([(sample.footrule(orders[t])[None] <= far[at == t][:, None]).mean(axis=1) for t in np.unique(at)])
    return float(np.quantile(shares, TARGET))


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row with is_query its k nearest by inner product, nearest first."""
    spark = vectors.sparkSession
    context = spark.sparkContext
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    rows = staged(rows, "vectors")
    classes = staged(classes_of(rows, k), "classes")
    facts = classes.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"), F.count("*").alias("n")).first()
    if facts["norm"] is None:
        return spark.createDataFrame([], schema)
    chosen = np.array([r[0] for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").collect()])
    pivots = Pivots(chosen, facts["norm"])
    sample = Files(pivots.nearest(chosen), len(pivots.points))
    held = context.broadcast((pivots, sample))
    placed = classes.select("rep", "embedding", "ids", "k1", "k2").mapInArrow(lambda it: place_rows(it, held.value[0]), CLASS)
    shards = max(1, -(-facts["n"] // SHARD))
    ordered = placed.repartitionByRange(shards, "p0", "p1", "rep").sortWithinPartitions("p0", "p1", "rep")
    index = staged(ordered.mapInArrow(number_shards, f"{CLASS}, shard long"), "permutations")
    member = staged(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "k1", "k2").join(index.select("k1", "k2", "rep"), ["k1", "k2"]).select("query_id", "rep"), "members")
    asked = index.join(member.select("rep").distinct(), "rep", "left_semi")
    share = measured_share(spark, index, asked, sample, pivots, k)
    total = facts["n"]
    blocks = max(1, -(-member.select("rep").distinct().count() // BLOCK))
    lined = asked.select("rep", "embedding", "p0", "p1").repartitionByRange(blocks, "p0", "p1", "rep").withColumn("block", F.spark_partition_id())
    queries = staged(lined.select("rep", "embedding", "block").mapInArrow(lambda it: radius_rows(it, held.value[1], held.value[0], share, WIDEST * k, total), "rep long, embedding array<double>, block int, prefix binary, radius long"), "queries")
    directory = None
    if 2 * len(pivots.points) * shards <= DIRECTORY_BYTES:
        told = index.select("shard", "prefix").mapInArrow(lambda it: directory_rows(it, len(held.value[0].points)), "shard long, best binary").collect()
        directory = {}
        for r in told:  # a shard that several tasks read has a row of each
            best = np.frombuffer(r["best"], np.uint16).astype(np.int64)
            directory[r["shard"]] = np.minimum(directory.get(r["shard"], best), best)
    path = new_path(spark, "hits")
    for b in range(blocks):
        own = queries.filter(F.col("block") == b).toArrow()
        if not own.num_rows:
            continue
        block = (own.column("rep").to_numpy(), matrix(own.column("embedding").combine_chunks()), unpacked(own.column("prefix").combine_chunks()), own.column("radius").to_numpy())
        sent = context.broadcast(block)
        part = index.select("shard", "rep", "embedding", "prefix", "ids")
        if directory is not None:
            part = part.filter(live_ranges({s: bool(reachable(best, block[2], block[3]).any()) for s, best in directory.items()}))
        n_pivots = len(pivots.points)
        part.mapInArrow(lambda it, sent=sent: search_rows(it, sent.value, n_pivots, k), "query long, score double, ids array<long>").write.mode("append").parquet(path)
        sent.unpersist()
    found = spark.read.schema("query long, score double, ids array<long>").parquet(path)
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("_r", F.row_number().over(by_class)).filter(F.col("_r") <= k + 1).drop("_r")
    own = member.join(best, member["rep"] == best["query"]).filter("vec_id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
