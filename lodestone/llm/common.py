"""Shared pieces: the shared folder, written intermediate tables, Arrow text buffers, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where the setting is missing and the master is local, as in tests."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _FALLBACK:
        _FALLBACK[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _FALLBACK[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path with the file system it belongs to; a session that is gone leaves it in place."""
    sc = spark.sparkContext
    if getattr(sc, "_jsc", None) is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str) -> DataFrame:
    """As staged, at a path that the caller removes when nothing reads it any more."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LEAST_HOT, MOST_HOT = 512, 2000


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """Keys with over `LEAST_HOT` rows and over 1 / `MOST_HOT` of all rows, so at most `MOST_HOT` of them; none is None."""
    found = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(LEAST_HOT, total // MOST_HOT)).select(key).collect() if total > LEAST_HOT else []
    return rows.sparkSession.createDataFrame([tuple(r) for r in found], rows.select(key).schema) if found else None


def join_hot(big: DataFrame, small: DataFrame, key: str, total: int, partitions: int | None = None) -> DataFrame:
    """big joined with small (unique keys) on a key that a large share of big's `total` rows may have: hot keys meet their few rows of small by broadcast, the rest by shuffle.

    With `partitions` the shuffle deals both sides into as many, for rows that are large.
    """
    dealt = lambda df: df.repartition(partitions, key) if partitions else df
    hot = hot_keys(big, key, total)
    if hot is None:
        return dealt(big).join(dealt(small), key)
    few = F.broadcast(small.join(F.broadcast(hot), key, "left_semi"))  # at most MOST_HOT rows
    return big.join(few, key).unionByName(dealt(big.join(F.broadcast(hot), key, "left_anti")).join(dealt(small), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a scan; only sizes of hash partitions follow from it, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# ---------------------------------------------------------------- Arrow text

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`; the separators are ASCII, so bytes tell as much as code points.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def small_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        _, offs = text_buffers(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a slice: byte ranges [start, end), `first`, the word offsets of its rows, and `offsets`, their bytes."""

    def __init__(self, column: pa.Array, kinds: np.ndarray, lower: bool = False):
        raw, offs = text_buffers(column)
        self.data = LOWER[raw] if lower else raw
        inside = kinds[self.data]
        n = len(inside)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offs] = True
        before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.rows, self.offsets = len(offs) - 1, offs

    def __len__(self) -> int:
        return len(self.start)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15 | 1), U(0xD1342543DE82EF95)
_BYTE = np.random.default_rng(20240613).integers(1, 1 << 63, size=256, dtype=np.int64).astype(np.uint64) * U(2) + U(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    have = 1
    with np.errstate(over="ignore"):
        while have < n:  # doubling: base^(have+i) = base^have * base^i
            more = min(have, n - have)
            out[have : have + more] = out[:more] * (out[have - 1] * base)
            have += more
    return out


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up[:n], self.down[:n]


_OF_BYTES, _OF_WORDS = Powers(_BASE), Powers(_STEP)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def word_hashes(words: Words, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every word: Rabin-Karp over its bytes, by prefix sums over blocks of words."""
    out = np.empty(len(words), dtype=np.uint64)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(words.end, words.start[at] + block, side="right")))
        lo, hi = int(words.start[at]), int(words.end[to - 1])
        up, down = _OF_BYTES.to(hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[words.data[lo:hi]] * up, out=sums[1:])
        s, e = words.start[at:to] - lo, words.end[at:to] - lo
        out[at:to] = mixed((sums[e] - sums[s]) * down[s])
        at = to
    return out


def prefix_hashes(words: Words, sizes: tuple[int, ...], block: int = 1 << 20) -> np.ndarray:
    """word_hashes, then a column for each size: the hash of a word's first bytes, 0 where the word isn't longer than that."""
    out = np.zeros((len(words), 1 + len(sizes)), dtype=np.uint64)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(words.end, words.start[at] + block, side="right")))
        lo, hi = int(words.start[at]), int(words.end[to - 1])
        up, down = _OF_BYTES.to(hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[words.data[lo:hi]] * up, out=sums[1:])
        s, e = words.start[at:to] - lo, words.end[at:to] - lo
        out[at:to, 0] = mixed((sums[e] - sums[s]) * down[s])
        for k, size in enumerate(sizes, 1):
            long = np.flatnonzero(e - s > size)
            out[at + long, k] = mixed((sums[s[long] + size] - sums[s[long]]) * down[s[long]] + U(size))
        at = to
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` hashes: n - width + 1 values."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _OF_WORDS.to(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


def text_hash(word: bytes) -> int:
    """word_hashes of one word, for vocabularies made on the driver."""
    col = pa.array([word.decode("utf-8", "surrogatepass")])
    found = Words(col, np.ones(256, dtype=bool))
    return int(word_hashes(found)[0])
