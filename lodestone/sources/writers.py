"""Writers: JSON lines, CSV, staged and frozen outputs, manifests, digests."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guards import GuardError

_FALLBACK: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir); a local one only where that is unset and the master is local, as in tests."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not told and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not told:
        told = _FALLBACK.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    path = f"{told.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if getattr(spark.sparkContext, "_jsc", None) is not None:
        fs, target = _fs(spark, path)
        fs.delete(target, True)


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def sink_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines; a number of files only where one reader needs them together."""
    (df.coalesce(files) if files else df).write.mode("errorifexists").json(path)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def sink_freeze(df: DataFrame, path: str) -> None:
    """Refuses to write where anything is."""
    df.write.mode("errorifexists").parquet(path)


def sink_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


MARK = "_version-"


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, name) of the complete versions below a path, oldest first."""
    fs, root = _fs(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return sorted((int(n), v) for n, v in (x.removeprefix(MARK).split("-", 1) for x in names if x.startswith(MARK)))


def sink_atomic(df: DataFrame, path: str) -> None:
    """A new version of a table: its rows are written to a folder of their own, then an empty mark, named by number and folder, makes it the current one.

    Creating the mark is the only step that readers (read_atomic) can see, so they get all of the old version or all of the new one, and a crash
    before it changes nothing.  The version before the new one stays for readers that still use it, older ones go.
    """
    spark = df.sparkSession
    before = _versions(spark, path)
    name = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    number = before[-1][0] + 1 if before else 0
    fs, mark = _fs(spark, f"{path.rstrip('/')}/{MARK}{number:012d}-{name}")
    if not fs.createNewFile(mark):
        raise OSError(f"{mark} could not be made")
    for n, old in before[:-1]:
        fs.delete(_fs(spark, f"{path.rstrip('/')}/{MARK}{n:012d}-{old}")[1], False)
        fs.delete(_fs(spark, f"{path.rstrip('/')}/{old}")[1], True)


def read_atomic(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that sink_atomic has written."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version below {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{found[-1][1]}")


def sink_shards(df: DataFrame, folder: str, split: str, shards: int) -> None:
    """Parquet files `split-i-of-n` in a folder: written beside it, then moved one by one; shards without rows are files too."""
    spark = df.sparkSession
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.withColumn("_shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).repartitionByRange(shards, "_shard").write.partitionBy("_shard").parquet(staging)
    fs, target = _fs(spark, folder)
    fs.mkdirs(target)
    for k in range(shards):
        part = _fs(spark, f"{staging}/_shard={k}")[1]
        files = [x.getPath() for x in fs.listStatus(part)] if fs.exists(part) else []
        if not files:
            spark.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{staging}/empty-{k}")
            files = [x.getPath() for x in fs.listStatus(_fs(spark, f"{staging}/empty-{k}")[1])]
        (one,) = [f for f in files if f.getName().endswith(".parquet")]
        if not fs.rename(one, _fs(spark, f"{folder.rstrip('/')}/{split}-{k:05d}-of-{shards:05d}.parquet")[1]):
            raise OSError(f"shard {k} of {split} could not be moved")
    fs.delete(_fs(spark, staging)[1], True)


def manifest(counts: DataFrame, key: str, value: str, files: DataFrame, **criteria: object) -> DataFrame:
    """One row: counts by key, file digests by name, and the criteria."""
    c = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("counts"))  # one entry a reason
    f = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "sha256")))).alias("files"))
    return c.join(F.broadcast(f)).select("counts", "files", *(F.lit(str(v)).alias(k) for k, v in criteria.items()))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the files below a path; Spark hands a file over as one cell, so files of 2 GB and more raise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def hash_pin(spark: SparkSession, path: str, expected: dict[str, str]) -> None:
    """Every named file must have its digest."""
    found = {r["file"]: r["sha256"] for r in file_digests(spark, path).filter(F.col("file").isin(list(expected))).collect()}
    wrong = {k for k, v in expected.items() if found.get(k) != v}
    if wrong:
        raise GuardError(f"digests differ or files are missing: {sorted(wrong)}")
