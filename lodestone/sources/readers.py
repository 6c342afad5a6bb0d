"""Readers: JSON lines, CSV, Parquet, option files, shards.  Paths are Spark's; nothing is opened outside its file systems."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.guards import GuardError, duplicates, require_empty


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of every line that isn't blank."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")


def scan_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines, blank ones skipped."""
    return spark.read.schema(schema).json(path)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """lines with `row`, and `bad` where the line isn't an object of the schema's types."""
    with_bad = f"{schema}, _corrupt string"
    row = F.from_json("value", with_bad, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    return lines.withColumn("row", row).withColumn("bad", F.col("row").isNull() | F.col("row._corrupt").isNotNull())


def scan_jsonl_typed(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): violations have file, value and the first thing wrong with the line."""
    lines = parsed_lines(text_lines(spark, path), schema)
    missing = [F.when(F.col(f"row.{c}").isNull(), F.lit(f"missing {c}")) for c in required]
    problem = F.coalesce(F.when(F.col("bad"), F.lit("malformed")), *missing)
    judged = lines.withColumn("problem", problem)
    names = [f.name for f in judged.schema["row"].dataType.fields if f.name != "_corrupt"]
    return judged.filter("problem IS NULL").select(*(F.col(f"row.{n}") for n in names)), judged.filter("problem IS NOT NULL").select("file", "value", "problem")


def scan_torn_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log whose last line may be torn: a malformed line is dropped if no row of its file comes after it, else it is an error.

    A line's place in its file is the start of its block and its turn in the task that reads the block, so files are split like any others and no
    file is ever one cell; one aggregate over files finds malformed lines that are not the last.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    lines = parsed_lines(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place")).filter(F.trim("value") != ""), schema)
    files = lines.groupBy("file").agg(F.count_if("bad").alias("n_bad"), F.max_by("bad", "place").alias("last_bad"))
    require_empty(files.filter(F.col("n_bad") > F.col("last_bad").cast("int")).select("file", "n_bad"), "malformed lines before the end of a log")
    names = [f.name for f in lines.schema["row"].dataType.fields if f.name != "_corrupt"]
    return lines.filter(~F.col("bad")).select(*(F.col(f"row.{n}") for n in names))


def scan_unique_by_id(df: DataFrame, key: str) -> DataFrame:
    require_empty(duplicates(df, key), f"{key} occurs more than once")
    return df


def scan_json_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without a key repeated in any object."""
    from ..functions.arrays import has_duplicate_keys

    lines = text_lines(spark, path)
    require_empty(lines.filter(has_duplicate_keys("value")).select("file", F.substring("value", 1, 80).alias("value")), "repeated keys")
    return parsed_lines(lines, schema).select("row.*").drop("_corrupt")


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def scan_parquet_cols(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def shard_check(names: DataFrame) -> DataFrame:
    """(split, found, expected, complete) from file names `split-i-of-n`."""
    parts = [F.regexp_extract("name", r"^(.*)-(\d+)-of-(\d+)(\..*)?$", k) for k in (1, 2, 3)]
    rows = names.select(parts[0].alias("split"), parts[1].try_cast("int").alias("i"), parts[2].try_cast("int").alias("n")).filter("n IS NOT NULL")
    return rows.groupBy("split").agg(F.countDistinct("i").alias("found"), F.max("n").cast("bigint").alias("expected"), ((F.countDistinct("i") == F.max("n")) & (F.min("n") == F.max("n")) & (F.max("i") < F.max("n"))).alias("complete"))


def scan_shards_complete(spark: SparkSession, folder: str, split: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a split whose shards are all there; an error otherwise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{split}-*-of-*").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    found = shard_check(files).filter(F.col("split") == split).collect()
    if not found or not found[0]["complete"]:
        raise GuardError(f"shards of {split} are not complete: {found}")
    return spark.read.option("pathGlobFilter", f"{split}-*-of-*").parquet(folder).select(*columns)


def flatten_options(spec: Column) -> Column:
    """array of struct(category, option) from a JSON text: a list, a map of lists or a map of maps of lists; keys with a leading underscore go."""
    as_list = F.transform(F.from_json(spec, "array<string>"), lambda o: F.struct(F.lit("").alias("category"), o.alias("option")))
    entries = lambda m: F.filter(F.map_entries(m), lambda e: ~e["key"].startswith("_"))
    flat = F.flatten(F.transform(entries(F.from_json(spec, "map<string,string>")), lambda e: F.transform(F.from_json(e["value"], "array<string>"), lambda o: F.struct(e["key"].alias("category"), o.alias("option")))))
    nested = F.flatten(F.transform(entries(F.from_json(spec, "map<string,string>")), lambda e: F.flatten(F.transform(entries(F.from_json(e["value"], "map<string,array<string>>")), lambda g: F.transform(g["value"], lambda o: F.struct(F.concat(e["key"], F.lit("."), g["key"]).alias("category"), o.alias("option")))))))
    kind = F.regexp_extract(spec, r"(?s)^\s*(\[|\{\s*\"[^\"]*\"\s*:\s*(?:\[|\{))", 1)
    return F.when(kind == "[", as_list).when(kind.endswith("["), flat).otherwise(nested)


def scan_options(spark: SparkSession, path: str) -> DataFrame:
    """(file, category, option) of option files."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("file"), F.explode(flatten_options(F.col("value"))).alias("o")).select("file", "o.*")


def merge_options(options: DataFrame) -> DataFrame:
    """Options of several files by category; an option text in two places is an error."""
    require_empty(duplicates(options, "option"), "an option occurs more than once")
    return options.groupBy("category").agg(F.array_sort(F.collect_list("option")).alias("options"))


def scan_tree_by_key(spark: SparkSession, root: str, schema: str, key: str, order: str) -> DataFrame:
    """Rows of all JSON files below a folder with split 'train', the last of each key in order of files and then of `order`."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(root).withColumn("_file", F.col("_metadata.file_path")).filter("split = 'train'")
    rest = [c for c in rows.columns if c not in (key, "_file")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_file", order)).alias("x")).select(key, "x.*").orderBy(key)


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def dataset_adapter(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a function from raw rows to canonical records."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in ADAPTERS:
            raise ValueError(f"adapter {name} is registered twice")
        ADAPTERS[name] = f
        return f

    return register


def adapt(name: str, raw: DataFrame) -> DataFrame:
    if name not in ADAPTERS:
        raise KeyError(f"no adapter {name}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[name](raw)


@dataset_adapter("coding")
def adapt_coding(raw: DataFrame, most_tests: int | None = None) -> DataFrame:
    """record_id by the first of hash_id, id, problem_id and the prompt's digest; the prompt from text or messages; inputs and outputs zipped, at most `most_tests`."""
    prompt = F.coalesce("prompt", F.array_join(F.transform("messages", lambda m: m["content"]), "\n"))
    tests = F.arrays_zip(F.col("inputs").alias("input"), F.col("outputs").alias("output"))
    tests = F.slice(tests, 1, most_tests) if most_tests else tests
    record_id = F.coalesce("hash_id", "id", "problem_id", F.sha2(prompt, 256))
    return raw.select(record_id.alias("record_id"), prompt.alias("prompt"), tests.alias("tests"))


def flatten_outputs(records: DataFrame) -> DataFrame:
    """(item, text): one row a generation, from rows with a list of outputs (named id#place) or a single one."""
    many = records.filter(F.size("outputs") > 0).select("id", F.posexplode("outputs").alias("place", "text")).select(F.concat_ws("#", "id", "place").alias("item"), "text")
    return many.unionByName(records.filter(F.coalesce(F.size("outputs"), F.lit(0)) <= 0).filter("output IS NOT NULL").select(F.col("id").alias("item"), F.col("output").alias("text")))


def json_str_column(records: DataFrame, column: str, schema: str) -> DataFrame:
    """Each JSON text of an array column as a row; malformed ones are skipped."""
    lines = records.select(*(c for c in records.columns if c != column), F.explode(column).alias("value"))
    good = parsed_lines(lines, schema).filter(~F.col("bad"))
    return good.select(*(c for c in records.columns if c != column), "row.*").drop("_corrupt")
