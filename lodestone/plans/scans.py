"""Sources and sinks: what is written and read again must be the table it came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import readers, writers
from ..tables import derived, load, oracle

_DOC = "doc_id long, lang string, source string, n_chars long"
_DOC_SQL = "SELECT doc_id, lang, source, n_chars FROM documents"


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("scan_jsonl", _DOC_SQL)
def _(spark, sf_dir):
    path = writers.scratch(spark, "jsonl")
    writers.sink_append(_docs(spark, sf_dir), path)
    return readers.scan_jsonl(spark, path, _DOC)


def _lines(spark, sf_dir):
    return load(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 10 = 0 THEN '{\"event_id\": tor' WHEN event_id % 10 = 1 THEN concat('{\"event_id\": ', event_id, '}') WHEN event_id % 10 = 2 THEN '  ' ELSE concat('{\"event_id\": ', event_id, ', \"kind\": \"', event_type, '\"}') END AS value")


@query("scan_jsonl_typed", "SELECT CASE WHEN event_id % 10 = 0 THEN 'malformed' WHEN event_id % 10 = 1 THEN 'missing kind' ELSE 'fine' END AS problem, count(*) AS n FROM events WHERE event_id % 10 <> 2 GROUP BY 1")
def _(spark, sf_dir):
    path = writers.scratch(spark, "typed")
    _lines(spark, sf_dir).write.text(path)
    rows, bad = readers.scan_jsonl_typed(spark, path, "event_id long, kind string", ["kind"])
    return bad.groupBy("problem").agg(F.count("*").alias("n")).union(rows.agg(F.lit("fine").alias("problem"), F.count("*").alias("n")))


def _torn(spark, sf_dir, name):
    """One log file of users whose last line is torn."""
    path = writers.scratch(spark, name)
    users = load(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "concat('{\"id\": ', c_custkey, '}') AS value").union(spark.createDataFrame([(1 << 60, '{"id": 12')], "k long, value string"))
    users.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


@query("scan_jsonl_torn_tail", "SELECT c_custkey AS id FROM customer")
def _(spark, sf_dir):
    return readers.scan_torn_tail(spark, _torn(spark, sf_dir, "torn"), "id long")


@query("scan_torn_repair", "SELECT count(*) AS n, max(c_custkey) AS last_id FROM customer")
def _(spark, sf_dir):
    """The repaired log is a new one; inputs are never changed."""
    path = writers.scratch(spark, "repaired")
    writers.sink_freeze(readers.scan_torn_tail(spark, _torn(spark, sf_dir, "torn"), "id long"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("scan_unique_by_id", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf_dir):
    return readers.scan_unique_by_id(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("scan_json_strict", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def _(spark, sf_dir):
    path = writers.scratch(spark, "strict")
    writers.sink_jsonl(load(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS segment"), path)
    return readers.scan_json_strict(spark, path, "id long, segment string")


@query("scan_csv", "SELECT doc_id, text FROM documents")
def _(spark, sf_dir):
    path = writers.scratch(spark, "csv")
    writers.sink_csv(load(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return readers.scan_csv(spark, path, "doc_id long, text string")


@query("scan_parquet_cols", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(spark, sf_dir):
    return readers.scan_parquet_cols(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).filter("l_quantity > 45")


@query("scan_shards_complete", "SELECT doc_id, lang FROM documents")
def _(spark, sf_dir):
    path = writers.scratch(spark, "shards")
    writers.sink_shards(_docs(spark, sf_dir), path, "train", 4)
    return readers.scan_shards_complete(spark, path, "train", ["doc_id", "lang"])


@query("shard_check", "SELECT 'split' || r_regionkey AS split, CAST(4 - (r_regionkey % 2) AS BIGINT) AS found, CAST(4 AS BIGINT) AS expected, r_regionkey % 2 = 0 AS complete FROM region")
def _(spark, sf_dir):
    names = load(spark, sf_dir, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).filter("i < 4 - r_regionkey % 2")
    return readers.shard_check(names.select(F.format_string("split%d-%05d-of-00004.parquet", "r_regionkey", "i").alias("name")))


@query("scan_options", "SELECT CASE n_regionkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'pole.' || n_name ELSE n_name END AS category, unnest(['a' || n_nationkey, 'b']) AS option FROM nation")
def _(spark, sf_dir):
    """One file a region, in the three shapes that there are: a map of lists, a list, a map of maps of lists; keys with a leading underscore go."""
    path = writers.scratch(spark, "options")
    listed = F.array(F.concat(F.lit("a"), "n_nationkey"), F.lit("b"))
    r = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", listed))).alias("m"), F.flatten(F.collect_list(listed)).alias("l"))
    note = F.create_map(F.lit("_note"), F.array(F.lit("dropped")))
    spec = F.when(F.col("n_regionkey") % 3 == 1, F.to_json("l")).when(F.col("n_regionkey") % 3 == 2, F.to_json(F.create_map(F.lit("pole"), F.map_concat(note, "m")))).otherwise(F.to_json(F.map_concat(note, "m")))
    r.select(spec.alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return readers.scan_options(spark, f"{path}/n_regionkey=*").select("category", "option")


@query("merge_options", "SELECT r_name AS category, string_agg(n_name, ',' ORDER BY n_name) AS options FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, sf_dir):
    named = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return readers.merge_options(named.select(F.col("r_name").alias("category"), F.col("n_name").alias("option"))).select("category", F.array_join("options", ",").alias("options"))


@query("scan_tree_by_key", oracle("SELECT record_id AS id, arg_max(pos, pos) AS pos, 'train' AS split FROM attempts WHERE pos % 3 <> 0 GROUP BY record_id"))
def _(spark, sf_dir):
    path = writers.scratch(spark, "tree")
    log = derived(spark, sf_dir, "attempts").selectExpr("record_id AS id", "pos", "CASE WHEN pos % 3 = 0 THEN 'test' ELSE 'train' END AS split", "lpad(cast(pos div 1000 as string), 8, '0') AS day")
    log.repartitionByRange("pos").sortWithinPartitions("pos").write.partitionBy("day").json(path)
    return readers.scan_tree_by_key(spark, path, "id long, pos long, split string", "id", "pos")




@query("dataset_adapter", "SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'Solve ' || o_orderkey AS prompt, 2 AS n_tests FROM orders")
def _(spark, sf_dir):
    raw = load(spark, sf_dir, "orders").selectExpr("cast(null as string) hash_id", "cast(o_orderkey as string) id", "cast(null as string) problem_id", "concat('Solve ', o_orderkey) prompt", "cast(null as array<struct<content:string>>) messages", "array('1', '2') inputs", "array('3', '4') outputs")
    return readers.adapt("coding", raw).select("record_id", "prompt", F.size("tests").alias("n_tests"))


@query("adapt_nemotron", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'h' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'p' || o_orderkey ELSE sha256('Be brief.' || chr(10) || 'Solve ' || o_orderkey) END AS record_id, CASE WHEN o_orderkey % 3 = 2 THEN 'Be brief.' || chr(10) || 'Solve ' || o_orderkey ELSE 'Solve ' || o_orderkey END AS prompt, 2 AS n_tests FROM orders")
def _(spark, sf_dir):
    raw = load(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('h', o_orderkey) END hash_id", "cast(null as string) id", "CASE WHEN o_orderkey % 3 = 1 THEN concat('p', o_orderkey) END problem_id", "CASE WHEN o_orderkey % 3 <> 2 THEN concat('Solve ', o_orderkey) END prompt",
        "array(named_struct('content', 'Be brief.'), named_struct('content', concat('Solve ', o_orderkey))) messages", "array('1', '2', '5') inputs", "array('3', '4', '6') outputs",
    )
    return readers.adapt_coding(raw, 2).select("record_id", "prompt", F.size("tests").alias("n_tests"))


@query("flatten_outputs", "SELECT o_orderkey || '#' || i AS item, 't' || i AS text FROM orders, generate_series(0, 1) g(i) WHERE o_orderkey % 2 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'one' FROM orders WHERE o_orderkey % 2 = 1")
def _(spark, sf_dir):
    return readers.flatten_outputs(load(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) id", "CASE WHEN o_orderkey % 2 = 0 THEN array('t0', 't1') END outputs", "CASE WHEN o_orderkey % 2 = 1 THEN 'one' END output"))


@query("json_str_column", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    return readers.json_str_column(load(spark, sf_dir, "events").select("event_id", F.array("props", F.lit('{"k": tor')).alias("meta")), "meta", "k long")


@query("sink_jsonl", _DOC_SQL)
def _(spark, sf_dir):
    path = writers.scratch(spark, "sink-jsonl")
    writers.sink_jsonl(_docs(spark, sf_dir), path)
    return spark.read.schema(_DOC).json(path)


@query("sink_csv", oracle("SELECT problem, n, CAST(c AS BIGINT) AS c FROM graded"))
def _(spark, sf_dir):
    path = writers.scratch(spark, "sink-csv")
    writers.sink_csv(derived(spark, sf_dir, "graded").select("problem", "n", "c"), path)
    return spark.read.schema("problem long, n long, c long").option("header", True).csv(path)


@query("sink_atomic", _DOC_SQL)
def _(spark, sf_dir):
    path = writers.scratch(spark, "sink-atomic")
    writers.sink_atomic(_docs(spark, sf_dir).withColumn("n_chars", F.lit(-1).cast("bigint")), path)
    writers.sink_atomic(_docs(spark, sf_dir), path)
    return writers.read_atomic(spark, path)


@query("sink_freeze", _DOC_SQL)
def _(spark, sf_dir):
    path = writers.scratch(spark, "sink-freeze")
    writers.sink_freeze(_docs(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("sink_append_durable", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY doc_id")
def _(spark, sf_dir):
    path = writers.scratch(spark, "sink-append")
    writers.sink_append(_docs(spark, sf_dir), path)
    writers.sink_append(_docs(spark, sf_dir).filter("lang = 'en'"), path)
    return spark.read.schema(_DOC).json(path).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("manifest", "SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts, '42' AS seed FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def _(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    files = writers.file_digests(spark, f"{sf_dir}/region.parquet")
    m = writers.manifest(counts, "lang", "n", files, seed=42)
    return m.select(F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("counts"), "seed")


@query("hash_pin", "SELECT n_regionkey AS region, sha256(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS sha256, true AS pinned FROM nation GROUP BY n_regionkey")
def _(spark, sf_dir):
    """One text file a region; its digest must be the one that its lines have."""
    path = writers.scratch(spark, "pins")
    names = load(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    names.repartition(1).sortWithinPartitions("n_regionkey", "n_name").select(F.col("n_name").alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(path)
    lines = names.groupBy("n_regionkey").agg(F.concat(F.array_join(F.array_sort(F.collect_list("n_name")), "\n"), F.lit("\n")).alias("text"))
    expected = {r["n_regionkey"]: r["sha"] for r in lines.select("n_regionkey", F.sha2("text", 256).alias("sha")).collect()}  # one row a region
    for region, sha in expected.items():
        (file,) = [r["file"] for r in writers.file_digests(spark, f"{path}/n_regionkey={region}").collect()]
        writers.hash_pin(spark, f"{path}/n_regionkey={region}", {file: sha})
    return lines.select(F.col("n_regionkey").alias("region"), F.sha2("text", 256).alias("sha256"), F.lit(True).alias("pinned"))
