"""WARC archives and a merged capture index.

Writing: every page becomes a WARC/1.1 record.  Of pages with equal payloads (SHA-1) the one with the smallest page_id is a response, the others are
revisits that refer to it.  A payload that a large share of all pages has never meets in one task (join_hot).  Each record is a gzip member of its own, so places in
the index can be sought; Spark's own writer puts the members into archives, so its commit protocol keeps lost executors from leaving halves.
An archive holds at most `RECORDS_PER_FILE` records of a partition, and partitions hold about `PARTITION` bytes of payload.
Reading: archives are parsed where they lie, member by member; each file gives capture runs sorted by URL key, timestamp and page_id, which are written beside them.
Index merge: runs are dealt out by ranges of (URL key, timestamp, page_id, file, offset), about `RANGE` entries each however many there are, so that one site or one URL
never has to fit one task.  A range holds its entries as Arrow columns, cuts them where the order breaks, which gives back the pieces of runs, and merges these with
a loser tree; nothing is sorted again.  The result, in partition order, is the globally ordered capture history.

Defined cases: null payload is empty, null url makes a record without a target and an empty URL key; control characters of a url are percent-coded;
a null page_id counts as larger than any other and is written as "null"; rows that repeat page_id and payload are responses each if that id is the smallest;
columns beyond page_id, url, html and the optional timestamp column are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, new_path, small_slices, staged, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z, of records without a timestamp column
RECORDS_PER_FILE = 2000
PARTITION, RANGE = 64 << 20, 200_000
NO_ID = (1 << 63) - 1


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them make four letters."""
    out = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(value, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(4)]
    return F.concat(*out)


def records(pages: DataFrame, timestamp: str | None = None, min_bytes: int = 0) -> DataFrame:
    """(record) of every page: WARC headers, block and the two line ends that close a record."""
    when = F.col(timestamp) if timestamp else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1_000_000_000)))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")
    ).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    least = rows.select("sha", F.coalesce("page_id", F.lit(NO_ID)).alias("id")).groupBy("sha").agg(F.min("id").alias("least"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes")).first()
    joined = join_hot(rows, least, "sha", size["n"], max(1, -(-size["bytes"] // PARTITION)))
    revisit = (F.octet_length("payload") >= min_bytes) & (F.coalesce("page_id", F.lit(NO_ID)) != F.col("least"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1f]", "%00")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("payload").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.col("date")),
        F.coalesce(line("WARC-Target-URI", clean), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("least"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(head, block, F.lit("\r\n\r\n")).alias("record"))


def member(record: bytes) -> bytes:
    """A gzip member of a record; it is closed by a zero byte (the highest of a length below 16 MB), for longer records by an empty member after it."""

    def packed(x: bytes) -> bytes:
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        return deflate.compress(x) + deflate.flush()

    one = packed(record)
    return one if one[-1] == 0 else one + packed(b"")


def member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records to members without their last byte, which the writer puts between them as its line end."""
    for batch in small_slices(batches, "record", 16 << 20):
        out = [member(x.as_buffer())[:-1] for x in batch.column("record")]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, **options: Any) -> None:
    """Archives of gzip members below a path.  The text writer writes the bytes of a string as they are, and every member ends with its line end, a zero byte."""
    members = records(pages, **options).mapInArrow(member_rows, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def open_members(data: Any, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the members of an archive that hold anything."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, out, to = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if to >= len(view):
                raise ValueError(f"the member at offset {at} doesn't end")
            out.append(inflate.decompress(view[to : to + chunk]))
            to += len(view[to : to + chunk])
        to -= len(inflate.unused_data)
        if content := b"".join(out):
            yield at, to - at, content
        at = to


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, then path and query, in lower case; the scheme, a leading www and the fragment go."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], memoryview]:
    """(headers, block) of the one record that a member holds; `at` names it in errors."""
    stop = data.find(b"\r\n\r\n")
    lines = data[: max(stop, 0)].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    end = stop + 4 + int(headers["content-length"])
    if data[end:] != b"\r\n\r\n":
        raise ValueError(f"the record at offset {at} doesn't end where its length says")
    return headers, memoryview(data)[stop + 4 : end]


def _id(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() and int(text) != NO_ID else None


def capture(headers: dict[str, str], block: memoryview) -> dict[str, Any]:
    """One index entry; the digest of a response is that of the payload read, a revisit has the one it was written with."""
    raw = bytes(block)
    head, _, payload = raw.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if headers["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"payload digest of {headers['warc-record-id']} doesn't fit")
    else:
        http = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
        size, digest = int(http["Content-Length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    url = headers.get("warc-target-uri")
    return {"urlkey": url_key(url), "timestamp": headers["warc-date"], "page_id": _id(headers["warc-record-id"]), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _id(headers.get("warc-refers-to"))}


ENTRY = "urlkey string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
_ENTRY = pa.schema([(k, pa.int64() if t == "long" else pa.string()) for k, t in (x.split() for x in ENTRY.split(", "))])


def order_of(entry: dict[str, Any]) -> tuple:
    return entry["urlkey"], entry["timestamp"], NO_ID if entry["page_id"] is None else entry["page_id"], entry["file"], entry["offset"]


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to runs: the entries of a file, sorted, with the file as the run's name and the place of the member."""
    for batch in batches:
        for k in range(batch.num_rows):
            name = batch.column("path")[k].as_py().rpartition("/")[2]
            entries = sorted(({**capture(*parse_record(x, at)), "file": name, "offset": at, "length": n} for at, n, x in open_members(batch.column("content")[k].as_buffer())), key=order_of)
            yield pa.RecordBatch.from_pylist(entries, schema=_ENTRY)


class LoserTree:
    """K-way merge: inner nodes hold the loser of their match, the overall winner stands at the top."""

    def __init__(self, runs: list[Iterable[Any]], key: Callable[[Any], Any]):
        self.sources = [iter(r) for r in runs]
        self.key = key
        self.k = max(1, len(self.sources))
        self.heads = [self._next(i) for i in range(len(self.sources))] or [None]
        self.losers = [-1] * self.k
        winners = [0] * (2 * self.k)
        for leaf in range(self.k):
            winners[self.k + leaf] = leaf
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def _next(self, i: int) -> tuple[Any, Any] | None:
        for x in self.sources[i]:
            return self.key(x), x
        return None

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self) -> Iterator[Any]:
        while self.heads[self.top] is not None:
            winner = self.top
            yield self.heads[winner][1]
            self.heads[winner] = self._next(winner)
            node = (winner + self.k) // 2
            while node:
                if self._before(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.top = winner


def merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its pieces of runs, wherever the order of its entries breaks, merged."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    ids = rows.column("page_id").fill_null(NO_ID)
    keys = list(zip(*(c.to_pylist() for c in (rows.column("urlkey"), rows.column("timestamp"), ids, rows.column("file"), rows.column("offset"))), strict=True))
    cuts = [0, *(k for k in range(1, len(keys)) if keys[k] < keys[k - 1]), len(keys)]
    order = np.fromiter(LoserTree([range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], keys.__getitem__), np.int64, len(keys))
    for at in range(0, len(order), 8192):
        yield from rows.take(pa.array(order[at : at + 8192])).combine_chunks().to_batches()


def capture_history(spark, path: str) -> DataFrame:
    """The merged index of all archives under a path, in order of partitions."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = staged(archives.mapInArrow(run_rows, ENTRY), "capture-runs")
    ranges = max(1, -(-runs.count() // RANGE))
    dealt = runs.repartitionByRange(ranges, "urlkey", "timestamp", F.coalesce("page_id", F.lit(NO_ID)), "file", "offset")
    return dealt.mapInArrow(merge_rows, ENTRY)


def op6(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return capture_history(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), v AS (
  SELECT page_id, body, h, min(page_id) OVER (PARTITION BY h) AS least,
    list_transform(range(0, 8), lambda k: list_sum(list_transform(range(0, 5), lambda j: CAST(strpos('0123456789abcdef', substr(h, CAST(5 * k + j + 1 AS BIGINT), 1)) - 1 AS BIGINT) * (1 << CAST(4 * (4 - j) AS BIGINT))))) AS g
  FROM p
)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(g[i // 4 + 1] AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM v
"""
