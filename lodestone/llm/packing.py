"""Best-fit packing planned over a length histogram.

Documents become token ids plus the end id 0; longer ones than a sequence are cut into full pieces, the first of which may be shorter.
The driver sees counts by length only (at most `size` numbers) and runs best-fit decreasing over groups of equal bins.
The plan is a short table of slots (length, ranks, sequences, offset); pieces take their slots by a join on rank within length.
Ranks come from counts by (length, salt) and row numbers inside each, so one frequent length is spread over many tasks.

Token ids are those of the `tokenizers` file with add_special_tokens=False.  Its byte-level vocabulary is also at hand as ranks, which
give the same ids faster; a text with the string of a special token, or with white space beyond ASCII, goes through `tokenizers` itself.

Defined cases: null text is empty, and an empty text is the single id 0; repeated rows are packed each; pieces with equal ids are
interchangeable; columns beyond doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_slices, staged, table

SIZE = 2048
END_ID = 0
RANK_GROUP = 200_000
WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to their ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(json_path)
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def ids(self, text: str) -> bytes:
        if WIDE_SPACE.search(text) or (self.special and self.special.search(text)):
            found = self.whole.encode(text, add_special_tokens=False).ids
        else:
            found = self.core(text)
        return np.array(found, dtype="<u4").tobytes()


_ENCODERS: dict[tuple[str | None, str | None], Encoder] = {}


def encoder(json_path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """One encoder to a Python worker, which looks for the files where it runs."""
    if (json_path, ranks_path) not in _ENCODERS:
        _ENCODERS[json_path, ranks_path] = Encoder(json_path or tokenizer_path(), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"))
    return _ENCODERS[json_path, ranks_path]


def piece_rows(batches: Iterator[pa.RecordBatch], json_path: str | None, ranks_path: str | None, size: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(json_path, ranks_path)
    end = np.array([END_ID], dtype="<u4").tobytes()
    for batch in small_slices(batches, "text", 16 << 20):
        rows, ids = [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            whole = enc.ids(text or "") + end
            n = len(whole) // 4
            first = n % size or size
            edges = [0, *range(first, n + 1, size)]
            for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                part = whole[4 * a : 4 * b]
                rows.append((k, piece, a, b - a, zlib.crc32(part)))
                if keep_ids:
                    ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
        cols = np.array(rows, dtype=np.int64).reshape(-1, 5)
        out = [batch.column("doc_id").take(pa.array(cols[:, 0])), pa.array(cols[:, 1].astype(np.int32)), *(pa.array(cols[:, i]) for i in (2, 3, 4))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.list_(pa.int32()))] if keep_ids else out, names=[*names, "ids"] if keep_ids else names)


def pieces(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every row."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: piece_rows(it, json_path, ranks_path, size, keep_ids), schema)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: slots (length, first rank, ranks, first sequence, offset); rank first+i goes to sequence first+i.

    Bins with equal room stand in groups of neighbouring sequences.  A length goes to the group with the least room that holds it,
    as often as it fits, since the bin it has just entered is then the tightest; without such a group new bins are opened.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # rooms with groups, ascending
    slots, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, n = size, opened, max(1, left // (size // length))
                opened += n
            times = min(room // length, left)
            used = min(n, max(1, left // times))
            for j in range(times):
                slots.append((length, rank + j * used, used, first, size - room + j * length))
            rank += times * used
            left -= times * used
            put(room, first + used, n - used)
            put(room - times * length, first, used)
    return slots


def pack(piece_table: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces; every sequence is filled from 0 without gaps, up to `size`."""
    spark = piece_table.sparkSession
    hist = piece_table.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `size` rows
    total = sum(r["n"] for r in hist)
    salts = int(np.clip(total // RANK_GROUP, 16, 4096))
    slots = spark.createDataFrame(plan({r["length"]: r["n"] for r in hist}, size), "slot_length long, first long, n long, sequence long, offset long")
    salted = piece_table.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(shift, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    on = (F.col("length") == F.col("slot_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("n"))
    placed = ranked.join(F.broadcast(slots), on)  # the plan follows the lengths (2,048 at most), not the rows
    return placed.select(*piece_table.columns, (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, size: int = SIZE, keep_ids: bool = False, **paths) -> DataFrame:
    return pack(staged(pieces(docs, size=size, keep_ids=keep_ids, **paths), "pieces"), size)


def op10(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
