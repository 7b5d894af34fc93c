"""Best-fit packing planned over a histogram of lengths; pieces then take planned slots by rank within length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import resting, staged
from .tokens import word_encoder

CAPACITY = 2048
END = 0
#: Buckets of documents; ranks within a length are prefix sums over these, then ranks within a bucket.
BUCKETS = 1024


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, last rank + 1, first sequence, offset) for every slot range.

    Sequences with the same contents are one group, filled together: each length, from the longest, goes to the groups
    with the least room that holds it. A group is split where the pieces run out. The number of steps depends on the
    number of lengths and groups, not of pieces.
    """
    rooms: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)
    out: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def put(room: int, group: tuple[int, int]) -> None:
        if room <= 0 or not group[1]:
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append(group)

    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not from 1 to {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                used = min(n, left)
                put(room, (first + used, n - used))
                out.append((length, rank, rank + used, first, capacity - room))
                put(room - length, (first, used))
                left, rank = left - used, rank + used
                continue
            # none has room: open sequences, each with as many of this length as fit
            each = capacity // length
            n, odd = divmod(left, each)
            for k, many in ((each, n), (odd, 1 if odd else 0)):
                for i in range(k if many else 0):
                    out.append((length, rank, rank + many, fresh, i * length))
                    rank += many
                put(capacity - k * length, (fresh, many))
                fresh += many
            left = 0
    return out


def _pieces(capacity: int, path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(t.as_py() or "" for t in batch.column(1)), strict=True):
                ids += END.to_bytes(4, "little")
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    for column, x in zip(rows, (doc, i, at // 4, len(part) // 4, crc32(part), part if keep_ids else None), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): documents as token ids and an end id, cut at ``capacity``."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(resting(_pieces(capacity, tokenizer, keep_ids), "tokens"), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept).

    Null and empty texts are one end id. Rows with equal or no doc_id are packed each. No rows give no rows. The plan
    goes to executors as a table of slot ranges, whose number is bounded by lengths and groups, not by documents.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, capacity, keep_ids)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(BUCKETS)).cast("int"))
    cut = staged(cut if keep_ids else cut.drop("ids"), "pieces")
    counts = staged(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "histogram")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    slots = plan(histogram, capacity)
    ranges = np.array(slots, dtype=np.int64).reshape(-1, 5)
    schema = "length long, low long, high long, first_sequence long, offset long"
    ranges = spark.createDataFrame(pa.table({k.split()[0]: ranges[:, i] for i, k in enumerate(schema.split(", "))}).to_pandas(), schema)
    # of each length, the ranges that meet a bucket's ranks
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = staged(counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))), "begin")
    ranges = staged(ranges, "slots")
    met = begin.join(ranges, "length").where("low < before + n and high > before")
    met = staged(met.groupBy("length", "bucket").agg(F.first("before").alias("before"), F.collect_list(F.struct("low", "high", "first_sequence", "offset")).alias("ranges")), "met")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(met, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("slot", F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0])
    last = ["ids"] if keep_ids else []
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.low")).alias("sequence_id"), F.col("slot.offset").alias("offset"), *last)
