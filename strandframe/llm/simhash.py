"""SimHash near-dedup: pivot distance tables over fingerprints, exact components at 2 or fewer differing bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, hamming, release, resting, staged

#: Widths of the five blocks of a fingerprint. Two differing bits touch two blocks at most, so three agree.
BLOCKS = (13, 13, 13, 13, 12)
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Buckets of more fingerprints than this go through midpoints, not pairs.
PAIR_LIMIT = 32
SHINGLE = 3
SEED = 42


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: XXH64 of their numbers, so every run and executor has the same."""
    return [signed(xxhash.xxh64_intdigest(f"pivot {i}", 7)) for i in range(n)]


def masks() -> list[int]:
    """The bits of every three of the five blocks."""
    starts = np.cumsum([0, *BLOCKS])
    block = [((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, starts, strict=False)]
    return [signed(a | b | c) for a, b, c in combinations(block, 3)]


def fingerprint(data: bytes) -> int:
    """The fingerprint of a text's UTF-8 bytes: a bit is set if it is in over half of the shingle hashes."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1:].tolist(), strict=True)), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        values = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def _set_bits(mask: int) -> list[int]:
    return [signed(1 << i) for i in range(64) if (mask >> i) & 1]


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) of class ids that connect all fingerprints at 2 or fewer differing bits.

    classes: (fp, rep), one row per distinct fingerprint. Blocks that must agree give the buckets. In buckets of up
    to PAIR_LIMIT fingerprints, pairs whose distances to any pivot differ by over 2 are discarded (triangle
    inequality) and the survivors verified. Larger buckets link through midpoints: fingerprints at distance 2 or less
    share one that differs from each in at most one bit, and all that share one are at distance 2 or less; this takes
    rows in proportion to the bucket, not to its square, and loses no connection.
    """
    refs = pivots()
    table = classes.select("fp", "rep", *[hamming(F.col("fp"), F.lit(p)).cast("byte").alias(f"p{i}") for i, p in enumerate(refs)])
    table = staged(table, "pivots")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("kid"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks())])).alias("k")
    keyed = table.select(keys, "*").select("k.*", "fp", "rep", *[f"p{i}" for i in range(PIVOTS)])
    full = staged(keyed.select("kid", "key").groupBy("kid", "key").count().where("count > 1"), "buckets")
    n = full.agg(F.sum("count")).first()[0] or 0
    near = staged(keyed.join(full, ["kid", "key"]), "members", n)
    small = near.where(F.col("count") <= PAIR_LIMIT)
    a, b = small.alias("a"), small.alias("b")
    apart = F.greatest(*[F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) for i in range(PIVOTS)])
    pairs = a.join(b, (F.col("a.kid") == F.col("b.kid")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
                   & (apart <= 2) & (hamming(F.col("a.fp"), F.col("b.fp")) <= 2)).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    large = near.where(F.col("count") > PAIR_LIMIT).select("kid", "key", "fp", "rep")
    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(x) for x in _set_bits(~m)]) for m in masks()])
    points = staged(large.select("kid", "key", "rep", F.explode(F.element_at(free, F.col("kid") + 1)).alias("bit"), "fp")
                    .select("kid", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"), "rep"), "midpoints", 28 * n)
    least = staged(points.groupBy("kid", "z").agg(F.min("rep").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n"), "least", n)
    through = points.join(least, ["kid", "z"]).where("rep <> m").select(F.col("m").alias("a"), F.col("rep").alias("b"))
    return pairs.union(through)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each whole text; null texts count as empty."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(resting(_fingerprints), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Null texts count as empty (fingerprint zero, linked like any other). Equal rows are each returned. A row without
    id takes part, but never names a component; a component without any id has none. No rows give no rows. Columns
    other than the two named are ignored.
    """
    spark = docs.sparkSession
    each = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = staged(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    edges = staged(links(classes.where("rep is not null")), "links")
    release(spark)
    found = components(edges)
    named = staged(classes.join(found, F.col("rep") == F.col("node"), "left")
                   .select("fp", F.coalesce("component", "rep").alias("component_id")), "named")
    hexed: Column = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return each.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but the first document (smallest id) of each component.

    Rows without id are kept; of several rows with the kept id, each stays.
    """
    found = near_duplicates(docs)
    drop = staged(found.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct(), "drop")
    return docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti")
