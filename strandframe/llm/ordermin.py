"""Order MinHash fingerprints of whole texts, in DataFrame operations alone.

A text's k-mers are its runs of WORDS_PER_KMER white-space words (the whole text, if it has fewer), each numbered by
its occurrence, so a repeat is another k-mer. For each of SIGNATURES hash functions the numbered k-mers fall into
PER_TUPLE strata by a bit of their hash, and the minimal one of each stratum is selected; the selected k-mers are put
in their order in the text and the tuple is hashed. Two texts have an equal entry if they share the selected k-mers
and their order, which falls with edit distance, not only with shared content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNATURES = 16
PER_TUPLE = 2
WORDS_PER_KMER = 2
#: Low bits of a packed number that hold a k-mer's place in its text; texts have fewer k-mers than this allows.
PLACE_BITS = 24
#: Ranges of doc_id that are dealt out (least and most), and documents in one; a document's successor is in its range
#: or is copied to it.
RANGES, MOST_RANGES, RANGE_ROWS = 512, 65_536, 20_000


def _pack(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(place.cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def kmers(text: Column) -> Column:
    """Array of one number per k-mer of the text: its hash (high bits) and place (low bits)."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    hashed = F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: F.when(
        F.size(h) < WORDS_PER_KMER, F.array(_pack(F.xxhash64(h), F.lit(0)))
    ).otherwise(F.transform(
        F.slice(h, F.lit(1), F.size(h) - F.lit(WORDS_PER_KMER - 1)),
        lambda x, i: _pack(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WORDS_PER_KMER)]), i))))


def _runs(packed: Column) -> Column:
    """Array of arrays: the sorted numbers, split where the hash changes."""
    def high(x: Column) -> Column:
        return F.shiftright(x, PLACE_BITS)

    def split(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (high(F.get(s, j)) != high(F.get(s, j - 1))))
        return _let(begins, lambda b: F.transform(b, lambda at, r: F.slice(s, at + 1, F.coalesce(F.get(b, r + 1), F.size(s)) - at)))

    return _let(packed, split)


def signatures(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, signature array<long>) from ``texts (*keys, text)``, one row per key; texts are not null.

    k-mers sorted by hash and place fall into runs of equal hash, which give the occurrence numbers; the generated
    rows go into plain minima per text. Partial aggregation leaves one row per text before the shuffle.
    """
    low = F.lit((1 << PLACE_BITS) - 1)
    runs = texts.select(*keys, F.explode(_runs(F.sort_array(kmers(F.col("text"))))).alias("run"))
    rows = runs.select(*keys, F.posexplode("run").alias("occurrence", "x"))
    rows = rows.select(*keys, F.xxhash64(F.shiftright("x", PLACE_BITS), F.col("occurrence")).alias("h"), F.col("x").bitwiseAND(low).alias("place"))
    minima = []
    for i in range(SIGNATURES):
        value = F.xxhash64(F.lit(i), F.col("h")).bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(F.col("place"))
        stratum = F.shiftrightunsigned(F.col("h"), 2 * i).bitwiseAND(F.lit(PER_TUPLE - 1))
        minima += [F.min(F.when(stratum == j, value)).alias(f"m{i}_{j}") for j in range(PER_TUPLE)]
    found = rows.groupBy(*keys).agg(*minima)
    entries = []
    for i in range(SIGNATURES):
        picked = F.array(*[F.struct(F.col(f"m{i}_{j}").bitwiseAND(low).alias("p"), F.shiftright(f"m{i}_{j}", PLACE_BITS).alias("v")) for j in range(PER_TUPLE)])
        entries.append(F.xxhash64(F.transform(F.sort_array(F.filter(picked, lambda x: x["v"].isNotNull())), lambda x: x["v"])))
    return found.select(*keys, F.array(*entries).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.lit(float(SIGNATURES))


def text_of(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(range, at, doc_id, text, next_text): documents by ascending doc_id, with the next one's text; how many ranges.

    Rows without id come first; equal ids are in order of text; after the last comes the first. Texts are shuffled
    once: documents are dealt by ranges of doc_id (bounded quantiles), and the first of each range is also sent to the
    range before.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    picked = picked.withColumn("k", F.coalesce("doc_id", F.lit(least)))
    ranges = min(MOST_RANGES, max(RANGES, docs.count() // RANGE_ROWS))
    marks = [i / ranges for i in range(1, ranges)]
    found = picked.agg(F.min("k").alias("low"), F.percentile_approx("k", marks, 10 * ranges).alias("marks")).first()
    if found["low"] is None:
        return spark.createDataFrame([], "range int, at int, doc_id long, text string, next_text string"), 0
    firsts = sorted({found["low"], *found["marks"]})  # the first key of each range
    # ranges in two levels, so that a document's is found among few numbers
    width = max(1, int(len(firsts) ** 0.5))
    rows = [firsts[i: i + width] for i in range(0, len(firsts), width)]
    heads = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("k")))
    picked = picked.withColumn("row", upto(heads)).withColumn("row_marks", F.element_at(table, F.col("row")))
    picked = picked.withColumn("range", (F.col("row") - 1) * width + upto(F.col("row_marks")) - 1)
    first = F.array_contains("row_marks", F.col("k"))
    before = F.pmod(F.col("range") - 1, F.lit(len(firsts)))
    sent = F.when(first, F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost")), F.struct(before.alias("range"), F.lit(1).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost"))))
    dealt = picked.select(F.explode(sent).alias("to"), "k", "doc_id", "text").select("to.*", "k", "doc_id", "text")
    order = Window.partitionBy("range").orderBy("ghost", "k", "text")
    seen = dealt.select("range", "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("at"))
    return seen.where("ghost = 0").select("range", "at", "doc_id", "text", "next_text"), len(firsts)


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter (code points, rounded down) replaced by the first as many of ``following``."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty. Rows without id come first in the order; equal rows are each returned. A single document
    is its own next. No rows give no rows. Texts without words are all alike.
    """
    base, ranges = with_next(docs)
    base = base.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    base = base.select("range", "at", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       F.posexplode(F.array("text", "edited")).alias("which", "text"))
    found = signatures(base, ["range", "at", "which", "doc_id", "n_chars", "edited_sha256"])
    # a document's row is followed by its edited text's and by the next document's; each range's first is copied to the one before
    copy = F.when((F.col("at") == 1) & (F.col("which") == 0), F.array(F.struct("range", "at"), F.struct(F.pmod(F.col("range") - 1, F.lit(max(1, ranges))).alias("range"), F.lit((1 << 31) - 1).alias("at"))))
    found = found.withColumn("to", F.explode(F.coalesce(copy, F.array(F.struct("range", "at"))))).drop("range", "at").select("to.*", "*")
    order = Window.partitionBy("range").orderBy("at", "which")
    seen = found.select("*", F.lead("signature", 1).over(order).alias("edited_signature"), F.lead("signature", 2).over(order).alias("next_signature"))
    return seen.where(f"which = 0 and at < {(1 << 31) - 1}").select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("signature")).alias("fingerprint"), text_of(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
