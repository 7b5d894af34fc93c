"""Read quality control: each module is a DataFrame of reads (read_id, seq, qual, ...) to a small DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Adapters by name, and warn and fail limits of the modules.
ADAPTERS = {
    "Illumina Universal Adapter": "AGATCGGAAGAG",
    "Illumina Small RNA 3' Adapter": "TGGAATTCTCGG",
    "Illumina Small RNA 5' Adapter": "GATCGTCGGACT",
    "Nextera Transposase Sequence": "CTGTCTCTTATA",
    "PolyA": "AAAAAAAAAAAA",
    "PolyG": "GGGGGGGGGGGG",
}
LIMITS = {"n_content": (5.0, 20.0), "sequence": (10.0, 20.0), "duplication": (70.0, 50.0), "overrepresented": (0.1, 1.0), "tile": (5.0, 10.0), "quality_sequence": (27.0, 20.0),
          "adapter": (5.0, 10.0), "kmer": (2.0, 5.0), "gc_sequence": (15.0, 30.0)}


def count_of(seq: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(seq, f"[^{letters}]", ""))


def per_position(reads: DataFrame) -> DataFrame:
    """(pos, base, q, n): counts over all reads; partial counts per task go to the shuffle, not bases."""
    split = reads.select(F.posexplode(F.split("seq", "")).alias("i", "base"), "qual", "seq")
    split = split.select((F.col("i") + 1).alias("pos"), "base", (F.ascii(F.substring("qual", F.col("i") + 1, F.lit(1))) - 33).alias("q")).where("base <> ''")
    return split.groupBy("pos", "base", "q").agg(F.count("*").alias("n"))


def basic(reads: DataFrame) -> DataFrame:
    acgt = F.sum(count_of(F.col("seq"), "ACGT"))
    return reads.agg(F.count("*").alias("total"), F.sum(F.length("seq")).cast("long").alias("bases"), F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"),
                     F.min(F.array_min(F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c)))).alias("lowest"),
                     F.floor(F.sum(count_of(F.col("seq"), "GC")) * 100 / acgt).cast("long").alias("gc"))


def base_quality(reads: DataFrame, least: int = 100) -> DataFrame:
    """(pos, total, mean, p10, p25, median, p75, p90): smallest quality whose cumulative count is the percentile's share; null up to ``least`` reads."""
    h = per_position(reads).groupBy("pos", "q").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("pos").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("cum", F.sum("n").over(up)).withColumn("tot", F.sum("n").over(Window.partitionBy("pos")))
    at = lambda p: F.when(F.max("tot") > least, F.min(F.when(F.col("cum") >= F.floor(F.col("tot") * p / 100), F.col("q"))))
    return h.groupBy("pos").agg(F.max("tot").cast("long").alias("total"), (F.sum(F.col("q") * F.col("n")).cast("double") / F.sum("n")).alias("mean"),
                                *[at(p).alias(n) for p, n in ((10, "p10"), (25, "p25"), (50, "median"), (75, "p75"), (90, "p90"))])


def tile_of(header: Column) -> Column:
    """Tile of a header: field 5 of 7 or more, field 3 of 5 or more; null otherwise."""
    f = F.split(header, ":")
    return F.when(F.size(f) >= 7, f[4]).when(F.size(f) >= 5, f[2]).try_cast("int")


def tile_quality(reads: DataFrame) -> DataFrame:
    """(tile, pos, deviation): a tile's mean quality less the mean over tiles; the first 10,000 reads and every 10th after."""
    sampled = reads.where("read_id < 10000 or read_id % 10 = 0").withColumn("tile", tile_of(F.col("header"))).where("tile is not null")
    rows = sampled.select("tile", F.posexplode(F.split("qual", "")).alias("i", "c")).where("c <> ''")
    means = rows.groupBy("tile", (F.col("i") + 1).alias("pos")).agg(F.avg(F.ascii("c").cast("double") - 33).alias("mean"))
    return means.select("tile", "pos", F.round(F.col("mean") - F.avg("mean").over(Window.partitionBy("pos")), 6).alias("deviation"))


def sequence_quality(reads: DataFrame) -> DataFrame:
    """(quality, n): reads by mean quality, divided as integers."""
    total = F.aggregate(F.filter(F.split("qual", ""), lambda c: c != ""), F.lit(0), lambda s, c: s + F.ascii(c))
    return reads.where("length(qual) > 0").select((F.floor(total / F.length("qual")) - 33).cast("int").alias("quality")).groupBy("quality").agg(F.count("*").alias("n"))


def base_content(reads: DataFrame) -> DataFrame:
    """(pos, g, a, t, c): per cent of each base among A, C, G, T."""
    h = per_position(reads)
    known = F.sum(F.when(F.col("base").isin("A", "C", "G", "T"), F.col("n")))
    return h.groupBy("pos").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("base") == b.upper(), F.col("n"))), F.lit(0)) * 100.0 / known, 6).alias(b) for b in "gatc"])


def n_content(reads: DataFrame) -> DataFrame:
    return per_position(reads).groupBy("pos").agg(F.round(F.coalesce(F.sum(F.when(~F.col("base").isin("A", "C", "G", "T"), F.col("n"))), F.lit(0)) * 100.0 / F.sum("n"), 6).alias("n_percent"))


def gc_model(spark: SparkSession, lengths: DataFrame) -> DataFrame:
    """(len, gc, pct, weight): how a read of ``len`` bases with ``gc`` of them G or C is spread over percentages."""
    cells = lengths.select("len", F.explode(F.sequence(F.lit(0), F.col("len"))).alias("gc"))
    pct = lambda x: F.floor(x * 100 / F.col("len") + 0.5).cast("int")
    cells = cells.withColumn("low", pct(F.greatest(F.col("gc") - 0.5, F.lit(0.0)))).withColumn("high", pct(F.least(F.col("gc") + 0.5, F.col("len").cast("double"))))
    rows = cells.select("len", "gc", F.explode(F.sequence("low", "high")).alias("pct"))
    return rows.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("len", "pct")))


def gc_content(reads: DataFrame) -> DataFrame:
    """(pct, n): reads by per cent of G and C. Reads of over 100 (1000) bases are cut to a multiple of 100 (1000)."""
    n = F.length("seq")
    cut = F.when(n > 1000, F.floor(n / 1000) * 1000).when(n > 100, F.floor(n / 100) * 100).otherwise(n).cast("int")
    h = reads.where("length(seq) > 0").withColumn("s", F.substring("seq", F.lit(1), cut)).select(F.length("s").alias("len"), count_of(F.col("s"), "GC").alias("gc")).groupBy("len", "gc").agg(F.count("*").alias("n"))
    model = gc_model(reads.sparkSession, h.select("len").distinct())
    return h.join(model, ["len", "gc"]).groupBy("pct").agg(F.round(F.sum(F.col("n") * F.col("weight")), 6).alias("n"))


def lengths(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n"))


def sequence_counts(reads: DataFrame, key_length: int = 50) -> DataFrame:
    return reads.groupBy(F.substring("seq", 1, key_length).alias("key")).agg(F.count("*").alias("n"))


def overrepresented(reads: DataFrame, percent: float = 0.1, key_length: int = 50) -> DataFrame:
    """(key, n, percent) of sequences over a share of all reads; all distinct sequences are counted."""
    c = sequence_counts(reads, key_length)
    total = reads.agg(F.count("*").alias("total"))
    return c.crossJoin(F.broadcast(total)).where(F.col("n") * 100.0 / F.col("total") > percent).select("key", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))  # one row


#: Least level of each slot from the tenth on, and its label; before, a level is its own slot.
SLOTS = ((10, ">10"), (51, ">50"), (101, ">100"), (501, ">500"), (1001, ">1k"), (5001, ">5k"), (10001, ">10k"))


def slot(level: Column) -> Column:
    out = level.cast("string")
    for least, label in SLOTS:
        out = F.when(level >= least, label).otherwise(out)
    return out


def duplication(reads: DataFrame, key_length: int = 50) -> DataFrame:
    """(slot, n_sequences, n_reads): distinct sequences and reads by how often a sequence occurs."""
    levels = sequence_counts(reads, key_length).groupBy(F.col("n").alias("level")).agg(F.count("*").alias("k"))
    return levels.groupBy(slot(F.col("level")).alias("slot")).agg(F.sum("k").alias("n_sequences"), F.sum(F.col("k") * F.col("level")).alias("n_reads"))


def adapter_content(reads: DataFrame) -> DataFrame:
    """(adapter, pos, n): reads in which the adapter begins at or before a position."""
    found = None
    for name, seq in ADAPTERS.items():
        hits = reads.select(F.lit(name).alias("adapter"), F.instr("seq", seq).alias("pos")).where("pos > 0").groupBy("adapter", "pos").agg(F.count("*").alias("k"))
        found = hits if found is None else found.union(hits)
    last = reads.agg((F.max(F.length("seq")) - F.lit(max(map(len, ADAPTERS.values())) - 1)).alias("last"))
    grid = last.select(F.explode(F.sequence(F.lit(1), F.greatest("last", F.lit(1)))).alias("pos")).crossJoin(reads.sparkSession.createDataFrame([(a,) for a in ADAPTERS], "adapter string"))
    up = Window.partitionBy("adapter").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(found, ["adapter", "pos"], "left").select("adapter", "pos", F.coalesce(F.sum("k").over(up), F.lit(0)).cast("long").alias("n"))


def kmer_content(reads: DataFrame, k: int = 7, every: int = 50, most: int = 20) -> DataFrame:
    """(kmer, n, obs_exp, at) of k-mers most above expectation at some position, in every 50th read's first 500 bases."""
    sampled = reads.where(F.col("read_id") % every == 0).select(F.substring("seq", 1, 500).alias("seq")).where(F.length("seq") >= k)
    rows = sampled.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substring(F.col("seq"), i, F.lit(k)))).alias("pos", "kmer")).where("not contains(kmer, 'N')")
    counts = rows.groupBy("kmer", "pos").agg(F.count("*").alias("n"))
    total, at = Window.partitionBy("kmer"), Window.partitionBy("pos")
    c = counts.withColumn("of_kmer", F.sum("n").over(total)).withColumn("of_pos", F.sum("n").over(at))
    everything = counts.agg(F.sum("n").alias("everything"))
    c = c.crossJoin(F.broadcast(everything)).withColumn("obs_exp", F.col("n") * F.col("everything") / (F.col("of_kmer") * F.col("of_pos")))  # one row
    best = c.groupBy("kmer").agg(F.max("of_kmer").alias("n"), F.max(F.struct(F.round("obs_exp", 6).alias("x"), (-F.col("pos")).alias("p"))).alias("b"))
    return best.select("kmer", "n", F.col("b.x").alias("obs_exp"), (1 - F.col("b.p")).cast("int").alias("at")).orderBy(F.desc("obs_exp"), "kmer").limit(most)


def bins(length: int, grouped: bool = True, exponential: bool = False) -> list[tuple[int, int]]:
    """Position bins: single up to 75 bases or without grouping; else the first nine single, then a 2, 5, 10 ... interval that leaves under 75,
    or, if exponential, intervals that grow with the position."""
    if not grouped or length <= 75:
        return [(i, i) for i in range(1, length + 1)]
    if exponential:
        out, at, step = [], 1, 1
        while at <= length:
            out.append((at, min(at + step - 1, length)))
            at += step
            # Where an interval grows, for lengths above what, and to what.
            step = {(10, length > 75): 5, (50, length > 200): 10, (100, length > 300): 50, (500, length > 1000): 100, (1000, length > 2000): 500}.get((at, True), step)
        return out
    out = [(i, i) for i in range(1, min(9, length) + 1)]
    step = next(m * 10**e for e in range(12) for m in (2, 5, 10) if 9 + -(-(length - 9) // (m * 10**e)) < 75)
    first = min(length, step - 1 if step > 10 else 9 + step - 9 % step) if step > 10 else 9
    if first > 9:
        out.append((10, first))
    at = max(first, 9) + 1
    while at <= length:
        out.append((at, min(at + step - 1, length)))
        at += step
    return out


def in_bins(positions: DataFrame, longest: DataFrame, exponential: bool = False) -> DataFrame:
    """``positions (pos, ...)`` with the bin (low, high) of each, by the longest read: one row (last)."""
    table = positions.sparkSession.createDataFrame(bins(longest.first()["last"] or 0, exponential=exponential) or [(1, 1)], "low int, high int")  # some hundred rows at most
    return positions.join(F.broadcast(table), F.col("pos").between(F.col("low"), F.col("high")))


def longest_read(reads: DataFrame) -> DataFrame:
    return reads.agg(F.max(F.length("seq")).alias("last"))


def binned_quality(reads: DataFrame, least: int = 100) -> DataFrame:
    """(low, high, mean, median, p10, p25, p75, p90): means over the bin's positions; percentiles only of positions with over ``least`` reads."""
    rows = in_bins(base_quality(reads, least), longest_read(reads))
    return rows.groupBy("low", "high").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("mean", "median", "p10", "p25", "p75", "p90")])


def binned_content(reads: DataFrame) -> DataFrame:
    """(low, high, g, a, t, c, n): per cent of each base among A, C, G, T, and of all others among all, in a bin."""
    h = in_bins(per_position(reads), longest_read(reads))
    known = F.sum(F.when(F.col("base").isin("A", "C", "G", "T"), F.col("n")))
    share = lambda of, whole: F.round(F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)) * 100.0 / whole, 6)
    return h.groupBy("low", "high").agg(*[share(F.col("base") == b.upper(), known).alias(b) for b in "gatc"], share(~F.col("base").isin("A", "C", "G", "T"), F.sum("n")).alias("n"))


def binned_adapters(reads: DataFrame) -> DataFrame:
    """(adapter, low, high, percent): mean over a bin's positions of the per cent of reads with the adapter so far."""
    total = reads.agg(F.count("*").alias("total"))
    rows = in_bins(adapter_content(reads).crossJoin(F.broadcast(total)), longest_read(reads))  # one row
    return rows.groupBy("adapter", "low", "high").agg(F.round(F.avg(F.col("n") * 100.0 / F.col("total")), 6).alias("percent"))


def length_interval(least: int, most: int) -> tuple[int, int]:
    """First value and width of the bins of lengths: 1, 2 or 5 times a power of ten that leaves 50 steps at most."""
    width = next(m * 10**e for e in range(19) for m in (1, 2, 5) if (most - least) // (m * 10**e) <= 50)
    return least // width * width, width


def length_bins(reads: DataFrame) -> DataFrame:
    """(low, high, n): reads by length, in bins from one below the least length to one above the greatest; empty ones are there."""
    h = lengths(reads)
    ends = h.agg(F.min("len").alias("least"), F.max("len").alias("most")).first()
    least, most = max(0, (ends["least"] or 0) - 1), (ends["most"] or 0) + 1
    first, width = length_interval(least, most)
    grid = reads.sparkSession.range(first, most + 1, width).select(F.col("id").cast("int").alias("low"), F.least(F.col("id") + width - 1, F.lit(most)).cast("int").alias("high"))
    found = h.groupBy((F.floor((F.col("len") - first) / width) * width + first).cast("int").alias("low")).agg(F.sum("n").alias("n"))
    return grid.join(found, "low", "left").select("low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def duplication_percent(reads: DataFrame, key_length: int = 50) -> DataFrame:
    """(slot, percent): share of all reads whose sequence occurs as often as the slot says."""
    d = duplication(reads, key_length)
    total = d.agg(F.sum("n_reads").alias("total"))
    return d.crossJoin(F.broadcast(total)).select("slot", F.round(F.col("n_reads") * 100.0 / F.col("total"), 6).alias("percent"))  # one row


def verdict(value: Column, module: str, above: bool = True) -> Column:
    warn, fail = LIMITS[module]
    worse = (lambda x: value > x) if above else (lambda x: value < x)
    return F.when(worse(fail), "fail").when(worse(warn), "warn").otherwise("pass")


def verdicts(reads: DataFrame) -> DataFrame:
    """(module, value, verdict): the deciding figure of each module."""
    content = base_content(reads).agg(F.max(F.greatest(F.abs(F.col("g") - F.col("c")), F.abs(F.col("a") - F.col("t")))).alias("value"))
    ns = n_content(reads).agg(F.max("n_percent").alias("value"))
    dup = duplication(reads).agg(F.round(F.sum("n_sequences") * 100.0 / F.sum("n_reads"), 6).alias("value"))
    over = sequence_counts(reads).agg(F.round(F.max("n") * 100.0 / F.sum("n"), 6).alias("value"))
    mode = sequence_quality(reads).agg(F.max(F.struct("n", (-F.col("quality")).alias("q"))).alias("m")).select((-F.col("m.q")).cast("double").alias("value"))
    made = [d.select(F.lit(name).alias("module"), "value", verdict(F.col("value"), limit, above).alias("verdict")) for name, limit, above, d in (
        ("base_content", "sequence", True, content), ("n_content", "n_content", True, ns), ("duplication", "duplication", False, dup), ("overrepresented", "overrepresented", True, over),
        ("sequence_quality", "quality_sequence", False, mode))]
    out = made[0]
    for d in made[1:]:
        out = out.union(d)
    return out


def format_length(n: Column) -> Column:
    """bp, kbp, Mbp or Gbp with one decimal digit at most, cut off."""
    def unit(by: int, name: str) -> Column:
        tenths = F.floor(n / (by / 10))
        return F.concat(F.when(tenths % 10 == 0, (tenths / 10).cast("long").cast("string")).otherwise(F.format_string("%.1f", tenths / 10)), F.lit(f" {name}"))

    return F.when(n >= 1_000_000_000, unit(1_000_000_000, "Gbp")).when(n >= 1_000_000, unit(1_000_000, "Mbp")).when(n >= 1000, unit(1000, "kbp")).otherwise(F.concat(n.cast("string"), F.lit(" bp")))
