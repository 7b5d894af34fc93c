"""Result tables: merging of measures, reduction of timing logs, grouping of files, contaminants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import reverse_complement
from ..functions.scalars import pair_number


def merge_results(sizes: DataFrame, perf: DataFrame) -> DataFrame:
    """Outer join of file sizes and timings by method: (Method_Process, File_Size_Bytes, CPU_Time_Sec, Peak_Memory_KB)."""
    key = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    a = sizes.select(key(F.col("Filename")).alias("Method_Process"), F.col("SizeBytes").alias("File_Size_Bytes"))
    b = perf.select(key(F.col("Filename")).alias("Method_Process"), F.col("Total_CPU_Sec").alias("CPU_Time_Sec"), F.col("Peak_Mem_KB").alias("Peak_Memory_KB"))
    return a.join(b, "Method_Process", "full_outer").orderBy("Method_Process")


def reduce_timings(lines: DataFrame) -> DataFrame:
    """(Filename, Total_CPU_Sec, Peak_Mem_KB) from logs ``(Filename, line)`` of GNU time."""
    number = lambda label: F.max(F.when(F.col("line").contains(label), F.regexp_extract("line", r"([0-9.]+)\s*$", 1).cast("double")))
    made = lines.groupBy("Filename").agg(number("User time").alias("u"), number("System time").alias("s"), number("Maximum resident set size").cast("long").alias("Peak_Mem_KB"))
    return made.select("Filename", (F.col("u") + F.col("s")).alias("Total_CPU_Sec"), "Peak_Mem_KB")


def file_group(name: Column) -> Column:
    """Files of one sample: lane parts _001, _002, ... of a name are one group."""
    return F.regexp_replace(name, r"_\d{3}(\.[A-Za-z.]+)$", "$1")


def contaminants(sequences: DataFrame, known: DataFrame, least: int = 20) -> DataFrame:
    """(key, name, length, identity) of the best match of each sequence, both strands, by length then identity.

    Sequences of 8 to 19 bases match as a whole; longer ones by their longest equal run at any offset, of over ``least``.
    """
    both = known.select("name", F.explode(F.array("sequence", reverse_complement(F.col("sequence")))).alias("known"))
    n = F.length("key")
    # a whole match shares its first 8 bases; a run of over ``least`` with one difference has least / 2 equal bases in a row
    starts = sequences.where((n >= 8) & (n < least)).withColumn("part", F.substring("key", 1, 8))
    whole = starts.join(_parts(both, "known", 8, "at"), "part").where(F.substring(F.col("known"), F.col("at"), n) == F.col("key"))
    short = whole.select("key", "name", n.alias("length"), F.lit(100).alias("identity")).distinct()
    seeds = _parts(sequences.where(n >= least), "key", least // 2, "i").join(_parts(both, "known", least // 2, "at"), "part")
    shifted = seeds.select("key", "name", "known", (F.col("i") - F.col("at")).alias("offset")).distinct()
    at = lambda i: F.substring("key", i, F.lit(1)) == F.substring("known", i - F.col("offset"), F.lit(1))
    span = F.sequence(F.greatest(F.lit(1), F.col("offset") + 1), F.least(n, F.col("offset") + F.length("known")))
    # longest run with one difference: fold of (current, last, best, best differences)
    fold = F.aggregate(span, F.struct(F.lit(0).alias("cur"), F.lit(0).alias("last"), F.lit(0).alias("mis"), F.lit(0).alias("best"), F.lit(0).alias("bm")), lambda s, i: _step(s, at(i)))
    long = shifted.withColumn("m", fold).where(F.col("m.best") > least).select("key", "name", F.col("m.best").alias("length"), F.floor((F.col("m.best") - F.col("m.bm")) * 100 / F.col("m.best")).cast("int").alias("identity"))
    best = short.union(long).groupBy("key").agg(F.max(F.struct("length", "identity", "name")).alias("b"))
    return best.select("key", "b.name", "b.length", "b.identity")


def _parts(rows: DataFrame, text: str, k: int, at: str) -> DataFrame:
    """``rows`` once for each part of k letters of a text, with the part and where it begins, from 1 on."""
    begins = F.explode(F.sequence(F.lit(1), F.length(text) - k + 1)).alias(at)
    return rows.where(F.length(text) >= k).select("*", begins).withColumn("part", F.substring(F.col(text), F.col(at), F.lit(k)))


def _step(s: Column, same: Column) -> Column:
    cur = F.when(same, s["cur"] + 1).when(s["mis"] == 0, s["cur"] + 1).otherwise(s["last"] + 1)
    last = F.when(same, s["last"] + 1).otherwise(F.lit(0))
    mis = F.when(same, s["mis"]).otherwise(F.lit(1))
    better = cur > s["best"]
    return F.struct(cur.alias("cur"), last.alias("last"), mis.alias("mis"), F.when(better, cur).otherwise(s["best"]).alias("best"), F.when(better, mis).otherwise(s["bm"]).alias("bm"))


def mates(reads: DataFrame) -> DataFrame:
    """(name, first, second): read_id of both reads of a pair, by the name before ``/1`` or ``/2``; reads without a mate are not there."""
    pair = pair_number(F.col("header"))
    named = reads.select(pair["header"].alias("name"), pair["pair"].alias("pair"), "read_id")
    first, second = (named.where(F.col("pair") == i).select("name", F.col("read_id").alias(c)) for i, c in ((1, "first"), (2, "second")))
    return first.join(second, "name")


def file_format(name: Column) -> Column:
    """What a file is read as, by its last suffix: sam, fast5, encoded or else fastq."""
    low = F.lower(F.regexp_replace(name, r"\.(gz|bz2)$", ""))
    return F.when(low.rlike(r"\.(bam|sam|ubam)$"), "sam").when(low.endswith(".fast5"), "fast5").when(low.endswith(".enc"), "encoded").otherwise("fastq")


def with_run(reads: DataFrame, runs: DataFrame, block: int = 1_000_000) -> DataFrame:
    """``reads`` with the flowcell whose run (first_id, last_id) holds their read_id; a range join by blocks of read ids."""
    spread = runs.select("flowcell", "first_id", "last_id", F.explode(F.sequence(F.floor(F.col("first_id") / block), F.floor(F.col("last_id") / block))).alias("block"))
    joined = reads.withColumn("block", F.floor(F.col("read_id") / block)).join(spread, "block", "left")
    inside = F.col("read_id").between(F.col("first_id"), F.col("last_id"))
    return joined.where(inside | F.col("first_id").isNull()).drop("block", "first_id", "last_id")


def write_sorted_csv(rows: DataFrame, path: str, *by: str) -> None:
    rows.orderBy(*by).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_gene_map(spark, path: str) -> DataFrame:
    """(tx, gene) from a tab-separated file; lines that begin with # and further columns are left out."""
    return spark.read.csv(path, sep="\t", comment="#").select(F.col("_c0").alias("tx"), F.col("_c1").alias("gene"))
