"""Quantification: equivalence classes, expectation maximisation, effective lengths, abundances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def kmer_index(transcripts: DataFrame, k: int) -> DataFrame:
    """(kmer, txs): sorted transcripts that have the k-mer."""
    from .kmers import kmers_of

    rows = transcripts.select("tx_id", F.explode(kmers_of(F.col("seq"), k)).alias("kmer")).distinct()
    return rows.groupBy("kmer").agg(F.array_sort(F.collect_set(F.col("tx_id").cast("int"))).alias("txs"))


def _staged(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def pseudoalign(reads: DataFrame, transcripts: DataFrame, k: int, folder: str, union: bool = False, most_broadcast: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(read_id, ec_id) of reads with a k-mer of any transcript, and (ec_id, ec): the sorted transcripts that all such k-mers of the read are in, or (union) any.

    Copies are worked on once: transcripts of equal sequences as the least of them, reads as one of them. The sets are made
    of these, and each distinct set is written out to all its transcripts once, not for every k-mer and read. ``folder`` is
    a new one that all executors share. An index of up to ``most_broadcast`` rows is broadcast.
    """
    from .kmers import copies, kmers_of

    of = lambda rows, key: rows.select(key, F.explode(F.array_distinct(F.flatten(F.transform("seqs", lambda s: kmers_of(s, k))))).alias("kmer"))
    known = _staged(copies(transcripts.select(F.col("tx_id").cast("int"), "seq"), "tx_id").groupBy("seqs").agg(F.min("tx_id").alias("tx"), F.collect_list("tx_id").alias("txs")), f"{folder}/transcripts")
    each = _staged(copies(reads, "read_id"), f"{folder}/reads")
    alone = each.groupBy("seqs").agg(F.min("read_id").alias("read"))
    index = of(known, "tx")
    least = index.groupBy("kmer").agg(F.min("tx").alias("least"))
    index = _staged(index.join(least, "kmer").select("kmer", "tx", (F.col("tx") == F.col("least")).cast("long").alias("first")), f"{folder}/index")
    hits = of(alone, "read").join(F.broadcast(index) if index.count() <= most_broadcast else index, "kmer")
    # dealt by read, so that the steps below need no more exchange; n: k-mers of the read that the index has
    hits = hits.select("read", "tx", "first").repartition("read").groupBy("read", "tx").agg(F.count("*").alias("has"), F.sum("first").alias("first"))
    hits = hits.withColumn("n", F.sum("first").over(Window.partitionBy("read")))
    sets = hits.groupBy("read").agg(F.array_sort(F.collect_list(F.when(F.lit(union) | (F.col("has") == F.col("n")), F.col("tx")))).alias("some"))
    sets = sets.withColumn("ec_id", F.unhex(F.sha2(F.array_join("some", ","), 256)))
    sets = _staged(sets.join(alone, "read").select("seqs", "some", "ec_id"), f"{folder}/sets")
    whole = sets.select("ec_id", "some").distinct().select("ec_id", F.explode_outer("some").alias("tx")).join(known.select("tx", "txs"), "tx", "left")
    whole = whole.groupBy("ec_id").agg(F.array_sort(F.flatten(F.collect_list("txs"))).alias("ec"))
    return _staged(each.join(sets.select("seqs", "ec_id"), "seqs").select("read_id", "ec_id"), f"{folder}/of"), _staged(whole, f"{folder}/whole")


def set_counts(of: DataFrame, sets: DataFrame) -> DataFrame:
    """(ec, n) from what ``pseudoalign`` returns: reads by non-empty set, counted by its id."""
    return sets.where(F.size("ec") > 0).join(of.groupBy("ec_id").agg(F.count("*").alias("n")), "ec_id").select("ec", "n")


def ec_counts(ecs: DataFrame) -> DataFrame:
    return ecs.where(F.size("ec") > 0).groupBy("ec").agg(F.count("*").alias("n"))


def effective_length(length: Column, mean: float) -> Column:
    e = length - mean + 1
    return F.when(e < 1, length.cast("double")).otherwise(e)


def em_step(counts: DataFrame, alpha: DataFrame) -> DataFrame:
    """One step: (tx, alpha) from ``counts (ec_id, n, tx, weight)`` and ``alpha (tx, alpha)``; the share of each class by weight and alpha."""
    joined = counts.join(alpha, "tx").withColumn("part", F.col("weight") * F.col("alpha"))
    joined = joined.withColumn("all", F.sum("part").over(Window.partitionBy("ec_id")))
    return joined.groupBy("tx").agg(F.sum(F.when(F.col("all") > 0, F.col("n") * F.col("part") / F.col("all")).otherwise(0.0)).alias("alpha"))


def settle(sets: list[np.ndarray], n: np.ndarray, weight: np.ndarray, least_steps: int = 50, most_steps: int = 10_000) -> np.ndarray:
    """Abundances at convergence from classes (places of their transcripts) and their counts.

    Stops when none of over 0.01 changes by over 1 %, after ``least_steps`` at least; what is below 1e-8 is 0.
    """
    alpha, final = np.full(len(weight), 1 / max(1, len(weight))), False
    sizes = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), sizes)
    tx = np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)
    alone = np.repeat(sizes == 1, sizes)
    for step in range(most_steps):
        part = np.where(alone, 1.0, weight[tx] * alpha[tx])
        whole = np.bincount(of, part, len(sets))[of]
        share = np.divide(part, whole, out=np.zeros_like(part), where=whole > 0)
        new = np.bincount(tx, n[of] * share, len(weight))
        moved = (new > 1e-2) & (np.abs(new - alpha) > 1e-2 * new)
        alpha = new
        if final:
            break
        if step > least_steps and not moved.any():
            alpha[alpha < 1e-8] = 0
            final = True
    return alpha


def em(spark: SparkSession, counts: DataFrame, lengths: DataFrame, least_steps: int = 50, most_steps: int = 10_000) -> DataFrame:
    """(tx, alpha) at convergence (see ``settle``); the classes, not the reads, come to the driver."""
    rows = counts.collect()
    eff = {r["tx"]: r["eff_length"] for r in lengths.collect()}
    names = sorted(eff)
    at = {t: i for i, t in enumerate(names)}
    alpha = settle([np.array([at[t] for t in r["ec"]]) for r in rows], np.array([r["n"] for r in rows], dtype=float), np.array([1 / eff[t] for t in names]), least_steps, most_steps)
    return spark.createDataFrame([(int(t), float(a)) for t, a in zip(names, alpha, strict=True)], "tx int, alpha double")


def tpm(abundance: DataFrame) -> DataFrame:
    """Adds tpm: counts per effective length, in millionths of their sum. One row per transcript."""
    rate = F.col("est_counts") / F.col("eff_length")
    total = abundance.agg(F.sum(rate).alias("_total"))
    return abundance.crossJoin(F.broadcast(total)).withColumn("tpm", F.round(rate / F.col("_total") * 1e6, 6)).drop("_total")  # one row


def bootstrap(spark: SparkSession, counts: DataFrame, lengths: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(sample, tx, alpha): expectation maximisation over resampled class counts, one task per sample."""
    ecs, eff = counts.orderBy(F.col("ec").cast("string")).toPandas(), lengths.toPandas()
    total = int(ecs["n"].sum())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["id"].iloc[0])
        draw = np.random.default_rng([seed, i]).multinomial(total, ecs["n"] / total)
        names = sorted(eff["tx"])
        at = {t: k for k, t in enumerate(names)}
        weight = 1 / eff.set_index("tx").loc[names, "eff_length"].to_numpy()
        alpha = settle([np.array([at[t] for t in ec]) for ec in ecs["ec"]], draw.astype(float), weight)
        return pd.DataFrame({"sample": i, "tx": names, "alpha": alpha})

    return spark.range(n).groupBy("id").applyInPandas(one, "sample long, tx int, alpha double")


def gene_sums(abundance: DataFrame, genes: DataFrame) -> DataFrame:
    return abundance.join(genes, "tx_id").groupBy("gene").agg(F.round(F.sum("est_counts"), 6).alias("est_counts"), F.round(F.sum("tpm"), 6).alias("tpm"))


def fragment_lengths(lengths: DataFrame, most: int = 1000) -> DataFrame:
    """(length, n, mean): counts of fragments by length under ``most``, and the mean of all up to that length."""
    h = lengths.where((F.col("length") >= 0) & (F.col("length") < most)).groupBy("length").agg(F.count("*").alias("n"))
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)  # ``most`` rows
    return h.select("length", "n", F.round(F.sum(F.col("n") * F.col("length")).over(up) / F.sum("n").over(up), 6).alias("mean"))


def abundance_lines(abundance: DataFrame) -> DataFrame:
    """(place, line) of the tab-separated abundance table, its header first: target_id, length, eff_length, est_counts, tpm."""
    spark = abundance.sparkSession
    head = spark.createDataFrame([(-1, "target_id\tlength\teff_length\test_counts\ttpm")], "place long, line string")
    number = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    return head.union(abundance.select(F.col("tx_id").cast("long"), F.concat_ws("\t", F.col("tx_id").cast("string"), F.col("length").cast("string"), number("eff_length"), number("est_counts"), number("tpm"))))
