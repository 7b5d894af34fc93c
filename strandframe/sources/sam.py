"""SAM text as reads: all or mapped only, reverse strand undone, soft clips trimmed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import reverse_complement


def read_sam(spark: SparkSession, path: str, mapped_only: bool = False) -> DataFrame:
    """(header, seq, qual, flag, cigar) of the alignments of a SAM file."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(f[0].alias("header"), f[1].cast("int").alias("flag"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"))
    if mapped_only:
        rows = rows.where(F.col("flag").bitwiseAND(F.lit(4)) == 0)
        tail, head = (F.coalesce(F.regexp_extract("cigar", p, 1).try_cast("int"), F.lit(0)) for p in (r"(\d+)S$", r"^(\d+)S"))
        rows = rows.withColumn("tail", tail).withColumn("head", head)
        for c in ("seq", "qual"):
            rows = rows.withColumn(c, F.substring(c, F.col("head") + 1, F.length(c) - F.col("head") - F.col("tail")))
    back = F.col("flag").bitwiseAND(F.lit(16)) != 0
    return rows.select("header", F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), "flag", "cigar")
