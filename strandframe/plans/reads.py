"""Reads, headers and transcripts derived from the driver's tables, alike in Spark and in SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, header, seq, qual) of every event: 16 to 32 bases from md5; a third repeat; each 7th holds an adapter."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("read_id"))
    k = F.when(F.col("read_id") % 3 == 0, F.col("read_id") % 400).otherwise(F.col("read_id"))
    e = e.withColumn("k", k).withColumn("n", (16 + F.col("k") % 17).cast("int"))
    raw = F.translate(F.substring(F.md5(F.concat(F.lit("s"), F.col("k").cast("string"))), F.lit(1), F.col("n")), HEX, "ACGTACGTACGTACGN")
    spliced = F.substring(F.concat(F.substring("raw", F.lit(1), (F.col("read_id") % 20).cast("int")), F.lit("AGATCGGAAGAG"), F.col("raw")), F.lit(1), F.col("n"))
    e = e.withColumn("raw", raw).withColumn("seq", F.when(F.col("read_id") % 7 == 0, spliced).otherwise(F.col("raw")))
    qual = F.translate(F.substring(F.md5(F.concat(F.lit("q"), F.col("read_id").cast("string"))), F.lit(1), F.col("n")), HEX, "#(+/269;>ACEGIK_")
    i = lambda c: c.cast("string")
    r = F.col("read_id")
    header = F.concat(F.lit("@M01368:85:FC"), i(r % 2), F.lit(":"), i(1 + r % 4), F.lit(":"), i(1101 + r % 8), F.lit(":"), i(1000 + r % 977), F.lit(":"), i(r), F.lit(" 1:N:0:"), i(r % 12))
    return e.select("read_id", header.alias("header"), "seq", qual.alias("qual"))


READS = f"""reads as (
  select event_id as read_id, '@M01368:85:FC' || event_id % 2 || ':' || (1 + event_id % 4) || ':' || (1101 + event_id % 8) || ':' || (1000 + event_id % 977) || ':' || event_id || ' 1:N:0:' || event_id % 12 as header,
    case when event_id % 7 = 0 then substr(substr(raw, 1, cast(event_id % 20 as integer)) || 'AGATCGGAAGAG' || raw, 1, n) else raw end as seq,
    translate(substr(md5('q' || event_id), 1, n), '{HEX}', '#(+/269;>ACEGIK_') as qual
  from (select event_id, n, translate(substr(md5('s' || k), 1, n), '{HEX}', 'ACGTACGTACGTACGN') as raw
    from (select event_id, k, cast(16 + k % 17 as integer) as n from (select event_id, case when event_id % 3 = 0 then event_id % 400 else event_id end as k from events))))"""

#: A row per base: (read_id, header, pos, base, ch, q).
BASES = READS + """,
bases as (select read_id, header, cast(i as integer) as pos, substr(seq, i, 1) as base, substr(qual, i, 1) as ch, greatest(0, least(ascii(substr(qual, i, 1)) - 33, 93)) as q
  from (select *, unnest(generate_series(1, length(seq))) as i from reads))"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx_id, seq, gene) of every part: 96 bases."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("tx_id"), F.col("p_brand").alias("gene"))
    text = F.concat(*[F.md5(F.concat(F.lit(x), (F.col("tx_id") % 997).cast("string"))) for x in "sab"])
    return p.select("tx_id", F.translate(text, HEX, "ACGTACGTACGTACGN").alias("seq"), "gene")


TRANSCRIPTS = f"transcripts as (select p_partkey as tx_id, translate(md5('s' || p_partkey % 997) || md5('a' || p_partkey % 997) || md5('b' || p_partkey % 997), '{HEX}', 'ACGTACGTACGTACGN') as seq, p_brand as gene from part)"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandframe-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
