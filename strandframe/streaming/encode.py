"""Incremental encoding of arriving read tables by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.codec import Coding, encode_frame


def encode_stream(spark: SparkSession, source: str, target: str, checkpoint: str, coding: Coding = Coding()) -> StreamingQuery:
    """Encode Parquet files of reads (read_id, header, seq, qual) as they arrive; the file sink writes each once."""
    reads = spark.readStream.schema("read_id long, header string, seq string, qual string").parquet(source)
    return encode_frame(reads, coding).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
