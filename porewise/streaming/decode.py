"""Pileup lines that arrive as a stream; decoding them needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extractor import decode
from ..sources.text import parse_pileup


def decoded_stream(spark: SparkSession, folder: str, num_reads: int = 1) -> DataFrame:
    """Decoded rows of every text file that appears in ``folder``."""
    lines = spark.readStream.format("text").load(folder)
    return decode(parse_pileup(lines).where(F.col("n_reads") >= num_reads))
