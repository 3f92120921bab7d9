"""The per-cycle quality report over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def cycle_quality(reads: DataFrame) -> DataFrame:
    """(cycle, n, mean_quality, fraction_q30) over all reads (quality) of a stream so far: for outputs in complete or update mode.

    State is a row for each cycle, however long the stream.
    """
    bases = reads.where(F.col("quality").isNotNull() & (F.length("quality") > 0)).select(F.posexplode(dna.phreds("quality")).alias("cycle", "q"))
    return bases.groupBy("cycle").agg(F.count("*").alias("n"), F.avg("q").alias("mean_quality"), F.avg((F.col("q") >= 30).cast("double")).alias("fraction_q30"))
