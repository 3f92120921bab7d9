"""Quality report of reads before assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from . import kmers
from .preprocess import sampled

SAMPLE_RATE = 0.05


def cycle_quality(reads: DataFrame, sample_rate: float = SAMPLE_RATE, seed: int = 0) -> DataFrame:
    """(cycle, mean_quality, fraction_q30): by place in the read, over a sample of reads; cycles count from 0."""
    own = reads.where(F.col("quality").isNotNull() & (F.length("quality") > 0))
    if sample_rate < 1:
        own = own.where(sampled(F.col("read_idx"), sample_rate, seed))
    bases = own.select(F.posexplode(dna.phreds("quality")).alias("cycle", "q"))
    return bases.groupBy("cycle").agg(F.avg("q").alias("mean_quality"), F.avg((F.col("q") >= 30).cast("double")).alias("fraction_q30"))


def report(reads: DataFrame, k: int = 31, sample_rate: float = SAMPLE_RATE) -> DataFrame:
    """One row, json: QualityScores with an entry for each cycle, and GenomeSize."""
    cycles = cycle_quality(reads, sample_rate).agg(F.sort_array(F.collect_list(F.struct("cycle", "mean_quality", "fraction_q30"))).alias("c"))
    size = kmers.genome_size(kmers.counts(reads, k))
    made = F.struct(F.struct(F.col("c.mean_quality").alias("mean_quality"), F.col("c.fraction_q30").alias("fraction_q30")).alias("QualityScores"), F.struct(F.lit(k).alias("k"), "size").alias("GenomeSize"))
    return cycles.crossJoin(size.select("size")).select(F.to_json(made).alias("json"))
