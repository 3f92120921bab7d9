"""Duplicate and contained reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.storage import materialise
from . import kmers

#: With no more lengths than these, sequences of each are looked up among the longer ones' windows.
FEW_LENGTHS = 8


def copies(reads: DataFrame) -> DataFrame:
    """(canonical, name, n): for each sequence, whichever the strand, its smallest name and how many reads have it."""
    return reads.groupBy(dna.canonical("seq").alias("canonical")).agg(F.min("name").alias("name"), F.count("*").alias("n"))


def contained(sequences: DataFrame) -> DataFrame:
    """(seq): those of distinct sequences (seq) that stand strictly within another, on either strand.

    All lengths are the same in most read sets, and then nothing is compared. Sequences of few lengths are looked up among
    the windows of that length. Of many lengths, or short ones, they meet by the first bases of the shorter one, as many
    as the shortest sequence has.
    """
    sizes = sequences.agg(F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most")).first()
    if sizes.least is None or sizes.least == sizes.most:
        return sequences.limit(0).select("seq")
    lengths = [r.n for r in sequences.select(F.length("seq").alias("n")).distinct().where(F.col("n") < sizes.most).limit(FEW_LENGTHS + 1).collect()]
    if len(lengths) <= FEW_LENGTHS and sizes.least >= kmers.LEAST_PIECED:
        inner = None
        for n in sorted(lengths):
            own = sequences.where(F.length("seq") == n).select("seq", F.lit(0).alias("tag"))
            there = kmers.found(own, sequences.where(F.length("seq") > n), n, both_strands=True).where("n > 0").select("seq")
            inner = there if inner is None else inner.union(there)
        return inner
    k = max(1, sizes.least)
    small = sequences.where(F.length("seq") < sizes.most).select("seq", F.explode(F.array("seq", dna.reverse_complement("seq"))).alias("text"))
    small = small.select("seq", "text", F.xxhash64(F.left("text", F.lit(k))).alias("key"))
    large = sequences.where(F.length("seq") > sizes.least).select(F.col("seq").alias("outer"), F.explode(F.expr(f"sequence(1, length(seq) - {k} + 1)")).alias("p"))
    large = large.select(F.length("outer").alias("size"), F.expr("substr(outer, p)").alias("rest"), F.xxhash64(F.expr(f"substr(outer, p, {k})")).alias("key"))
    met = small.join(large, "key").where((F.col("size") > F.length("seq")) & F.col("rest").startswith(F.col("text")))
    return met.select("seq").distinct()


def rmdup(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped), reads with n_duplicates: how many reads have the sequence; 0 for a sequence within another.

    Of equal reads (on either strand) the smallest name is kept; of several reads with that name all are. Reads within
    longer ones are dropped.
    """
    classes = materialise(copies(reads), "rmdup")
    inner = contained(classes.select(F.col("canonical").alias("seq"))).select(dna.canonical("seq").alias("canonical"), F.lit(True).alias("_inner"))
    classes = classes.join(inner, "canonical", "left").select("canonical", F.col("name").alias("_name"), F.when(F.col("_inner"), 0).otherwise(F.col("n")).alias("n_duplicates"))
    found = reads.withColumn("canonical", dna.canonical("seq")).join(classes, "canonical")
    keep = (F.col("name") == F.col("_name")) & (F.col("n_duplicates") > 0)
    columns = [*reads.columns, "n_duplicates"]
    return found.where(keep).select(*columns), found.where(~keep).select(*columns)
