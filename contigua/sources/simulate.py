"""Reads of a paired-end sequencer, cut from known sequences: for tests and for measuring assemblies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_UNKNOWN = 10


def _uniform(*parts: Column | int) -> Column:
    """A number from 0 up to but not including 1: a hash, the same at every run."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 52)) / F.lit(float(1 << 52))


def paired_reads(genomes: DataFrame, *, length: int = 150, coverage: int = 50, insert: int = 1000, sigma: float = 0, seed: int = 0) -> DataFrame:
    """(read_idx, name, seq, quality, comment, pair_idx, mate) cut from genomes (name, seq), as many pairs as give the coverage.

    The first read starts anywhere, the second insert bases (and a normal deviate of sigma) behind its end, both as the
    genome reads. Genomes too short for that give none; a start is used once; pairs that reach beyond the genome, repeat
    another pair or have many unknown bases are left out, so that somewhat fewer come.
    """
    wide = 2 * length + insert
    own = genomes.where(F.length("seq") >= wide + 5 * math.ceil(sigma)).select("name", "seq", F.expr(f"length(seq) * {coverage} div {2 * length}").alias("n")).where("n > 0")
    tries = own.select("name", "n", F.length("seq").alias("size"), F.explode(F.expr("sequence(1, n)")).alias("k"))
    at = F.floor(_uniform(F.col("name"), F.col("k"), seed) * (F.col("size") - wide + 1)).cast("long")
    # Two uniform numbers make a normal one.
    normal = F.sqrt(-2 * F.ln(1 - _uniform(F.col("name"), F.col("k"), seed + 1))) * F.cos(2 * math.pi * _uniform(F.col("name"), F.col("k"), seed + 2))
    spots = tries.select("name", at.alias("at"), "k", "size", F.round(normal * sigma).cast("long").alias("more"))
    spots = spots.groupBy("name", "at").agg(F.min_by(F.struct("more", "size", "k"), "k").alias("x")).select("name", "at", "x.*")
    second = F.col("at") + length + insert + F.col("more")
    spots = spots.withColumn("second", second).where((F.col("second") >= 0) & (F.col("second") + length <= F.col("size")))
    # A genome is met by blocks of its places, so that no task cuts all reads of one.
    cut = spots.join(own.select("name", "seq"), "name").select("name", "at", F.col("seq").substr((F.col("at") + 1).cast("int"), F.lit(length)).alias("a"), F.col("seq").substr((F.col("second") + 1).cast("int"), F.lit(length)).alias("b"))
    known = cut.where(F.length(F.concat("a", "b")) - F.length(F.replace(F.concat("a", "b"), F.lit("N"), F.lit(""))) < MOST_UNKNOWN)
    once = known.groupBy("a", "b").agg(F.min(F.struct("name", "at")).alias("x")).select("a", "b", "x.name", "x.at")
    number = F.xxhash64("name", "at").bitwiseAND(F.lit((1 << 61) - 1))
    mates = F.array(*[F.struct(F.lit(m).alias("mate"), F.col(c).alias("seq")) for m, c in enumerate("ab")])
    flat = once.select(number.alias("pair_idx"), F.concat_ws("_", "name", "at").alias("_base"), F.explode(mates).alias("m"))
    return flat.select((F.col("pair_idx") * 2 + F.col("m.mate")).alias("read_idx"), F.concat("_base", F.lit("/"), F.col("m.mate") + 1).alias("name"), "m.seq", F.lit(None).cast("string").alias("quality"), F.lit(None).cast("string").alias("comment"), "pair_idx", "m.mate")
