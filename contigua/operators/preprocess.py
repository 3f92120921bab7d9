"""Filtering, clipping and pairing of raw reads (read_idx, name, seq, quality, comment[, barcode])."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna


@dataclass(frozen=True)
class Options:
    """pairs: 0 single reads, 1 and 2 pairs; orientation: fr turns the second read, rf the first, ff neither."""

    pairs: int = 0
    orientation: str = "fr"
    phred64: bool = False
    quality_trim: int = 0
    quality_filter: int = -1
    min_length: int = 40
    hard_clip: int = 0
    sample_rate: float = 1.0
    sample_seed: int = 0
    primer_check: bool = True
    with_index: bool = False


def clipped(reads: DataFrame, n: Column) -> DataFrame:
    """reads cut to their first n bases; n is worked out once a read."""
    held = reads.withColumn("_clip", n)
    return held.withColumns({"seq": F.left("seq", F.col("_clip")), "quality": F.left("quality", F.col("_clip"))}).drop("_clip")


def hard_clip(reads: DataFrame, n: int) -> DataFrame:
    return clipped(reads, F.lit(n))


def soft_clip(reads: DataFrame, least: int) -> DataFrame:
    """Cuts low-quality 3' ends; reads without qualities stay whole."""
    return clipped(reads, F.when(F.col("quality").isNull(), F.length("seq")).otherwise(dna.soft_clip_length("quality", least)))


def reverse_complemented(reads: DataFrame, when: Column) -> DataFrame:
    return reads.withColumns({"seq": F.when(when, dna.reverse_complement("seq")).otherwise(F.col("seq")), "quality": F.when(when, F.reverse("quality")).otherwise(F.col("quality"))})


def sampled(key: Column, rate: float, seed: int = 0) -> Column:
    """Whether a hash of the key falls below the rate: the same at every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))


def judged(reads: DataFrame, o: Options) -> DataFrame:
    """reads clipped, with why each is dropped (drop is null if it isn't): the steps run in this order and no other.

    Upper case, bases only, qualities to phred + 33 (invalid ones are flagged, not dropped), hard clip, soft clip,
    low-quality count (dropped at quality_filter or more), primer, length.
    """
    out = reads.withColumn("seq", F.upper("seq"))
    if o.with_index:
        out = out.withColumn("comment", F.concat(F.lit("BX:Z:"), "barcode"))
    if o.phred64:
        out = out.withColumn("quality", dna.from_phred64("quality"))
    out = out.withColumn("invalid_quality", F.coalesce(~dna.is_valid_quality("quality"), F.lit(False)))
    bases = dna.is_dna("seq")
    out = out.withColumn("_bases", bases)
    if o.hard_clip > 0:
        out = hard_clip(out, o.hard_clip)
    if o.quality_trim > 0:
        out = soft_clip(out, o.quality_trim)
    low = F.coalesce(dna.n_low_quality("quality") >= o.quality_filter, F.lit(False)) if o.quality_filter >= 0 else F.lit(False)
    primer = dna.has_primer("seq") if o.primer_check else F.lit(False)
    why = F.when(~F.col("_bases"), "bases").when(low, "quality").when(primer, "primer").when(F.length("seq") < o.min_length, "length")
    return out.withColumn("drop", why).drop("_bases")


def paired(reads: DataFrame) -> DataFrame:
    """reads of one interleaved table with pair_idx and mate (0 or 1)."""
    return reads.withColumns({"pair_idx": F.expr("read_idx div 2"), "mate": (F.col("read_idx") % 2).cast("int")})


def zipped(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two tables of reads as one of pairs, by place; what one of them has beyond the other is left out."""
    a, b = (df.withColumns({"pair_idx": F.col("read_idx"), "mate": F.lit(m)}) for m, df in enumerate((first, second)))
    both = a.select("pair_idx").intersect(b.select("pair_idx"))
    return a.unionByName(b).join(both, "pair_idx", "left_semi").withColumn("read_idx", F.col("pair_idx") * 2 + F.col("mate"))


def with_barcodes(reads: DataFrame, barcodes: DataFrame) -> DataFrame:
    """reads with the barcode (read_idx, barcode) that stands at the same place; the shorter table ends both."""
    return reads.drop("barcode").join(barcodes.select("read_idx", "barcode"), "read_idx")


def _whole_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each two mates, side by side; half pairs are left out."""
    side = lambda m: pairs.where(F.col("mate") == m)
    a, b = side(0), side(1)
    return a.select("pair_idx", F.struct(*a.columns).alias("a")).join(b.select("pair_idx", F.struct(*b.columns).alias("b")), "pair_idx")


def filtered(reads: DataFrame, o: Options = Options()) -> DataFrame:
    """What passes: single reads, or pairs of which both reads pass, oriented, with distinct names.

    For pairs reads must have pair_idx and mate. Sampling looks at what has passed, whole pairs at a time. Pairs whose
    names don't match are counted by statistics(), not dropped.
    """
    own = reads.columns
    out = judged(reads, o)
    if not o.pairs:
        kept = out.where(F.col("drop").isNull() & sampled(F.col("read_idx"), o.sample_rate, o.sample_seed))
        return kept.select(*own)
    both = _whole_pairs(out).where(F.col("a.drop").isNull() & F.col("b.drop").isNull() & sampled(F.col("pair_idx"), o.sample_rate, o.sample_seed))
    same = F.col("a.name") == F.col("b.name")
    flat = both.select(F.explode(F.array("a", "b")).alias("r"), same.alias("_same")).select("r.*", "_same")
    turn = {"fr": 1, "rf": 0}.get(o.orientation)
    flat = reverse_complemented(flat, F.lit(False) if turn is None else F.col("mate") == turn)
    flat = flat.withColumn("name", F.when(F.col("_same"), F.concat("name", F.lit("/"), F.col("mate") + 1)).otherwise(F.col("name")))
    return flat.select(*own)


def statistics(reads: DataFrame, o: Options = Options()) -> DataFrame:
    """One row: reads and bases parsed and kept, primer failures, invalid qualities, and for pairs mismatched names."""
    out = judged(reads, o)
    counts = {
        "n_reads": F.count("*"),
        "n_bases": F.coalesce(F.sum(F.length("_raw")), F.lit(0)),
        "n_kept": F.count_if(F.col("drop").isNull()),
        "n_kept_bases": F.coalesce(F.sum(F.when(F.col("drop").isNull(), F.length("seq"))), F.lit(0)),
        "n_primer": F.count_if(F.col("drop") == "primer"),
        "n_invalid_quality": F.count_if(F.col("invalid_quality")),
    }
    found = judged(reads.withColumn("_raw", F.col("seq")), o).agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    if not o.pairs:
        return found
    names = _whole_pairs(out).where(F.col("a.name") != F.col("b.name")).where(dna.mate_name(F.col("a.name")) != F.col("b.name"))
    return found.crossJoin(names.agg(F.count("*").alias("n_invalid_pairs")))


def mismatched(pairs: DataFrame) -> DataFrame:
    """(pair_idx, first, second): pairs whose names differ without being mates'."""
    both = _whole_pairs(pairs.select("pair_idx", "mate", "name"))
    names = both.select("pair_idx", F.col("a.name").alias("first"), F.col("b.name").alias("second"))
    return names.where((F.col("first") != F.col("second")) & (dna.mate_name("first") != F.col("second")))
