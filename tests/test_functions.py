import random

import pytest
from pyspark.sql import functions as F

from contigua.functions import coords, dna, scores


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_primers(spark):
    got = one(spark, *[dna.has_primer(F.lit(s)) for s in ("AATGATACGGCGACCACCGAGATCTACA", "GATCGGAAGAGCGGTTCAGCAGGAATGC", "AGATCGGAAGAGCGGTTCAGCAGGAATGC", "")])
    assert tuple(got) == (True, True, False, True)


def test_headers_and_strands(spark):
    name, comment = dna.split_header(F.lit("test BX:Z:ACGT"))
    got = one(spark, name, comment, F.reverse(F.lit("ACGTGAC")), dna.complement(F.reverse(F.lit("ACGTGAC"))), dna.reverse_complement(F.lit("ACGTGAC")), dna.split_header(F.lit("a"))[1])
    assert tuple(got) == ("test", "BX:Z:ACGT", "CAGTGCA", "GTCACGT", "GTCACGT", None)


@pytest.mark.parametrize("name,mate,base", [("R/1", "R/2", "R"), ("R/2", "R/1", "R"), ("R/A", "R/B", "R"), ("R/B", "R/A", "R"), ("R/f", "R/r", "R"), ("R/r", "R/f", "R"), ("R", "", "R"), ("", "", "")])
def test_pairs(spark, name, mate, base):
    got = one(spark, dna.mate_name(F.lit(name)), dna.pair_basename(F.lit(name)))
    assert tuple(got) == (mate, base)


def test_ranks(spark):
    got = spark.createDataFrame([(c,) for c in "$ACGTNa"], "c string").select(dna.symbol_rank("c").alias("r")).collect()
    assert [r.r for r in got] == [0, 1, 2, 3, 4, 0, 0]


def soft(phreds, least):
    """The rule, base by base."""
    if not phreds or phreds[-1] >= least:
        return len(phreds)
    total = most = end = 0
    for i in range(len(phreds), 0, -1):
        total += least - phreds[i - 1]
        if total > most:
            most, end = total, i
    return end


def test_soft_clip(spark):
    rng = random.Random(1)
    cases = [[30, 30, 30, 2, 2], [30, 30, 30, 30, 2], []] + [[rng.randint(0, 40) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    frame = spark.createDataFrame([(i, "".join(chr(33 + p) for p in c)) for i, c in enumerate(cases)], "i int, q string")
    got = {r.i: r.n for r in frame.select("i", dna.soft_clip_length("q", 20).alias("n")).collect()}
    assert got == {i: soft(c, 20) for i, c in enumerate(cases)}
    assert got[0] == 4 and got[1] == 5


def test_quality_codes(spark):
    got = one(spark, dna.phreds(F.lit("!I~")), dna.from_phred64(F.lit("@h")), dna.phred_char(F.lit(120)), dna.phred_of_error(F.lit(0.001)), dna.n_low_quality(F.lit("!$%I")), dna.is_valid_quality(F.lit("a b")))
    assert tuple(got) == ([0, 40, 93], "!I", "~", 30, 2, False)


def test_tags(spark):
    fields = F.array(*map(F.lit, ("VT", "test:i:100", "test:f:100.0", "test:Z:100.0", "other:i:x")))
    got = one(spark, dna.tag(fields, "test", "i", "int"), dna.tag(fields, "test", "f", "float"), dna.tag(fields, "test", "Z", "string"), dna.tag(fields, "none", "i", "int"), dna.tag(fields, "other", "i", "int"))
    assert tuple(got) == (100, 100.0, "100.0", None, None)


def test_coordinates(spark):
    i = lambda x: F.lit(x)
    got = one(spark, *coords.flip(i(2), i(5), i(10)), *coords.complement(i(0), i(4), i(10)), *coords.complement(i(6), i(9), i(10)), coords.translate_1_to_0(i(1), i(5), i(9), i(0), i(4), F.lit(True)), coords.intersects(i(0), i(3), i(3), i(5)))
    assert tuple(got) == (4, 7, 5, 9, 0, 5, 8, True)


def test_edge_label_and_follows(spark):
    got = one(spark, dna.edge_label(F.lit("AACCC"), F.lit(0), F.lit(1), F.lit(False)), dna.edge_label(F.lit("AACCC"), F.lit(3), F.lit(4), F.lit(True)), dna.follows(F.lit("AAACCC"), F.lit("CCCGG"), F.lit(3)), dna.follows(F.lit("AAACCC"), F.lit("CCGGG"), F.lit(3)))
    assert tuple(got) == ("CCC", "GTT", True, False)


def test_scores(spark):
    got = one(spark, scores.point_coverage(F.lit(0), F.lit(0)), scores.link_ratio(F.lit(3), F.lit(0), F.lit(2)), scores.link_ratio(F.lit(3), F.lit(6), F.lit(2)), scores.uniqueness(F.lit(100), F.lit(1)))
    assert got[0] == 0 and got[1] == 0 and got[2] == 1.5 and 2 < got[3] < 3


def test_iupac(spark):
    assert one(spark, dna.normalise_iupac(F.lit("acgtRYSWKMBDHVN")))[0] == "ACGTACCAGACAAAT"
