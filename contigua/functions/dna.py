"""Sequence and quality functions on columns. Sequences are strings over ACGT, qualities phred + 33."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "$ACGT"
#: Phred of every base of a read without qualities.
DEFAULT_PHRED = 15
MAX_PHRED = 93
LOW_PHRED = 3
#: The sequencing primers that reads are screened for.
PRIMERS = ("AATGATACGGCGACCACCGAGATCTACA", "GATCGGAAGAGCGGTTCAGCAGGAATGC")
PRIMER_BASES = 14


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: Column | str) -> Column:
    return F.translate(_col(seq), "ACGT", "TGCA")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def canonical(seq: Column | str) -> Column:
    """The smaller of a sequence and its reverse complement: equal for both strands."""
    return F.least(_col(seq), reverse_complement(seq))


def is_dna(seq: Column | str) -> Column:
    return _col(seq).rlike("^[ACGT]*$")


def normalise_iupac(seq: Column | str) -> Column:
    """Ambiguity codes to the first base that they allow in the fixed order A, C, G, T; N to T."""
    return F.translate(F.upper(_col(seq)), "RYSWKMBDHVN", "ACCAGACAAAT")


def symbol_rank(char: Column | str) -> Column:
    """0 for $ and anything unknown, then A, C, G, T."""
    return F.when(F.length(_col(char)) == 1, F.call_function("instr", F.lit("ACGT"), _col(char))).otherwise(F.lit(0))


def phreds(quality: Column | str) -> Column:
    """Array of phred values."""
    return F.transform(F.split(_col(quality), ""), lambda c: F.ascii(c) - 33)


def from_phred64(quality: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_col(quality), ""), lambda c: F.char(F.ascii(c) - 31)), "")


def phred_char(phred: Column | str) -> Column:
    return F.char(F.least(_col(phred), F.lit(MAX_PHRED)) + 33)


def phred_of_error(probability: Column | str) -> Column:
    return F.round(-10 * F.log10(_col(probability))).cast("int")


def is_valid_quality(quality: Column | str) -> Column:
    return _col(quality).rlike("^[\\x21-\\x7E]*$")


def n_low_quality(quality: Column | str, low: int = LOW_PHRED) -> Column:
    """How many bases have phred <= low."""
    chars = "".join(chr(33 + p) for p in range(low + 1))
    return F.length(_col(quality)) - F.length(F.translate(_col(quality), chars, ""))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty; offsets has one more entry than the column."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _clip_lengths(column: pa.Array, least: int) -> pa.Array:
    raw, offsets = _flat(column)
    out = np.diff(offsets)
    some = np.flatnonzero(out)
    if len(some):
        begin, end = offsets[some], offsets[some + 1]
        lack = least + 33 - raw.astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(lack)))
        # What is lacking from each base to the end of its read.
        size = out[some]
        sums = np.repeat(upto[end], size) - upto[:-1]
        most = np.maximum.reduceat(sums, begin)
        at = np.maximum.reduceat(np.where(sums == np.repeat(most, size), np.arange(len(sums)), -1), begin)
        cut = np.where(most > 0, at - begin + 1, 0)
        out[some] = np.where(raw[end - 1] >= least + 33, size, cut)
    return pa.array(out, pa.int32())


def soft_clip_length(quality: Column | str, least: int) -> Column:
    """Bases to keep: nothing is cut if the last base has phred >= least.

    Else sums of least - phred are taken from the 3' end, and the read ends with the base at which the sum is
    greatest (the first such from the end), that base included; 0 if no sum is positive. Whole batches of qualities are
    taken at once, as bytes.
    """

    @F.arrow_udf("int")
    def lengths(column: pa.Array) -> pa.Array:
        return _clip_lengths(column, least)

    return lengths(_col(quality).cast("string"))


def has_primer(seq: Column | str, primers: tuple[str, ...] = PRIMERS, bases: int = PRIMER_BASES) -> Column:
    """Whether the first bases of a read occur anywhere in a primer; an empty read does."""
    found = F.lit(False)
    for p in primers:
        found = found | F.contains(F.lit(p), F.left(_col(seq), F.lit(bases)))
    return found | (F.length(_col(seq)) == 0)


def mate_name(name: Column | str) -> Column:
    """The other read's name: A and B, 1 and 2, f and r are swapped at the end; empty if there is none of these."""
    n = _col(name)
    end = F.right(n, F.lit(1))
    return F.when(n.rlike("[AB12fr]$"), F.concat(n.substr(F.lit(1), F.length(n) - 1), F.translate(end, "AB12fr", "BA21rf"))).otherwise(F.lit(""))


def pair_basename(name: Column | str) -> Column:
    """The name before its last slash."""
    return F.regexp_replace(_col(name), "/[^/]*$", "")


def pair_index(name: Column | str) -> Column:
    """0 for names that end in A, 1 or f, 1 for B, 2 or r, else null."""
    end = F.right(_col(name), F.lit(1))
    return F.when(end.isin("A", "1", "f"), 0).when(end.isin("B", "2", "r"), 1)


def split_header(header: Column | str) -> tuple[Column, Column]:
    """(name, comment): parted at the first space or tab; comment is null without one."""
    parts = F.split(_col(header), "[ \t]", 2)
    return parts[0], F.when(F.size(parts) > 1, parts[1])


def tag(fields: Column, key: str, kind: str, cast: str) -> Column:
    """Value of the KEY:kind:value tag in an array of fields; null without it."""
    own = F.try_element_at(F.filter(fields, lambda x: x.startswith(f"{key}:{kind}:")), F.lit(1))
    return own.substr(F.lit(len(key) + len(kind) + 3), F.length(own)).try_cast(cast)


def edge_label(seq: Column | str, start: Column | str, end: Column | str, reverse: Column) -> Column:
    """The part of an end vertex that an overlap [start, end] leaves over, on the other strand if reverse."""
    s, e, q = _col(start), _col(end), _col(seq)
    rest = F.when(s == 0, q.substr(e + 2, F.length(q))).otherwise(q.substr(F.lit(1), s))
    return F.when(reverse, reverse_complement(rest)).otherwise(rest)


def follows(first: Column | str, second: Column | str, distance: Column) -> Column:
    """Whether second, placed distance bases after the start of first, agrees with it where they overlap."""
    a, b = _col(first), _col(second)
    rest = a.substr(distance + 1, F.length(a))
    return F.when(F.length(rest) <= F.length(b), b.startswith(rest)).otherwise(rest.startswith(b))
