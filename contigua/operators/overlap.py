"""Exact suffix-prefix overlaps of reads on both strands, as an equi-join of parts of windows.

A row says that a suffix of read q, turned if q_rc, is a prefix of read t, turned if t_rc, of length bases: the
longest of its kind. Seen from q, that is its end if q_rc is false, else its start. Every overlap has a second row in
which the reads change places and both are turned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.storage import materialise
from . import kmers

MIN_OVERLAP = 10


def oriented(reads: DataFrame, both_strands: bool = True) -> DataFrame:
    """(name, rc, seq) of each read on each strand."""
    strands = [F.struct(F.lit(False).alias("rc"), F.col("seq").alias("seq"))]
    if both_strands:
        strands.append(F.struct(F.lit(True).alias("rc"), dna.reverse_complement("seq").alias("seq")))
    return reads.select("name", F.explode(F.array(*strands)).alias("o")).select("name", "o.rc", "o.seq")


def _spots(own: DataFrame, m: int, first: bool) -> DataFrame:
    """(name, rc, key, at, low, high, size, rest): the windows of m bases of reads (name, rc, seq), those with the same least part at the same place as one row.

    key stands for the part, which is at at, low and high are the first and last window's places, from 0, size is the
    read's and rest its bases from low on. first: only the window at 0; else all others.
    """
    part = min(m, max(8, 2 * m // 5), kmers.PACKED)

    def run(batches):
        for batch in batches:
            raw, offsets = dna._flat(batch.column(2))
            n, w = len(raw) - m + 1, m - part + 1
            if n <= 0:
                continue
            value = kmers._mixed(kmers._words(kmers._CODE[raw] & 3)[: len(raw) - part + 1] >> np.uint64(64 - 2 * part))
            # Of equal parts the first: equal windows have it at the same place.
            least, step = np.arange(len(value)), 1
            lesser = lambda x, y: np.where(value[y] < value[x], y, x)
            while 2 * step <= w:
                least, step = lesser(least[: len(least) - step], least[step:]), 2 * step
            least = lesser(least[: len(least) - (w - step)], least[w - step :]) if w > step else least
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            place = np.arange(n) - offsets[owner[:n]]
            there = np.flatnonzero((owner[:n] == owner[m - 1 :]) & (place == 0 if first else place > 0))
            new = np.ones(len(there), bool)
            new[1:] = (least[there[1:]] != least[there[:-1]]) | (owner[there[1:]] != owner[there[:-1]])
            low = there[new]
            high = there[np.append(np.flatnonzero(new)[1:], len(there)) - 1] if len(there) else low
            own = owner[low]
            begin, end = offsets[own], offsets[own + 1]
            size = end - low
            at = np.concatenate(([0], np.cumsum(size)))
            rest = raw[np.repeat(low - at[:-1], size) + np.arange(at[-1])]
            text = pa.Array.from_buffers(pa.string(), len(low), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rest))])
            told = pa.array(own)
            numbers = [pa.array(x.astype(np.int32)) for x in (least[low] - begin, low - begin, high - begin, end - begin)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(told), batch.column(1).take(told), pa.array(value[least[low]].astype(np.int64)), *numbers, text], ["name", "rc", "key", "at", "low", "high", "size", "rest"])

    return own.select("name", "rc", "seq").mapInArrow(run, "name string, rc boolean, key long, at int, low int, high int, size int, rest string")


def overlaps(reads: DataFrame, min_overlap: int = MIN_OVERLAP, *, both_strands: bool = True) -> DataFrame:
    """(q, q_rc, t, t_rc, length) for all pairs of different names with a proper overlap of min_overlap or more.

    A read's first min_overlap bases meet the other reads' windows of that length by the least of their parts, so that a
    read is shuffled once for some windows, not for each place; bases are then compared. Without both_strands reads meet
    as written only. Reads are over ACGT; other letters are compared as they are.
    """
    reads = reads.where(F.length("seq") >= min_overlap)
    own = oriented(reads, both_strands)
    place = _spots(own, min_overlap, False).select(F.col("name").alias("q"), F.col("rc").alias("q_rc"), "key", "at", "low", "high", "size", "rest")
    target = _spots(own, min_overlap, True).select(F.col("name").alias("t"), F.col("rc").alias("t_rc"), "key", F.col("at").alias("_at"), F.col("rest").alias("t_seq"))
    start = F.col("at") - F.col("_at")
    agree = start.between(F.col("low"), F.col("high")) & (F.col("size") - start < F.length("t_seq")) & F.col("t_seq").startswith(F.col("rest").substr(start - F.col("low") + 1, F.col("size")))
    # Both turned is the second row of both as written.
    once = (F.col("q") != F.col("t")) & ~(F.col("q_rc") & F.col("t_rc"))
    met = place.join(target, "key").where(once & agree)
    best = met.groupBy("q", "q_rc", "t", "t_rc").agg(F.max(F.col("size") - start).alias("length"))
    row = lambda q, q_rc, t, t_rc: F.struct(F.col(q).alias("q"), q_rc.alias("q_rc"), F.col(t).alias("t"), t_rc.alias("t_rc"), "length")
    as_found = row("q", F.col("q_rc"), "t", F.col("t_rc"))
    plain = ~F.col("q_rc") & ~F.col("t_rc")
    return best.select(F.explode(F.when(plain, F.array(as_found, row("t", F.lit(True), "q", F.lit(True)))).otherwise(F.array(as_found))).alias("o")).select("o.*")


def with_extensions(found: DataFrame, reads: DataFrame) -> DataFrame:
    """found with ext: what t has beyond the overlap, read on from q."""
    seqs = reads.select(F.col("name").alias("t"), F.col("seq").alias("_seq"))
    turned = F.when(F.col("t_rc"), dna.reverse_complement("_seq")).otherwise(F.col("_seq"))
    return found.join(seqs, "t").withColumn("ext", turned.substr(F.col("length") + 1, F.length("_seq"))).drop("_seq")


def irreducible(found: DataFrame, reads: DataFrame) -> DataFrame:
    """found without the rows that follow from others: some longer overlap on the same side of q has an extension that begins t's.

    Reads must not stand within one another. Each row looks up, among the extensions on its side, the beginnings of
    its own whose length occurs there: no more of them than a read has bases, whatever the number of overlaps.
    """
    side = ["q", "q_rc"]
    rows = materialise(with_extensions(found, reads), "extensions")
    lengths = rows.groupBy(*side).agg(F.collect_set(F.length("ext")).alias("sizes")).where(F.size("sizes") > 1)
    tried = rows.join(lengths, side).select(*side, "t", "t_rc", "length", "ext", F.explode("sizes").alias("size")).where(F.col("size") < F.length("ext"))
    tried = tried.select(*side, "t", "t_rc", "length", F.left("ext", F.col("size")).alias("start"))
    there = rows.select(*side, F.col("ext").alias("start"), F.col("length").alias("longer")).groupBy(*side, "start").agg(F.max("longer").alias("longer"))
    gone = tried.join(there, [*side, "start"]).where(F.col("longer") > F.col("length")).select(*side, "t", "t_rc").distinct()
    return rows.drop("ext").join(gone, [*side, "t", "t_rc"], "left_anti")


def edges(found: DataFrame, reads: DataFrame) -> DataFrame:
    """(id0, id1, s0, e0, l0, s1, e1, l1, is_rc, num_diff) of rows whose q has the greater name; closed, from 0."""
    sizes = reads.select("name", F.length("seq").alias("size"))
    own = found.where((F.col("q") > F.col("t")))
    own = own.join(sizes.select(F.col("name").alias("q"), F.col("size").alias("l0")), "q").join(sizes.select(F.col("name").alias("t"), F.col("size").alias("l1")), "t")
    n = F.col("length")
    s0 = F.when(F.col("q_rc"), 0).otherwise(F.col("l0") - n)
    s1 = F.when(F.col("t_rc"), F.col("l1") - n).otherwise(0)
    return own.select(
        F.col("q").alias("id0"), F.col("t").alias("id1"), s0.alias("s0"), (s0 + n - 1).alias("e0"), "l0",
        s1.alias("s1"), (s1 + n - 1).alias("e1"), "l1", (F.col("q_rc") != F.col("t_rc")).cast("int").alias("is_rc"), F.lit(0).alias("num_diff"),
    )


def containments(reads: DataFrame) -> DataFrame:
    """(name, substring): 1 for reads that another read equals under a smaller name, or that stand within a longer one."""
    from .dedup import rmdup

    kept, dropped = rmdup(reads)
    return kept.select("name", F.lit(0).alias("substring")).union(dropped.select("name", F.lit(1).alias("substring")))


def string_graph(reads: DataFrame, min_overlap: int = MIN_OVERLAP, *, reduce: bool = True, both_strands: bool = True) -> DataFrame:
    """Edges of the overlap graph of reads without duplicates or contained reads."""
    found = overlaps(reads, min_overlap, both_strands=both_strands)
    return edges(irreducible(found, reads) if reduce else found, reads)
