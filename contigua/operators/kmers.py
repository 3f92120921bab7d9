"""k-mers of reads: counts, spectrum, windows, solid positions."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.storage import materialise


def windows(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """(*keep, pos, kmer) for every window of every read; pos counts from 0. Shorter reads have none."""
    own = reads.where(F.length("seq") >= k)
    return own.select(*keep, "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("pos")).select(*keep, "pos", F.col("seq").substr(F.col("pos") + 1, F.lit(k)).alias("kmer"))


#: So many bases fit in a long.
PACKED = 31
_CODE = np.full(256, 4, np.int64)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _packed_counts(column: pa.Array, k: int, both_strands: bool) -> pa.RecordBatch:
    """(code, other, n) of the windows of a batch of sequences, summed: code has two bits a base; other is a window with other letters."""
    raw, offsets = dna._flat(column)
    base = _CODE[raw]
    n = len(base) - k + 1
    codes, others = np.zeros(0, np.int64), []
    if n > 0:
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        whole = owner[:n] == owner[k - 1 :]
        odd = np.concatenate(([0], np.cumsum(base == 4)))
        plain = whole & (odd[k:] == odd[:n])
        code, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
        two = base & 3
        for i in range(k):
            code = code << 2 | two[i : i + n]
            if both_strands:
                back |= (3 - two[i : i + n]) << (2 * i)
        codes = np.concatenate((code[plain], back[plain])) if both_strands else code[plain]
        for i in np.flatnonzero(whole & ~plain):
            text = raw[i : i + k].tobytes().decode()
            others += [text, text.translate(_TURN)[::-1]] if both_strands else [text]
    found, times = np.unique(codes, return_counts=True)
    held = Counter(others)
    return pa.RecordBatch.from_pydict({
        "code": pa.array(np.concatenate((found, np.full(len(held), -1)))),
        "other": pa.array([None] * len(found) + list(held), pa.string()),
        "n": pa.array(np.concatenate((times, np.array(list(held.values()), np.int64)))),
    })


_TURN = str.maketrans("ACGT", "TGCA")


def packed_counts(reads: DataFrame, k: int, *, both_strands: bool = False) -> DataFrame:
    """(code, other, n): counts() of k up to PACKED with k-mers as numbers; other holds those with letters beyond ACGT.

    Short k-mers are summed batch by batch, so that what is shuffled is a number and a count for each that a batch has.
    Longer ones are shuffled as the pieces of reads that they stand in, a row for some windows.
    """

    def run(batches):
        for batch in batches:
            yield _packed_counts(batch.column(0), k, both_strands)

    if k >= LEAST_PIECED:
        own = reads.select(F.explode(F.array("seq", dna.reverse_complement("seq"))).alias("seq")) if both_strands else reads
        return _in_buckets(_pieces(own, k), k, "code long, other string, n long")
    found = reads.select("seq").mapInArrow(run, "code long, other string, n long")
    return found.groupBy("code", "other").agg(F.sum("n").alias("n"))


#: Windows of so many bases or more go by pieces: runs of windows with the same least part of PART bases, in a mixed order.
LEAST_PIECED, PART, BUCKETS = 20, 11, 1 << 16
#: Windows that a task unpacks at once, if no bucket has more.
_AT_ONCE = 1 << 21


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _words(two: np.ndarray) -> np.ndarray:
    """The 32 bases from each place on, two bits each, the first in the highest; past the end A."""
    out, step = two.astype(np.uint64), 1
    while step < 32:
        longer = out << np.uint64(2 * step)
        longer[:-step] |= out[step:]
        out, step = longer, 2 * step
    return out


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    step = 1
    while 2 * step <= w:
        x, step = np.minimum(x[: len(x) - step], x[step:]), 2 * step
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def _upto(bases: np.ndarray) -> np.ndarray:
    """Masks of the first so many bases of a word, between none and 32."""
    n = np.clip(bases, 0, 32).astype(np.uint64)
    return np.where(n > 0, ~np.uint64(0) << (np.uint64(64) - np.uint64(2) * np.maximum(n, 1).astype(np.uint64)), np.uint64(0))


def _turned(x: np.ndarray) -> np.ndarray:
    """Words read on the other strand: what was last is first."""
    x = ~x.byteswap()
    for n, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        x = ((x >> np.uint64(n)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(n))
    return x


def _width(k: int) -> int:
    """Words of the longest piece."""
    return -(-(k + k - PART) // 32)


def _bucket(text: str) -> int:
    """That of a window with letters beyond ACGT, on either strand."""
    return -1 - crc32(min(text, text.translate(_TURN)[::-1]).encode()) % BUCKETS


def _cut(column: pa.Array, k: int) -> tuple:
    """(bucket, size, start, words) of the pieces of a batch of sequences, size windows from each start, and the other windows."""
    raw, offsets = dna._flat(column)
    base = _CODE[raw]
    n, w = len(base) - k + 1, k - PART + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, _width(k)), np.uint64), []
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[:n] == owner[k - 1 :]
    odd = np.concatenate(([0], np.cumsum(base == 4)))
    plain = whole & (odd[k:] == odd[:n])
    words = _words(base & 3)
    part = words[: len(base) - PART + 1]
    turned = _turned(part & _upto(np.array([PART]))) & np.uint64((1 << 2 * PART) - 1)
    least = _least(np.minimum(_mixed(part >> np.uint64(64 - 2 * PART)), _mixed(turned)), w)
    there = np.flatnonzero(plain)
    first = np.ones(len(there), bool)
    first[1:] = (np.diff(there) != 1) | (least[there[1:]] != least[there[:-1]])
    run = np.flatnonzero(first)
    # A part that comes again makes a longer run: it is cut.
    within = np.arange(len(there)) - np.repeat(run, np.diff(np.append(run, len(there))))
    begin = np.flatnonzero(within % w == 0)
    size, start = np.diff(np.append(begin, len(there))), there[begin]
    ahead = np.concatenate((words, np.zeros(32 * _width(k), np.uint64)))
    packed = np.stack([ahead[start + 32 * j] & _upto(size + k - 1 - 32 * j) for j in range(_width(k))], 1)
    return (least[start] & np.uint64(BUCKETS - 1)).astype(np.int32), size, start, packed, [raw[i : i + k].tobytes().decode() for i in np.flatnonzero(whole & ~plain)]


_PIECE = "bucket int, size int, packed binary, text string, n long"


def _rows(bucket, size, packed: np.ndarray, text: list, n) -> pa.RecordBatch:
    held = pa.py_buffer(np.ascontiguousarray(packed))
    at = pa.py_buffer(np.arange(0, packed.nbytes + 1, 8 * packed.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(size, pa.int32()), pa.Array.from_buffers(pa.binary(), len(packed), [None, at, held]), pa.array(text, pa.string()), pa.array(n, pa.int64())], ["bucket", "size", "packed", "text", "n"])


def _pieces(reads: DataFrame, k: int) -> DataFrame:
    """The reads' pieces for k, equal ones of a batch once with their number; windows with letters beyond ACGT as text."""

    def run(batches):
        for batch in batches:
            bucket, size, _, packed, others = _cut(batch.column(0), k)
            key = _mixed(size.astype(np.uint64))
            for word in packed.T:
                key = _mixed(key ^ word)
            order = np.argsort(key)
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(key[order]) != 0) | (np.diff(size[order]) != 0) | (packed[order[1:]] != packed[order[:-1]]).any(1)
            one = order[new]
            times = np.diff(np.append(np.flatnonzero(new), len(order)))
            held = Counter(others)
            yield _rows(bucket[one], size[one], packed[one], [None] * len(one), times)
            if held:
                yield _rows([_bucket(t) for t in held], [0] * len(held), np.zeros((len(held), _width(k)), np.uint64), list(held), list(held.values()))

    return reads.select("seq").mapInArrow(run, _PIECE)


def _asked(texts: DataFrame, k: int) -> DataFrame:
    """Rows as those of pieces, with tag, for (seq, tag) of k letters each; n is 0."""

    def run(batches):
        for batch in batches:
            bucket, _, start, _, others = _cut(batch.column(0), k)
            own = np.full(batch.num_rows, 0, np.int32)
            own[start // k] = bucket
            odd = np.ones(batch.num_rows, bool)
            odd[start // k] = False
            own[odd] = [_bucket(t) for t in others]
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0), batch.column(1)], ["bucket", "text", "tag"])

    kind = texts.schema["tag"].dataType.simpleString()
    found = texts.select("seq", "tag").mapInArrow(run, f"bucket int, text string, tag {kind}")
    return found.select("bucket", F.lit(0).alias("size"), F.lit(None).cast("binary").alias("packed"), "text", F.lit(0).cast("long").alias("n"), "tag")


def _summed(rows: pa.Table, k: int, asked: bool, both_strands: bool) -> pa.RecordBatch:
    """(code, other, n) of all windows of rows, or (seq, tag, n) of those that are asked for."""
    size, times = rows["size"].to_numpy().astype(np.int64), rows["n"].to_numpy()
    text = rows["text"].combine_chunks()
    held = np.flatnonzero(size)
    whole = rows["packed"].combine_chunks()
    at = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole)] if len(whole) else np.zeros(0, np.int32)
    packed = np.zeros((0, _width(k)), np.uint64)
    if len(held):
        # Rows without a piece have no bytes, or some that are passed over.
        packed = np.frombuffer(whole.buffers()[2], np.uint8)[at[held, None] + np.arange(8 * _width(k))].view(np.uint64)
    size, times_of = size[held], times[held]
    texts = np.flatnonzero(times == 0)
    there = np.zeros(0, np.int64)
    if len(texts):
        _, _, start, more, _ = _cut(text.take(pa.array(texts)), k)
        there = texts[start // k]
        packed, size, times_of = np.concatenate((packed, more)), np.concatenate((size, np.ones(len(more), np.int64))), np.concatenate((times_of, np.zeros(len(more), np.int64)))
    ahead = np.concatenate((packed, np.zeros((len(packed), 2), np.uint64)), 1)
    owner = np.repeat(np.arange(len(packed)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)

    def bases(j):
        """The 32 bases from the j-th of each window on."""
        word, shift = (place + j) >> 5, (2 * ((place + j) & 31)).astype(np.uint64)
        right = np.where(shift > 0, ahead[owner, word + 1] >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (ahead[owner, word] << shift) | right

    first_of = lambda x, n: x & _upto(np.array([n]))
    forth = [first_of(bases(32 * j), k - 32 * j) for j in range(-(-k // 32))]
    if k <= PACKED and not both_strands:
        a = b = forth[0] >> np.uint64(64 - 2 * k)
    else:
        a = b = np.zeros(len(owner), np.uint64)
        for x in forth:
            a, b = _mixed(a ^ x, 1), _mixed(b ^ x, 2)
    weight = times_of[owner]
    if both_strands:
        c = d = np.zeros(len(owner), np.uint64)
        for left in range(k, 0, -32):
            x = _turned(bases(left - 32)) if left >= 32 else _turned(first_of(bases(0), left)) << np.uint64(2 * (32 - left))
            c, d = _mixed(c ^ x, 1), _mixed(d ^ x, 2)
        # What reads the same on both strands stands on both.
        weight = np.where((a == c) & (b == d), 2 * weight, weight)
        own = (a < c) | ((a == c) & (b <= d))
        a, b = np.where(own, a, c), np.where(own, b, d)
    order = np.argsort(a)
    if a is not b and ((np.diff(a[order]) == 0) & (np.diff(b[order]) != 0)).any():
        order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    first = np.flatnonzero(new)
    total = np.add.reduceat(weight[order], first) if len(order) else np.zeros(0, np.int64)
    odd, plain = Counter(), np.zeros(len(times), bool)
    plain[held], plain[there] = True, True
    for i in np.flatnonzero(~plain):
        t = text[i].as_py()
        odd[t] += int(times[i])
    if not asked:
        code = np.concatenate((a[order][first].astype(np.int64), np.full(len(odd), -1)))
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array([None] * len(first) + list(odd), pa.string()), pa.array(np.concatenate((total, np.array(list(odd.values()), np.int64))), pa.int64())], ["code", "other", "n"])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    n = np.zeros(len(times), np.int64)
    n[there] = total[of[len(order) - len(there) :]]
    for i in np.flatnonzero(~plain & (times == 0)):
        t = text[i].as_py()
        n[i] = odd[t] + (odd[t.translate(_TURN)[::-1]] if both_strands else 0)
    told = pa.array(texts)
    return pa.RecordBatch.from_arrays([text.take(told), rows["tag"].combine_chunks().take(told), pa.array(n[texts])], ["seq", "tag", "n"])


def _in_buckets(rows: DataFrame, k: int, kind: str, asked: bool = False, both_strands: bool = False) -> DataFrame:
    """What _summed() tells of pieces. Equal windows are in one bucket; a task holds some buckets at a time, or one large one."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += int(batch.column(1).to_numpy().sum()) + batch.num_rows
            bucket = batch.column(0)
            if n < _AT_ONCE or held[0].column(0)[0].equals(bucket[-1]):
                continue
            whole = pa.Table.from_batches(held)
            upto = int(np.searchsorted(whole["bucket"].to_numpy(), bucket[-1].as_py()))
            yield _summed(whole.slice(0, upto), k, asked, both_strands)
            held = whole.slice(upto).combine_chunks().to_batches()
            n = sum(int(b.column(1).to_numpy().sum()) + b.num_rows for b in held)
        if held:
            yield _summed(pa.Table.from_batches(held), k, asked, both_strands)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, kind)


def found(texts: DataFrame, reads: DataFrame, k: int, *, both_strands: bool = False) -> DataFrame:
    """(seq, tag, n): how often each of the texts (seq, tag), all of k letters, stands in the reads, by 128 bits of it.

    Windows of the reads and texts meet in buckets, the same for both strands: reads are shuffled in pieces, not a row
    for each window, and texts once. Letters are ASCII.
    """
    kind = texts.schema["tag"].dataType.simpleString()
    rows = _pieces(reads, k).withColumn("tag", F.lit(None).cast(kind)).union(_asked(texts, k))
    return _in_buckets(rows, k, f"seq string, tag {kind}, n long", True, both_strands)


def unpacked(code: Column, k: int) -> Column:
    """The bases of a packed k-mer."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def counts(reads: DataFrame, k: int, *, both_strands: bool = False) -> DataFrame:
    """(kmer, n) over all reads. both_strands adds each read's reverse complement; by default as written only."""
    if 0 < k <= PACKED:
        found = packed_counts(reads, k, both_strands=both_strands)
        return found.select(F.coalesce("other", unpacked(F.col("code"), k)).alias("kmer"), "n")
    found = windows(reads, k)
    if both_strands:
        found = found.select(F.explode(F.array("kmer", dna.reverse_complement("kmer"))).alias("kmer"))
    return found.groupBy("kmer").agg(F.count("*").alias("n"))


def hashed(text: Column) -> Column:
    """128 bits that stand for a text where only equality counts."""
    return F.struct(F.xxhash64(text, F.lit(1)).alias("a"), F.xxhash64(text, F.lit(2)).alias("b"))


def hashed_counts(reads: DataFrame, k: int) -> DataFrame:
    """(hash, n): how often each window of k bases stands in the reads, by hashed()."""
    return windows(reads, k).groupBy(hashed(F.col("kmer")).alias("hash")).agg(F.count("*").alias("n"))


def spectrum(counted: DataFrame) -> DataFrame:
    """(n, n_kmers): how many k-mers occur n times."""
    return counted.groupBy("n").agg(F.count("*").alias("n_kmers"))


def required(phred: Column, threshold: int) -> Column:
    """Occurrences that make a k-mer solid: one more than the threshold where its bases are sure."""
    return F.when(phred >= 20, threshold + 1).otherwise(threshold)


def scored_windows(reads: DataFrame, counted: DataFrame, k: int, threshold: int, *keep: str) -> DataFrame:
    """(*keep, pos, kmer, min_phred, n, solid) of every window."""
    phred = F.when(F.col("quality").isNull(), F.transform(F.split("seq", ""), lambda _: F.lit(dna.DEFAULT_PHRED))).otherwise(dna.phreds("quality"))
    cut = reads.where(F.length("seq") >= k).select(*keep, "seq", phred.alias("_q"), F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("pos"))
    cut = cut.select(*keep, "pos", F.col("seq").substr(F.col("pos") + 1, F.lit(k)).alias("kmer"), F.array_min(F.slice("_q", F.col("pos") + 1, k)).alias("min_phred"))
    found = cut.join(counted, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return found.select(*keep, "pos", "kmer", "min_phred", "n", (F.col("n") >= required(F.col("min_phred"), threshold)).alias("solid"))


def solid_masks(reads: DataFrame, counted: DataFrame, k: int, threshold: int) -> DataFrame:
    """(read_idx, mask): 1 where a solid k-mer covers the base, else 0; reads without any window are left out.

    A read has no more windows than bases: what is gathered for a read stays as small as the read.
    """
    found = scored_windows(reads, counted, k, threshold, "read_idx")
    flags = found.groupBy("read_idx").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("solid").cast("int").cast("string").alias("flag")))).alias("f"))
    flags = flags.select("read_idx", F.array_join("f.flag", "").alias("flags"))
    # A base is covered if one of the windows that start up to k - 1 bases before it, or at it, is solid.
    windows_of = lambda i: F.col("flags").substr(F.greatest(i - k + 2, F.lit(1)), F.least(i + 1, F.lit(k)))
    covered = F.transform(F.sequence(F.lit(0), F.length("flags") + k - 2), lambda i: F.contains(windows_of(i), F.lit("1")).cast("int").cast("string"))
    return flags.select("read_idx", F.array_join(covered, "").alias("mask"))


def genome_size(counted: DataFrame) -> DataFrame:
    """(k, depth, size): the commonest count above 1 is the depth, and all occurrences over it the size; 0 if there is none.

    What k-mers there are is counted once, in a table of a row for each count.
    """
    many = materialise(counted.groupBy("n", F.length("kmer").alias("k")).agg(F.count("*").alias("n_kmers")), "spectrum")
    k = many.agg(F.max("k").alias("k"), F.coalesce(F.sum(F.col("n") * F.col("n_kmers")), F.lit(0)).alias("total"))
    depth = many.where("n > 1").groupBy("n").agg(F.sum("n_kmers").alias("n_kmers")).agg(F.max_by("n", F.struct("n_kmers", -F.col("n"))).alias("depth"))
    return k.crossJoin(depth).select("k", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce(F.expr("total div depth"), F.lit(0)).cast("long").alias("size"))


def error_positions(masks: DataFrame) -> DataFrame:
    """(read_idx, pos) of every base that no solid k-mer covers."""
    return masks.select("read_idx", F.posexplode(F.split("mask", "")).alias("pos", "c")).where("c = '0'").select("read_idx", "pos")


def best_per_read(found: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("read_idx").orderBy(*order)
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
