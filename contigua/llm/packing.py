"""Operator 6: best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the packing needs only how many pieces have each length. The driver
runs best-fit decreasing on that histogram (at most ``capacity`` entries, whatever the input): bins with the same
remaining capacity stand together as ranges, and a segment tree over remaining capacities finds the tightest open one
in logarithmic time. The outcome is a plan of ranges; executors give each piece its place by its rank among the pieces
of its length. No piece, text or bin is held by the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialise

CAPACITY = 4096
#: Pieces of one length are numbered in so many parts at least, and more where there are more than so many pieces for each.
RANK_BUCKETS, BUCKET_ROWS = 256, 500_000


class TightestFit:
    """Segment tree over remaining capacities 0..size: which of them have an open bin."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.tree = bytearray(2 * self.leaves)

    def set(self, remaining: int, is_open: bool) -> None:
        i = remaining + self.leaves
        self.tree[i] = is_open
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def at_least(self, length: int) -> int | None:
        """The smallest remaining capacity >= length that has an open bin."""
        i = length + self.leaves
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing: (length, first rank, first bin, pieces in a bin, offset in the bin) of each range.

    The result is that of placing pieces one by one in falling order of length, each in the open bin with the least
    remaining capacity that takes it: a bin of remaining r takes r // length pieces in a row, as it stays tightest.
    """
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    fit, bins, out = TightestFit(capacity), 0, []

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            if not open_bins[remaining]:
                fit.set(remaining, True)
            open_bins[remaining].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = fit.at_least(length)
            if room is None:
                room = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    fit.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:
                out.append((length, rank, first, left, capacity - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and its end id, cut only beyond capacity."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches):
        encoder, end = tokens.load(tokenizer), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    for col, value in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        col.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[: 5 + with_ids]
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=False)})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut, a table with a length column from 1 to capacity, with sequence_id and offset.

    Pieces of one length get their rank in two steps, so that a length which a third of all rows share is spread:
    counts by length and hash bucket give each bucket its first rank, and row numbers run within a bucket. Equal rows
    are interchangeable: any order among them gives the same rows.
    """
    own = cut.columns
    buckets = max(RANK_BUCKETS, cut.count() // BUCKET_ROWS)
    held = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32" if "ids_crc32" in own else "length"), F.lit(buckets)).cast("int"))
    counts = held.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).select("length", "_bucket", "_first")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    # Ranks of one length stay below 2**48, lengths below 2**15.
    starts = (rows[:, 0] << 48) | rows[:, 1]
    ranked = held.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", *(["ids_crc32"] if "ids_crc32" in own else []))) - 1)
    ranked = ranked.join(first, ["length", "_bucket"]).select(*own, (F.col("_first") + F.col("_in")).alias("_rank"))
    out = ranked.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("_rank").schema

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            at = rows[np.searchsorted(starts, (length << 48) | rank, side="right") - 1]
            k = rank - at[:, 1]
            named = {c: batch.column(batch.schema.get_field_index(c)) for c in own}
            yield pa.RecordBatch.from_pydict(named | {"sequence_id": pa.array(at[:, 2] + k // at[:, 3]), "offset": pa.array(at[:, 4] + k % at[:, 3] * length)})

    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **kinds) -> DataFrame:
    """docs packed: a row for each piece.

    Null text is empty: the end id alone. Repeated rows are packed each for itself. Null ids stay null. An empty table
    gives no rows. The pieces (numbers alone unless with_ids) are written to the shared folder, so texts are tokenised
    once.
    """
    return pack(materialise(pieces(docs, tokenizer, capacity, **kinds), "pieces"), capacity)
