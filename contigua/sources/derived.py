"""Reads derived from a table of texts, so that every operator runs on data that is at hand.

Letters become bases by their rank in the alphabet, all else is dropped; whole texts are tiled by reads of LENGTH
bases every STRIDE. Names pair neighbouring tiles, qualities and barcodes are functions of the place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import _flat

LENGTH, STRIDE = 100, 40
LETTERS = "".join(chr(a + i) for a in (97, 65) for i in range(26))
BASES = "".join("ACGT"[i % 4] for _ in range(2) for i in range(26))
#: A rule for qualities: mostly good, worse at odd stretches; a read takes LENGTH of them from some place on.
QUALITIES = "".join(chr(33 + (2 if i * i % 23 == 2 else 20 + i * 7 % 20)) for i in range(LENGTH + 97))


def dna(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, LETTERS, BASES), "[^ACGT]", "")


#: The base that a byte of a text becomes; 0 for bytes that are dropped.
_BASE = np.zeros(256, np.uint8)
_BASE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.frombuffer(BASES.encode(), np.uint8)
#: Texts are cut by so many bytes at a time, tiles told by so many.
_TEXT_BYTES, _TILES = 1 << 22, 1 << 16


def _tiles(batch: pa.RecordBatch):
    """Batches (doc_id, source, k, seq): the tiles of a batch (doc_id, source, text) of texts."""
    raw, at = _flat(batch.column(2))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _TEXT_BYTES, "right")) - 1)
        base = _BASE[raw[at[first] : at[last]]]
        kept = base != 0
        upto = np.concatenate(([0], np.cumsum(kept)))[at[first : last + 1] - at[first]]
        base = base[kept]
        count = np.maximum((np.diff(upto) - LENGTH) // STRIDE + 1, 0)
        owner = np.repeat(np.arange(last - first), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = upto[owner] + k * STRIDE
        for i in range(0, len(owner), _TILES):
            own = slice(i, i + _TILES)
            held = base[start[own, None] + np.arange(LENGTH)]
            seq = pa.Array.from_buffers(pa.string(), len(held), [None, pa.py_buffer(np.arange(0, held.size + 1, LENGTH, dtype=np.int32)), pa.py_buffer(held)])
            told = pa.array(first + owner[own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(told), batch.column(1).take(told), pa.array(k[own], pa.int32()), seq], ["doc_id", "source", "k", "seq"])
        first = last


def reads(documents: DataFrame) -> DataFrame:
    """(read_idx, name, seq, quality, comment, barcode): every tile of every text; short texts give none.

    Texts are cut as bytes, batch by batch: a tile's row never holds its text, and work follows the texts' length.
    """

    def cut(batches):
        for batch in batches:
            yield from _tiles(batch)

    tiles = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, source string, k int, seq string")
    return tiles.select(
        (F.col("doc_id") * 1_000_000 + F.col("k")).alias("read_idx"),
        F.concat(F.lit("d"), "doc_id", F.lit("."), F.expr("k div 2"), F.lit("/"), F.col("k") % 2 + 1).alias("name"),
        "seq",
        F.lit(QUALITIES).substr((1 + (F.col("doc_id") * 7 + F.col("k") * 3) % 97).cast("int"), F.lit(LENGTH)).alias("quality"),
        F.lit(None).cast("string").alias("comment"),
        F.coalesce("source", F.lit("")).alias("barcode"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of texts; one that is read in fewer parts than there are cores is dealt out."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    cores = spark.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(4 * cores)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(documents(spark, sf_dir))


SQL = f"""
dna as (select doc_id, source, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') s from documents),
reads as (
  select doc_id * 1000000 + k as read_idx, 'd' || doc_id || '.' || (k // 2) || '/' || (k % 2 + 1) as name,
         substr(s, cast(1 + k * {STRIDE} as int), {LENGTH}) as seq,
         substr('{QUALITIES.replace("'", "''")}', cast(1 + (doc_id * 7 + k * 3) % 97 as int), {LENGTH}) as quality,
         coalesce(source, '') as barcode, doc_id, k
  from (select *, unnest(generate_series(0, (length(s) - {LENGTH}) // {STRIDE})) k from dna where length(s) >= {LENGTH}))
"""
