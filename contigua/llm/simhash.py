"""Operator 3: SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are a ring of five segments. If two fingerprints differ in at most four bits, then from some
segment on every chain of consecutive segments stays within its proportional share of the four: none in the first,
one in the first two, two in three, three in four (pigeonring principle). The first two budgets are the key of an
equi-join: a fingerprint is filed under its first two segments, and under those with one set bit of the second
cleared. The longer chains prune the rows of a bucket before the full Hamming distance is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aligned, components, materialise

SHINGLE = 4
MAX_BITS = 4
#: Segment i covers bits SHIFTS[i] to SHIFTS[i] + WIDTHS[i] - 1.
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = (0, 13, 26, 39, 52)
#: Bits of a key: the segment's number and two segments.
KEY_BITS = 29
#: A bucket holds at most so many rows, or is dealt in blocks; a fixed size, whatever the input.
HOT_ROWS, BLOCK = 4096, 2048

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a UTF-8 text, of which A-Z are lower-cased; repeated shingles count again.

    bytes.lower() and bytes.split() know ASCII only, which is what the contract asks for. Fewer words than a shingle
    are one shingle; no word gives 0.
    """
    words = raw.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    text = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(text, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate(([0], ends[: n - 1])).tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(text[a:b], 42) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)]), np.uint8).reshape(n, 8)
    if n < 128:
        ones = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text has no words."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(np.array(prints, np.uint64).view(np.int64))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _segment(x: np.ndarray, i: int) -> np.ndarray:
    return (x >> np.uint64(SHIFTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def _keys(x: np.ndarray, i: int, second: np.ndarray) -> np.ndarray:
    return ((np.uint64(i) << np.uint64(26)) | (_segment(x, i) << np.uint64(13)) | second).astype(np.int64)


def exact_keys(x: np.ndarray) -> np.ndarray:
    """The five keys of each fingerprint: segment number, that segment, the next one."""
    return np.concatenate([_keys(x, i, _segment(x, (i + 1) % 5)) for i in range(5)])


def all_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows: the exact keys, and those with one set bit of the second segment cleared."""
    keys, own = [exact_keys(x)], [np.tile(x, 5)]
    for i in range(5):
        second = _segment(x, (i + 1) % 5)
        for bit in range(WIDTHS[(i + 1) % 5]):
            has = (second >> np.uint64(bit)) & np.uint64(1) == 1
            keys.append(_keys(x[has], i, second[has] ^ np.uint64(1 << bit)))
            own.append(x[has])
    return np.concatenate(keys), np.concatenate(own)


def _join_sets(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the sets of u[k] and v[k], for all k; parents are always roots between calls."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return
        u, v = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(parent, v, u)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def bucket_links(keys: np.ndarray, prints: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, its smallest fellow) within the buckets of a table sorted by key.

    All pairs of a bucket are looked at, at one distance in the table after another; what is kept and returned are
    sets, not pairs, so memory and output follow the rows.
    """
    own, at = np.unique(prints, return_inverse=True)
    parent = np.arange(len(own))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    left = np.repeat(np.append(first[1:], len(keys)), np.diff(np.append(first, len(keys)))) - np.arange(len(keys))
    chain = (keys >> 26) & 7
    masks = np.zeros((5, 2), np.uint64)
    for i in range(5):
        for k, n in enumerate((3, 4)):
            masks[i, k] = sum(((1 << WIDTHS[(i + j) % 5]) - 1) << SHIFTS[(i + j) % 5] for j in range(n))
    rows, us, vs, held, step = np.flatnonzero(left > 1), [], [], 0, 1
    while len(rows):
        x = prints[rows] ^ prints[rows + step]
        near = np.bitwise_count(x & masks[chain[rows], 0]) <= max_bits * 3 // 5
        near &= np.bitwise_count(x & masks[chain[rows], 1]) <= max_bits * 4 // 5
        near &= x != 0
        hit = np.flatnonzero(near)
        hit = hit[np.bitwise_count(x[hit]) <= max_bits]
        if len(hit):
            us.append(at[rows[hit]])
            vs.append(at[rows[hit] + step])
            held += len(hit)
        if held > 1_000_000:
            _join_sets(parent, np.concatenate(us), np.concatenate(vs))
            us, vs, held = [], [], 0
        step += 1
        rows = rows[left[rows] > step]
    if us:
        _join_sets(parent, np.concatenate(us), np.concatenate(vs))
    moved = parent != np.arange(len(own))
    return own[moved], own[parent[moved]]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy()


def hot_buckets(distinct: DataFrame) -> DataFrame:
    """(key, blocks): the buckets that may hold more than HOT_ROWS rows, and in how many blocks they are dealt.

    A bucket's rows come from its own exact key and from at most 13 others that have one bit more. Where none of these
    has more than a 14th of HOT_ROWS the bucket is small; all others are told, with their rows counted from above.
    """
    least = HOT_ROWS // (1 + max(WIDTHS))

    def to_keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": exact_keys(_numbers(batch, "fp").view(np.uint64))})

    def to_buckets(batches):
        for batch in batches:
            key, n = _numbers(batch, "key"), _numbers(batch, "n")
            keys, counts = [key], [n]
            for bit in range(max(WIDTHS)):
                has = (key >> bit) & 1 == 1
                keys.append(key[has] ^ (1 << bit))
                counts.append(n[has])
            yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "n": np.concatenate(counts)})

    warm = distinct.select("fp").mapInArrow(to_keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least)
    sums = warm.mapInArrow(to_buckets, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return sums.select("key", F.ceil((F.col("n") + HOT_ROWS) / BLOCK).cast("long").alias("blocks"))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints of distinct (fp), enough to connect all that are within 4 bits.

    A bucket that holds too many is dealt in blocks, every two of which meet in a task of their own. Rows learn by a
    join whether their bucket is one of these.
    """

    def to_rows(batches):
        for batch in batches:
            keys, own = all_keys(_numbers(batch, "fp").view(np.uint64))
            yield pa.RecordBatch.from_pydict({"key": keys, "fp": own.view(np.int64)})

    def to_links(batches):
        for part in aligned(batches, "key"):
            a, b = bucket_links(part.column("key").to_numpy(), part.column("fp").to_numpy().view(np.uint64))
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = distinct.select("fp").mapInArrow(to_rows, "key long, fp long")
    hot = materialise(hot_buckets(distinct), "simhash-hot", distinct.count() // 4)
    if hot.limit(1).count():
        rows = dealt(rows, hot, F.xxhash64("fp")).select(F.col("key").bitwiseOR(F.shiftleft("pair", KEY_BITS)).alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(to_links, "a long, b long")


def dealt(rows: DataFrame, hot: DataFrame, spread: Column) -> DataFrame:
    """rows (key, ...) with block and pair; those of a hot key (key, blocks) stand once for each pair of blocks that has theirs.

    Blocks are dealt by the hash ``spread``; pairs are numbered from 1 on, 0 for a bucket that isn't dealt.
    """
    own = rows.columns
    met = rows.join(hot, "key", "left").withColumn("block", F.pmod(spread, F.coalesce("blocks", F.lit(1).cast("long"))))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = met.withColumn("_other", F.explode(others))
    high = F.greatest("block", "_other")
    pair = F.when(F.col("_other") < 0, F.lit(0)).otherwise(1 + F.floor(high * (high + 1) / 2) + F.least("block", "_other"))
    return met.withColumn("pair", pair.cast("long")).select(*own, "block", "pair")


def near_duplicates(docs: DataFrame, **kinds) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprints link at MAX_BITS differing bits or fewer.

    component_id is the smallest id that links reach, null only if all of them are null. Repeated rows give repeated
    rows; null and wordless texts have fingerprint zero and link like any other; an empty table gives no rows.
    Fingerprints are written to the shared folder, so a text is hashed once.
    """
    prints = materialise(fingerprints(docs, **kinds), "simhash")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes", prints.count())
    linked = components(links(classes))
    named = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    n = classes.count()
    named = materialise(named, "simhash-named", n)
    # Written, so that Spark can split the partition of a giant component in the join.
    smallest = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-smallest", n)
    of_print = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **kinds) -> DataFrame:
    """docs with one row of each component: the one with the smallest id; of rows with that same id, one stays.

    Rows without id stay only where no row of their component has one, and then one of each fingerprint.
    """
    found = materialise(near_duplicates(docs, **kinds), "simhash-found")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    own = docs.columns
    held = docs.toDF(*[f"c_{i}" for i in range(len(own))])
    key = f"c_{own.index('doc_id')}"
    with_id = held.join(kept, F.col(key) == F.col("_kept"), "left_semi").dropDuplicates([key])
    nameless = held.where(F.col(key).isNull())
    if found.where("doc_id is null and component_id is null").limit(1).count():
        # Only wholly nameless components keep a row; there are as many texts to compare as such rows.
        text = f"c_{own.index('text')}"
        alone = found.where("component_id is null").select(F.col("fingerprint").alias("_print")).distinct()
        prints = fingerprints(nameless.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("doc_id"), F.col(text).alias("text")))
        chosen = prints.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("_print")).join(alone, "_print", "left_semi").groupBy("_print").agg(F.min("doc_id").alias("_hash"))
        nameless = nameless.withColumn("_hash", F.xxhash64(F.coalesce(text, F.lit("")))).join(chosen.select("_hash"), "_hash", "left_semi").dropDuplicates(["_hash"]).drop("_hash")
        with_id = with_id.union(nameless.select(*held.columns))
    return with_id.toDF(*own)
