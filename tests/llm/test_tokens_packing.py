import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contigua.llm import packing, token_file, tokens
from contigua.llm.common import shared_dir

from .conftest import awkward_rows, prose


def expected(tokenizer):
    library = Tokenizer.from_file(tokenizer)
    rows = sorted(((r[0], r[1] or "") for r in awkward_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_equals_the_library(documents, tokenizer):
    got = token_file.token_round_trip(documents, tokenizer).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(tokenizer), key=str)


def test_ids_read_back_and_select(spark, documents, tokenizer):
    out = shared_dir(spark, "t")
    manifest = token_file.write_shards(documents, tokenizer, out)
    rows = token_file.read_shards(spark, manifest, out, with_ids=True).collect()
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in rows)
    for m in manifest.collect():
        shard = token_file.Shard(out, m.path)
        total = 0
        for i in range(shard.n_docs):
            assert shard.bounds.select(i) == total
            total += len(shard.document(i))
        assert total == shard.n_ids


def test_many_small_shards_cost_few_files(spark, tokenizer):
    """The manifest is no table of a file for each shard, and small shards share reading tasks, whose results are files."""
    settings_for_many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_for_many}
    try:
        for k, v in settings_for_many.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame([(i, prose(i, 1 + i % 9)) for i in range(300)], "doc_id long, text string")
        out = shared_dir(spark, "t")
        manifest = token_file.write_shards(docs, tokenizer, out)
        read = token_file.read_shards(spark, manifest, out)
        rows = sorted(read.collect(), key=lambda r: r.doc_id)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert manifest.count() > 20 and not manifest.inputFiles()
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    library, start = Tokenizer.from_file(tokenizer), 0
    for i, r in enumerate(rows):
        ids = [*library.encode(prose(i, 1 + i % 9), add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == 300


def test_no_documents(no_documents, tokenizer):
    assert token_file.token_round_trip(no_documents, tokenizer).count() == 0
    assert packing.pack_documents(no_documents, tokenizer).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(0, 399), st.integers(0, 60))
def test_elias_fano(gaps, first, count):
    values = np.cumsum(np.array(gaps, np.int64)) if gaps else np.zeros(0, np.int64)
    coded = token_file.EliasFano.encode(values)
    first = min(first, len(values))
    count = min(count, len(values) - first)
    assert coded.slice(first, count).tolist() == values[first : first + count].tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_words_apart_equal_whole_text(text):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokens.load(path)
    assert np.frombuffer(own.ids(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_tokenizer_that_keeps_white_space_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokens.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def one_by_one(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits, key=lambda b: b[0])[0] -= n
        else:
            bins.append([capacity - n])
    return sorted(b[0] for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    left, ranks = {}, {}
    rows = packing.plan(histogram, capacity)
    for i, (length, rank, first, each, offset) in enumerate(rows):
        following = [r[1] for r in rows[i + 1 :] if r[0] == length][:1]
        end = following[0] if following else histogram[length]
        assert rank == ranks.get(length, 0)
        ranks[length] = end
        for k in range(end - rank):
            b, at = first + k // each, offset + k % each * length
            assert at == left.get(b, 0)
            left[b] = at + length
    assert ranks == histogram
    assert all(n <= capacity for n in left.values())
    assert sorted(capacity - n for n in left.values()) == one_by_one(lengths, capacity)


def test_packed_documents(documents, clashing, tokenizer):
    for table in (documents, clashing):
        rows = packing.pack_documents(table, tokenizer, 64).collect()
        places = {}
        for r in rows:
            assert 1 <= r.length <= 64
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in places.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= 64
        assert sum(r.length for r in rows) == sum(n for _, _, n, _ in expected(tokenizer))
        assert all(r.length == 64 or r.start + r.length == max(x.start + x.length for x in rows if x.doc_id == r.doc_id) for r in rows if r.doc_id not in (None, 53))


def test_tightest_fit():
    rng = random.Random(3)
    fit, there = packing.TightestFit(100), set()
    for _ in range(2000):
        n = rng.randint(1, 100)
        (there.discard if n in there else there.add)(n)
        fit.set(n, n in there)
        asked = rng.randint(1, 100)
        assert fit.at_least(asked) == min((x for x in there if x >= asked), default=None)
