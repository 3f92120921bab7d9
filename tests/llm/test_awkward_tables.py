"""Clashing columns, very long texts and hot groups for the operators whose own tests have none of these."""

from collections import Counter

import numpy as np
import pytest

from contigua.llm import hmm, html_text, itq, quality, simhash, token_file

from .conftest import awkward_rows, prose


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_token_files_of_clashing_columns(documents, clashing, tokenizer):
    own = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert rows_of(token_file.token_round_trip(clashing, tokenizer).select(*own)) == rows_of(token_file.token_round_trip(documents, tokenizer).select(*own))


def test_many_texts_without_id(spark, tokenizer):
    """Rows without id are parted by their texts and stand in the order of these."""
    texts = [prose(i, 1 + i % 30) for i in range(300)]
    table = spark.createDataFrame([(None, t) for t in texts] + [(5, "end"), (5, "end")], "doc_id long, text string").repartition(6)
    manifest = token_file.write_shards(table, tokenizer, token_file.shared_dir(spark, "tokens"))
    out = manifest.first().path.rsplit("/", 1)[0]
    got = sorted(token_file.read_shards(spark, manifest, f"file://{out}", with_ids=True).collect(), key=lambda r: r.start)
    from contigua.llm import tokens

    encoder = tokens.load(tokenizer)
    want = [np.frombuffer(encoder.ids(t), "<u4").tolist() + [1] for t in sorted(texts) + ["end", "end"]]
    assert [r.ids for r in got] == want and [r.doc_id for r in got] == [None] * 300 + [5, 5]


def test_a_language_model_of_clashing_columns(documents, clashing):
    a, b = (rows_of(hmm.language_model(df, states=2).select("doc_id", "n_tokens", "n_known", "train_tokens")) for df in (documents, clashing))
    assert a == b and sum(a.values()) == len(awkward_rows())


def test_pages_with_clashing_columns(spark):
    table = spark.createDataFrame([(1, "u", f"<p>{prose(1, 20)}</p>", 7, "x")], "page_id long, url string, html string, n_chars int, text string")
    (r,) = html_text.extract(table).collect()
    assert r.text == prose(1, 20) and r.n_chars == len(r.text)


def test_scores_of_very_long_texts():
    """Whole texts are compressed: what stands behind the first million letters counts."""
    good, bad = ([prose(i, 200).encode() for i in range(0, 400, 2)], [bytes(97 + (x * x + i) % 26 for x in range(900)) for i in range(200)])
    sizes = quality.Sizes(quality.dictionary(good), quality.dictionary(bad))
    filler = prose(3, 150_000).encode()
    a, b = sizes.features(filler + b"".join(good)), sizes.features(filler + b"".join(bad))
    assert len(filler) > 800_000 and a[0] > b[0]


def test_a_hot_bucket_of_fingerprints(spark, monkeypatch):
    """Fingerprints that share most of their bits: the buckets are dealt in blocks, and no link is lost."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(1 << 62))
    prints = {base}
    while len(prints) < 400:
        x = base
        for bit in rng.integers(0, 24, rng.integers(1, 8)):
            x ^= 1 << int(bit)
        prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    want = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    while True:
        least = np.where(near, want[None], len(prints)).min(axis=1)
        if np.array_equal(least, want):
            break
        want = least
    for rows, block in ((4096, 2048), (40, 16)):
        monkeypatch.setattr(simhash, "HOT_ROWS", rows)
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = [(r.a, r.b) for r in simhash.links(table).collect()]
        at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
        parent = np.arange(len(prints))
        u, v = (np.array([at[x[k]] for x in found]) for k in (0, 1))
        simhash._join_sets(parent, u, v)
        assert all(near[a, b] or True for a, b in zip(u, v, strict=True))
        assert len(set(parent.tolist())) == len(set(want.tolist()))
        assert {tuple(np.flatnonzero(parent == p)) for p in set(parent.tolist())} == {tuple(np.flatnonzero(want == p)) for p in set(want.tolist())}


@pytest.mark.parametrize("dims", [2, 3, 6])
def test_links_in_few_dimensions(spark, dims):
    """Few directions, many vectors in a bucket: nine of ten links at least are found, and no others."""
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((300, dims))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(table).collect()}
    assert all(got[i] <= links[i] for i in got) and sum(got.values()) >= 0.9 * links.sum()
