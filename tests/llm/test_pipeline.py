import corpus_pipeline
from contigua.llm import mixing, packing, quality, simhash

from .conftest import prose


def write(spark, folder):
    docs, labels = [], []
    for i in range(240):
        text = prose(i // 2 if i % 8 == 1 else i, 90)
        bad = i % 5 == 0
        docs.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_run_equals_the_operators_by_hand(spark, tmp_path):
    docs = write(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    sizes = quality.Sizes(model.good, model.bad)
    good = [d for d in docs if model.score(sizes.features(d[1].encode())) >= 0.5]
    assert {d[0] for d in good} == {d[0] for d in docs if d[0] % 5}
    prints = {d[0]: simhash.fingerprint(d[1].encode()) for d in good}
    near = lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4
    one = []
    for d in sorted(good):
        reached, grown = {d[0]}, True
        while grown:
            more = {o[0] for o in good if any(near(o[0], r) for r in reached)}
            grown, reached = more != reached, more
        if min(reached) == d[0]:
            one.append(d)
    mixed = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(one, frame.schema)).collect()}
    assert {i for i, n in mixed.items() if n} == {r.doc_id for r in got}
    for i, n in mixed.items():
        assert sum(r.doc_id == i and r.piece == 0 for r in got) == n
    assert all(r.offset + r.length <= packing.CAPACITY for r in got)


def test_stages_keep_the_columns(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_null_rows_pass(spark, tmp_path):
    write(spark, tmp_path)
    spark.createDataFrame([(None, None, None, None, None), (999, None, None, None, None), (1000, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
