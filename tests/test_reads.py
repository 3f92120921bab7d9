import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contigua.operators import correct, dedup, index, kmers, match, ordered, overlap, preprocess, preqc
from contigua.sources import fastx

FLIP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(FLIP)[::-1]


def frame(spark, seqs, quality=None):
    rows = [(i, f"r{i:03d}", s, quality(i, s) if quality else None, None, "b") for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "read_idx long, name string, seq string, quality string, comment string, barcode string")


def genome(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def tiles(seed, n=90, size=20, count=14):
    g, rng = genome(n, seed), random.Random(seed + 100)
    out = set()
    for _ in range(count):
        at = rng.randrange(n - size + 1)
        s = g[at : at + size]
        s = rc(s) if rng.random() < 0.5 else s
        if rc(s) not in out:
            out.add(s)
    return sorted(out)


def plain_overlaps(reads, m):
    """(q, q_rc, t, t_rc) -> longest proper overlap, by comparing all."""
    out = {}
    turned = [(n, r, rc(s) if r else s) for n, s in reads for r in (False, True)]
    for q, a, x in turned:
        for t, b, y in turned:
            for n in range(m, min(len(x), len(y))):
                if q != t and x.endswith(y[:n]):
                    out[q, a, t, b] = n
    return out


def plain_irreducible(found, reads):
    seqs = {(n, r): rc(s) if r else s for n, s in reads for r in (False, True)}
    ext = {k: seqs[k[2], k[3]][n:] for k, n in found.items()}
    return {k: n for k, n in found.items() if not any(o[:2] == k[:2] and m > n and ext[k].startswith(ext[o]) for o, m in found.items())}


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_by_brute_force(spark, seed):
    seqs = tiles(seed)
    df, reads = frame(spark, seqs), [(f"r{i:03d}", s) for i, s in enumerate(seqs)]
    found = overlap.overlaps(df, 5)
    want = plain_overlaps(reads, 5)
    assert {tuple(r[:4]): r[4] for r in found.select("q", "q_rc", "t", "t_rc", "length").collect()} == want
    kept = overlap.irreducible(found, df)
    assert {tuple(r[:4]): r[4] for r in kept.select("q", "q_rc", "t", "t_rc", "length").collect()} == plain_irreducible(want, reads)


def test_one_overlap(spark):
    df = spark.createDataFrame([(0, "y", "CCCGGT"), (1, "x", "TTACCC")], "read_idx long, name string, seq string")
    (e,) = overlap.edges(overlap.overlaps(df, 3, both_strands=False).where("not q_rc"), df).collect() or [None]
    assert e is None or (e.id0, e.id1) == ("y", "x")
    rows = overlap.overlaps(df, 3, both_strands=False).collect()
    assert {(r.q, r.q_rc, r.t, r.t_rc, r.length) for r in rows} == {("x", False, "y", False, 3), ("y", True, "x", True, 3)}


def test_rmdup_and_containment(spark):
    seqs = ["ACGTTGCA", "ACGTTGCA", rc("ACGTTGCAA"), "TTGCA", "GGGG", "ACGTTGCAA"]
    kept, dropped = dedup.rmdup(frame(spark, seqs))
    assert {(r.name, r.n_duplicates) for r in kept.collect()} == {("r002", 2), ("r004", 1)}
    assert {(r.name, r.n_duplicates) for r in dropped.collect()} == {("r000", 0), ("r001", 0), ("r003", 0), ("r005", 2)}


def test_suffix_order_and_transform(spark):
    df = frame(spark, ["ACGT", "CGTA", "ACGT"])
    found = index.suffixes(df).orderBy("rank").collect()
    assert "".join(r.bwt_char for r in found) == "TATT$$AA$CCCGGG"
    assert [r["rank"] for r in found] == list(range(15))
    runs = index.runs(index.suffixes(frame(spark, ["AAACGGGTA"]))).orderBy("run_idx", "part").collect()
    assert sum(r.len for r in runs) == 10
    assert {r.symbol: r["first"] for r in index.c_array(df).collect()} == {"$": 0, "A": 3, "C": 6, "G": 9, "T": 12}
    with pytest.raises(ValueError):
        index.suffixes(df, algorithm="rope")


def test_runs_are_cut(spark):
    found = index.runs(index.suffixes(frame(spark, ["A" * 100]))).orderBy("run_idx", "part").collect()
    assert max(r.len for r in found) == 31 and sum(r.len for r in found) == 101


def test_running_sums_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 7)
    df = spark.range(100).select(F.col("id").alias("rank"), (F.col("id") % 3).alias("v"))
    got = ordered.running_sums(df, {"s": F.col("v")}).orderBy("rank").collect()
    assert [r.s for r in got] == [sum(i % 3 for i in range(n + 1)) for n in range(100)]
    before = ordered.previous(df, "v").orderBy("rank").collect()
    assert [r.prev for r in before] == [None, *[i % 3 for i in range(99)]]


def plain_correct(reads, k, t, rounds):
    counts = Counter(s[i : i + k] for s, _ in reads for i in range(len(s) - k + 1))
    out = {}
    need = lambda q: t + 1 if q >= 20 else t
    for n, (s, q) in enumerate(reads):
        if len(s) < k:
            continue
        for _ in range(rounds + 1):
            solid = [counts[s[i : i + k]] >= need(min(q[i : i + k])) for i in range(len(s) - k + 1)]
            weak = [i for i in range(len(s)) if not any(solid[max(0, i - k + 1) : i + 1])]
            if not weak:
                out[n] = s
                break
            new = None
            for i in weak:
                for at in (max(i + 1 - k, 0), min(i, len(s) - k)):
                    fits = [b for b in "ACGT" if b != s[i] and counts[s[at:i] + b + s[i + 1 : at + k]] >= max(1, need(q[i]))]
                    if len(fits) == 1 and new is None:
                        new = s[:i] + fits[0] + s[i + 1 :]
            if new is None:
                break
            s = new
    return out


def test_correction_by_brute_force(spark):
    g, rng = genome(120, 8), random.Random(8)
    seqs = [g[i : i + 40] for i in range(0, 80, 2)] * 3
    for i in range(0, len(seqs), 7):
        s, at = seqs[i], rng.randrange(40)
        seqs[i] = s[:at] + rng.choice([b for b in "ACGT" if b != s[at]]) + s[at + 1 :]
    quals = [[rng.choice([10, 30]) for _ in s] for s in seqs]
    df = frame(spark, [*seqs, "ACG"], lambda i, s: "".join(chr(33 + p) for p in (quals + [[9] * 3])[i]))
    got = {r.read_idx: r.seq for r in correct.correct(df, k=11, threshold=2).collect()}
    assert got == plain_correct([*zip(seqs, quals, strict=True), ("ACG", [9] * 3)], 11, 2, 10)
    with pytest.raises(NotImplementedError):
        correct.correct(df, algorithm="overlap")


def test_match_counts(spark):
    seqs = [genome(30, 1), genome(30, 2)]
    seqs.append(seqs[0][5:20] + rc(seqs[1])[3:18])
    df = frame(spark, seqs)
    asked = spark.createDataFrame([("a", 0, seqs[0][6:18]), ("b", 0, seqs[1][20:25]), ("c", 0, "ACGT" * 5)], "name string, end int, seq string")
    plain = lambda q: sum(s[i:].startswith(x) for x in (q, rc(q)) for s in seqs for i in range(len(s)))
    got = {r.name: r["count"] for r in match.occurrences(asked, df, seed=8).collect()}
    assert got == {r.name: plain(r.seq) for r in asked.collect()}
    assert {(r.end, len(r.seq)) for r in match.ends(df, 10).collect()} == {(0, 10), (1, 10)}


def test_preprocess_order_and_reasons(spark):
    good = genome(50, 3)
    rows = [good, good.lower(), good[:20] + "N" + good[21:], "AATGATACGGCGAC" + good, good[:30], good]
    q = lambda i, s: ("#" * 20 + "I" * (len(s) - 20)) if i == 5 else "I" * len(s)
    got = {r.read_idx: r["drop"] for r in preprocess.judged(frame(spark, rows, q), preprocess.Options(quality_filter=10)).collect()}
    assert got == {0: None, 1: None, 2: "bases", 3: "primer", 4: "length", 5: "quality"}


def test_pairs(spark):
    a, b = genome(50, 4), genome(50, 5)
    rows = [(0, "p", a), (1, "p", b), (2, "q/1", a), (3, "q/2", "ACG")]
    df = spark.createDataFrame([(i, n, s, None, None, "") for i, n, s in rows], "read_idx long, name string, seq string, quality string, comment string, barcode string")
    got = preprocess.filtered(preprocess.paired(df), preprocess.Options(pairs=2)).orderBy("read_idx").collect()
    assert [(r.name, r.seq) for r in got] == [("p/1", a), ("p/2", rc(b))]
    first, second = df.where("read_idx % 2 = 0").withColumn("read_idx", F.expr("read_idx div 2")), df.where("read_idx = 1").withColumn("read_idx", F.lit(0).cast("long"))
    assert preprocess.zipped(first, second).count() == 2
    assert preprocess.statistics(preprocess.paired(df), preprocess.Options(pairs=2)).first().n_invalid_pairs == 0


def test_preqc_report(spark):
    df = frame(spark, [genome(40, 6)] * 3, lambda i, s: "I" * 20 + "!" * 20)
    assert '"fraction_q30":[1.0' in preqc.report(df, 11, 1.0).first().json
    assert kmers.genome_size(kmers.counts(df, 11)).first().size == 30


FASTQ = "@a one\nACGT\n+\nIIII\n\n@b\nGG\n+b\n!!\n@c\nAC\n+\nI\n@d\nA\n+\nI\n"


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fq").write_text(FASTQ)
    rows = fastx.read(spark, str(tmp_path / "r.fq")).orderBy("read_idx").collect()
    assert [tuple(r) for r in rows] == [(0, "a", "ACGT", "IIII", "one"), (1, "b", "GG", "!!", None)]
    assert [r.name for r in fastx.read_fastq(spark, str(tmp_path / "r.fq"), mode="drop").orderBy("read_idx").collect()] == ["a", "b", "d"]
    with pytest.raises(Exception, match="bad FASTQ"):
        fastx.read_fastq(spark, str(tmp_path / "r.fq"), mode="fail").collect()


def test_fasta_over_lines(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">test\tcomment\nACG\nTGAC\n>x\nAA\n>empty\n>y\nCC\n")
    rows = fastx.read(spark, str(tmp_path / "r.fa")).orderBy("read_idx").collect()
    assert [(r.name, r.seq, r.comment) for r in rows] == [("test", "ACGTGAC", "comment"), ("x", "AA", None)]


@pytest.mark.parametrize("compression", [None, "gzip", "bzip2"])
def test_write_and_read_again(spark, tmp_path, compression):
    df = frame(spark, [genome(30, i) for i in range(50)], lambda i, s: "I" * len(s))
    fastx.write(df, str(tmp_path / "out"), compression=compression)
    back = fastx.read_fastq(spark, str(tmp_path / "out"))
    assert {(r.name, r.seq, r.quality) for r in back.collect()} == {(r.name, r.seq, r.quality) for r in df.collect()}


def test_many_splits_keep_the_order(spark, tmp_path):
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = fastx.read_fastq(spark, str(tmp_path / "r.fq")).orderBy("read_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.name for r in rows] == [f"r{i}" for i in range(500)]


@pytest.mark.parametrize("path,stem", [("a.txt", "a"), ("x/a.txt.gz", "a"), ("a.txt.bz2", "a"), ("a", "a")])
def test_stem(path, stem):
    assert fastx.stem(path) == stem


def test_not_a_read_file(spark, tmp_path):
    (tmp_path / "x").write_text("hello\n")
    with pytest.raises(ValueError):
        fastx.sniff(spark, str(tmp_path / "x"))


def test_streamed_report(spark, tmp_path):
    from contigua.streaming.cycle_quality import cycle_quality

    df = frame(spark, [genome(20, 1)] * 4, lambda i, s: "I" * 20)
    df.write.parquet(str(tmp_path / "in"))
    q = cycle_quality(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("cycles").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cycles").where("n = 4 and mean_quality = 40").count() == 20


def test_tiles_follow_the_length_of_texts(spark):
    """A row for a tile that held its text, or looked for its place from the text's start, took the square of the length."""
    from contigua.sources import derived

    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgXYZ .,é\n", k=1_500_000))
    texts = [long, None, "", "abc", "a" * 99 + "é", "z" * 100, "ß" * 500 + "Q" * 140]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) source")
    began = time.time()
    got = preprocess.filtered(derived.reads(docs), preprocess.Options(quality_trim=2, min_length=0, primer_check=False)).select("read_idx", "name", "seq", "barcode").collect()
    took = time.time() - began
    base = dict(zip(derived.LETTERS, derived.BASES, strict=True))
    want = []
    for d, text in enumerate(texts):
        s = "".join(base.get(c, "") for c in text or "")
        want += [(d * 1_000_000 + k, f"d{d}.{k // 2}/{k % 2 + 1}", s[40 * k : 40 * k + 100], "") for k in range((len(s) - 100) // 40 + 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert took < 20


@pytest.mark.parametrize(("k", "both"), [(20, True), (31, False), (40, False), (70, True)])
def test_windows_counted_in_pieces(spark, k, both):
    """Long repeats of one part, letters beyond ACGT, short reads."""
    rng = random.Random(k)
    g = genome(300, k) + "A" * 120 + "ACGT" * 40 + genome(100, k + 1)
    seqs = [g[i : i + rng.choice((15, 69, 70, 100, 130))] for i in range(0, 700, 7)] * 2 + [g, "", "A" * 90 + "N" + "A" * 90, "N" * 75]
    reads = frame(spark, seqs).repartition(3)
    plain = Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1))
    if k <= kmers.PACKED:
        strands = seqs + [rc(s) for s in seqs] * both
        want = Counter(s[i : i + k] for s in strands for i in range(len(s) - k + 1))
        counted = kmers.counts(reads, k, both_strands=both)
        assert {r.kmer: r.n for r in counted.collect()} == want
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(bucket" in plan and "hashpartitioning(code" not in plan
    texts = sorted(plain)[::5] + [genome(k, 999), "C" * k]
    half = genome(k // 2, k)
    texts += [half + rc(half)] * (k % 2 == 0)
    got = kmers.found(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "seq string, tag int"), reads, k, both_strands=both).collect()
    assert sorted((r.tag, r.seq, r.n) for r in got) == [(i, t, plain[t] + (plain[rc(t)] if both else 0)) for i, t in enumerate(texts)]


def test_reads_within_longer_ones_travel_in_pieces(spark):
    """A row for each place of a longer read took the square of its length."""
    rng = random.Random(5)
    g = genome(400, 5)
    seqs = sorted({g[i : i + n] if rng.random() < 0.5 else rc(g[i : i + n]) for i in range(0, 300, 3) for n in (30, 60, 100)})
    seqs += [genome(30, 6), genome(60, 7)]
    found = dedup.contained(spark.createDataFrame([(s,) for s in seqs], "seq string"))
    want = {s for s in seqs if any(len(t) > len(s) and (s in t or rc(s) in t) for t in seqs)}
    assert sorted(r.seq for r in found.collect()) == sorted(want)
    assert "substr(outer" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("m", [5, 12, 20])
def test_overlaps_shuffle_some_windows_of_a_read(spark, m):
    """Each place of a read was a row. Repeats of one part, of which equal windows must take the same one, included."""
    g = genome(60, m) + "ACACACACACACACAC" * 2 + "A" * 25 + genome(60, m + 1)
    seqs = sorted({g[i : i + n] for i in range(0, len(g) - 40, 3) for n in (24, 40)})
    seqs = [s for s in seqs if rc(s) not in seqs]
    found = overlap.overlaps(frame(spark, seqs), m)
    got = {(r.q, r.q_rc, r.t, r.t_rc): r.length for r in found.collect()}
    assert got == plain_overlaps([(f"r{i:03d}", s) for i, s in enumerate(seqs)], m)
    assert overlap._spots(overlap.oriented(frame(spark, [genome(100, 7)])), 50, False).count() < 2 * 50 / 4
