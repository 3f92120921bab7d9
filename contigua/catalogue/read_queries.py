"""Queries over reads: functions, preprocessing, k-mers, index, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords, dna, scores
from ..graph import paths
from ..operators import correct, dedup, index, kmers, match, ordered, overlap, preprocess, preqc
from ..sources import derived
from .base import MIN_OVERLAP, query, raw_reads, rc, reads, shared, sql, unique_reads, varied_reads

K = 31
P = preprocess.Options(quality_trim=20, quality_filter=9, min_length=60, hard_clip=90)


@query(sql(f"select read_idx, {rc('seq')} as rc, translate(seq, 'ACGT', 'TGCA') as complement, reverse(quality) as quality from reads", "reads"))
def reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir).select("read_idx", dna.reverse_complement("seq").alias("rc"), dna.complement("seq").alias("complement"), F.reverse("quality").alias("quality"))


@query(sql("select read_idx, sum(ascii(c) - 33)::bigint total, min(ascii(c) - 33)::bigint least, max(ascii(c) - 33)::bigint most from (select read_idx, unnest(string_split(quality, '')) c from reads) group by all", "reads"))
def phred_decode(spark, sf_dir):
    q = reads(spark, sf_dir).select("read_idx", dna.phreds("quality").alias("q"))
    return q.select("read_idx", F.aggregate("q", F.lit(0), lambda a, x: a + x).alias("total"), F.array_min("q").alias("least"), F.array_max("q").alias("most"))


@query(sql("select name, left(name, length(name) - 1) || translate(right(name, 1), '12', '21') mate, regexp_replace(name, '/[^/]*$', '') base, cast(right(name, 1) as bigint) - 1 idx from reads", "reads"))
def mate_name(spark, sf_dir):
    return reads(spark, sf_dir).select("name", dna.mate_name("name").alias("mate"), dna.pair_basename("name").alias("base"), dna.pair_index("name").alias("idx"))


@query(sql("select read_idx, least(93, 20 + k % 90)::bigint phred, chr(cast(33 + least(93, 20 + k % 90) as int)) c, instr('ACGT', substr(seq, 1, 1))::bigint rank, replace(replace(seq, 'A', 'A'), 'N', 'T') iupac from reads", "reads"))
def symbol_rank(spark, sf_dir):
    k = (F.col("read_idx") % 1_000_000).cast("int")
    return reads(spark, sf_dir).select("read_idx", F.least(F.lit(93), 20 + k % 90).alias("phred"), dna.phred_char(20 + k % 90).alias("c"), dna.symbol_rank(F.left("seq", F.lit(1))).alias("rank"), dna.normalise_iupac("seq").alias("iupac"))


_COORD = "with i as (select doc_id id, doc_id % 40 s, doc_id % 40 + 20 e, 60 + doc_id % 3 n from documents)"


def _intervals(spark, sf_dir):
    d = F.col("doc_id")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(d.alias("id"), (d % 40).alias("s"), (d % 40 + 20).alias("e"), (60 + d % 3).alias("n"))


@query(f"{_COORD} select id, n - 1 - e as s, n - 1 - s as e, e + 1 - s as size from i")
def interval_flip(spark, sf_dir):
    s, e = coords.flip(*map(F.col, "sen"))
    return _intervals(spark, sf_dir).select("id", s.alias("s"), e.alias("e"), coords.length(F.col("s"), F.col("e")).alias("size"))


@query(f"{_COORD} select id, case when s = 0 then e + 1 else 0 end as s, case when s = 0 then n - 1 else s - 1 end as e, s = 0 or e + 1 = n as extreme, s = 0 and e + 1 = n as contained from i")
def seqcoord_complement(spark, sf_dir):
    s, e = coords.complement(*map(F.col, "sen"))
    return _intervals(spark, sf_dir).select("id", s.alias("s"), e.alias("e"), coords.is_extreme(*map(F.col, "sen")).alias("extreme"), coords.is_contained(*map(F.col, "sen")).alias("contained"))


@query(f"{_COORD} select id, case when id % 2 = 1 then e - (id % 7 - 2) else s + (id % 7 - 2) end as at, -1::bigint side from i")
def match_translate(spark, sf_dir):
    c = lambda x: F.lit(x).cast("long")
    at = coords.translate_1_to_0(F.col("id") % 7, F.col("s"), F.col("e"), c(2), c(22), F.col("id") % 2 == 1)
    side = coords.contained_side(F.col("s") + 1, F.col("e") + 1, F.col("n") + 2, F.col("s") + 1, F.col("e") + 1, F.col("n") + 2, F.col("id"), F.col("id"))
    return _intervals(spark, sf_dir).select("id", at.alias("at"), side.cast("long").alias("side"))


_N, _G = scores.READS, scores.GENOME


@query(sql(f"select name, round(({_N}.0::double - coverage) * (ln({_G}.0::double - length(seq)) - ln({_G}.0::double - 2 * length(seq))) - coverage * ln(2::double), 6) uniqueness, round(length(seq)::double * {_N} / {_G} - coverage * ln(2::double), 6) repeatness, (coverage - 1)::double / length(seq) point from uread", "unique"))
def repeat_score(spark, sf_dir):
    n, c = F.length("seq"), F.col("coverage")
    return unique_reads(spark, sf_dir).select("name", F.round(scores.uniqueness(n, c), 6).alias("uniqueness"), F.round(scores.repeatness(n, c), 6).alias("repeatness"), scores.point_coverage(c, n).alias("point"))


@query(sql("select read_idx, length(seq) size from raw where regexp_matches(upper(seq), '^[ACGT]*$')", "raw"))
def acgt_filter(spark, sf_dir):
    return raw_reads(spark, sf_dir).where(dna.is_dna(F.upper("seq"))).select("read_idx", F.length("seq").alias("size"))


@query(sql("select read_idx, left(seq, 70) seq, left(quality, 70) quality from raw", "raw"))
def hard_clip(spark, sf_dir):
    return preprocess.hard_clip(raw_reads(spark, sf_dir), 70).select("read_idx", "seq", "quality")


def _soft(source: str, least: int, columns: str) -> str:
    return f"""
pos as (select read_idx, i, sum({least} - (ascii(substr(quality, cast(i as int), 1)) - 33)) over (partition by read_idx order by i desc) s
        from (select read_idx, quality, unnest(range(1, length(quality) + 1)) i from {source})),
best as (select read_idx, case when max(s) > 0 then arg_max(i, struct_pack(s := s, i := i)) else 0 end n from pos group by all),
soft as (select {columns}, cast(case when ascii(right(quality, 1)) - 33 >= {least} then length(quality) else n end as int) n from {source} join best using (read_idx))"""


@query(sql(f"{_soft('reads', 30, 'reads.*')} select read_idx, substr(seq, 1, n) seq, substr(quality, 1, n) quality from soft", "reads"))
def soft_clip(spark, sf_dir):
    return preprocess.soft_clip(reads(spark, sf_dir), 30).select("read_idx", "seq", "quality")


@query(sql(f"select read_idx, n from (select read_idx, length(quality) - length(regexp_replace(quality, '[!-$]', '', 'g')) n from reads) where n < 9", "reads"))
def low_quality_filter(spark, sf_dir):
    return reads(spark, sf_dir).select("read_idx", dna.n_low_quality("quality").alias("n")).where("n < 9")


_PRIMER = " or ".join(f"contains('{p}', left({{0}}, {dna.PRIMER_BASES}))" for p in dna.PRIMERS)


@query(sql(f"select read_idx, {_PRIMER.format('upper(seq)')} as primer from raw", "raw"))
def primer_screen(spark, sf_dir):
    return raw_reads(spark, sf_dir).select("read_idx", dna.has_primer(F.upper("seq")).alias("primer"))


@query(sql("select read_idx, length(seq) size from varied where length(seq) >= 80", "varied"))
def min_length(spark, sf_dir):
    return varied_reads(spark, sf_dir).where(F.length("seq") >= 80).select("read_idx", F.length("seq").alias("size"))


_JUDGED = f"""
up as (select read_idx, name, barcode, seq raw, left(upper(seq), 90) seq, left(quality, 90) quality, regexp_matches(upper(seq), '^[ACGT]*$') ok from raw),
{_soft('up', 20, 'up.*').strip()},
cut as (select read_idx, name, barcode, ok, raw, substr(seq, 1, n) seq, substr(quality, 1, n) quality from soft),
judged as (select *, case when not ok then 'bases' when length(quality) - length(regexp_replace(quality, '[!-$]', '', 'g')) >= 9 then 'quality'
  when {_PRIMER.format('seq')} or seq = '' then 'primer' when length(seq) < 60 then 'length' end drop_ from cut)"""
_PAIRS = """
pairs as (select a.read_idx // 2 pair_idx, a.name name_a, b.name name_b, a.seq seq_a, b.seq seq_b, a.quality q_a, b.quality q_b, a.drop_ drop_a, b.drop_ drop_b
  from judged a join judged b on a.read_idx % 2 = 0 and b.read_idx = a.read_idx + 1)"""


def _paired(spark, sf_dir):
    return preprocess.paired(raw_reads(spark, sf_dir))


@query(sql(f"{_JUDGED}, {_PAIRS} select read_idx from judged join pairs on read_idx // 2 = pair_idx where drop_a is null and drop_b is null", "raw"))
def pair_filter(spark, sf_dir):
    o = preprocess.Options(**{**P.__dict__, "pairs": 2, "orientation": "ff"})
    return preprocess.filtered(_paired(spark, sf_dir), o).select("read_idx")


def _oriented(turn: str) -> str:
    a, b = (rc("seq_a"), "seq_b") if turn == "a" else ("seq_a", rc("seq_b"))
    qa, qb = ("reverse(q_a)", "q_b") if turn == "a" else ("q_a", "reverse(q_b)")
    return sql(f"""{_JUDGED}, {_PAIRS}, good as (select * from pairs where drop_a is null and drop_b is null)
select name_a as name, {a} as seq, {qa} as quality from good union all select name_b, {b}, {qb} from good""", "raw")


@query(_oriented("b"))
def pair_orient_fr(spark, sf_dir):
    o = preprocess.Options(**{**P.__dict__, "pairs": 2, "orientation": "fr"})
    return preprocess.filtered(_paired(spark, sf_dir), o).select("name", "seq", "quality")


@query(_oriented("a"))
def pair_orient_rf(spark, sf_dir):
    o = preprocess.Options(**{**P.__dict__, "pairs": 2, "orientation": "rf"})
    return preprocess.filtered(_paired(spark, sf_dir), o).select("name", "seq", "quality")


@query(sql("select read_idx, name, 'BX:Z:' || barcode as comment from reads where read_idx % 1000000 <> 3", "reads"))
def barcode_attach(spark, sf_dir):
    own = reads(spark, sf_dir)
    codes = own.select("read_idx", "barcode").where("read_idx % 1000000 <> 3")
    return preprocess.with_barcodes(own, codes).select("read_idx", "name", F.concat(F.lit("BX:Z:"), "barcode").alias("comment"))


@query(sql(f"{_JUDGED} select count(*) n_reads, sum(length(raw))::bigint n_bases, count(*) filter (drop_ is null) n_kept, coalesce(sum(length(seq)) filter (drop_ is null), 0)::bigint n_kept_bases, count(*) filter (drop_ = 'primer') n_primer, 0::bigint n_invalid_quality from judged", "raw"))
def preprocess_stats(spark, sf_dir):
    return preprocess.statistics(raw_reads(spark, sf_dir), P)


@query(sql(f"{_JUDGED} select read_idx, seq, quality from judged where drop_ is null", "raw"))
def preprocess_full(spark, sf_dir):
    return preprocess.filtered(raw_reads(spark, sf_dir), P).select("read_idx", "seq", "quality")


_KMERS = f"""
win as (select read_idx, quality, seq, unnest(range(0, length(seq) - {K} + 1)) pos from reads),
km as (select substr(seq, cast(pos + 1 as int), {K}) kmer, count(*) n from win group by all)"""


def _counts(spark, sf_dir):
    return shared(spark, sf_dir, "kmers", lambda: kmers.counts(reads(spark, sf_dir), K))


@query(sql(f"{_KMERS} select left(kmer, 6) prefix, count(*) n_kmers, sum(n)::bigint total, max(n) most from km group by all", "reads"))
def kmer_count(spark, sf_dir):
    counted = kmers.packed_counts(reads(spark, sf_dir), K)
    summed = counted.groupBy(F.shiftright("code", 2 * (K - 6)).alias("_code"), F.left("other", F.lit(6)).alias("_other")).agg(F.count("*").alias("n_kmers"), F.sum("n").alias("total"), F.max("n").alias("most"))
    return summed.groupBy(F.coalesce("_other", kmers.unpacked(F.col("_code"), 6)).alias("prefix")).agg(F.sum("n_kmers").alias("n_kmers"), F.sum("total").alias("total"), F.max("most").alias("most"))


@query(sql(f"{_KMERS} select n, count(*) n_kmers from km group by all", "reads"))
def kmer_spectrum(spark, sf_dir):
    return kmers.spectrum(kmers.packed_counts(reads(spark, sf_dir), K))


_SOLID = f"""{_KMERS},
ph as (select read_idx, pos, min(ascii(substr(quality, cast(pos + 1 + j as int), 1)) - 33) q from win, range(0, {K}) t(j) group by all),
sol as (select w.read_idx, w.pos, q, n, n >= case when q >= 20 then 4 else 3 end solid from win w join ph using (read_idx, pos) join km on kmer = substr(seq, cast(w.pos + 1 as int), {K})),
mask as (select read_idx, string_agg(case when c then '1' else '0' end, '' order by i) mask from (
  select r.read_idx, i, coalesce(bool_or(solid), false) c from (select read_idx, unnest(range(0, length(seq))) i from reads where length(seq) >= {K}) r
  left join sol s on s.read_idx = r.read_idx and s.pos <= i and i < s.pos + {K} group by all) group by all)"""


@query(sql(f"{_SOLID} select read_idx, min(q)::bigint least, sum(q)::bigint total, sum(n)::bigint n, count(*) filter (solid) n_solid from sol group by all", "reads"))
def kmer_min_phred(spark, sf_dir):
    found = kmers.scored_windows(reads(spark, sf_dir), _counts(spark, sf_dir), K, 3, "read_idx")
    return found.groupBy("read_idx").agg(F.min("min_phred").alias("least"), F.sum("min_phred").alias("total"), F.sum("n").alias("n"), F.count_if("solid").alias("n_solid"))


@query(sql(f"{_SOLID} select read_idx, mask from mask", "reads"))
def solid_mask(spark, sf_dir):
    return kmers.solid_masks(reads(spark, sf_dir), _counts(spark, sf_dir), K, 3)


@query(sql(f"{_SOLID} select read_idx, length(mask) - length(replace(mask, '0', '')) n_weak from mask where contains(mask, '0')", "reads"))
def weak_reads(spark, sf_dir):
    masks = kmers.solid_masks(reads(spark, sf_dir), _counts(spark, sf_dir), K, 3)
    return kmers.error_positions(masks).groupBy("read_idx").agg(F.count("*").alias("n_weak"))


_CORRECT = f"""{_SOLID},
weak as (select r.read_idx, r.seq, pos, ascii(substr(quality, cast(pos + 1 as int), 1)) - 33 q from (select read_idx, unnest(range(0, length(mask))) pos, mask from mask) m join reads r using (read_idx) where substr(mask, cast(pos + 1 as int), 1) = '0'),
tried as (select read_idx, seq, pos, q, side, b, case when side = 0 then greatest(pos + 1 - {K}, 0) else least(pos, length(seq) - {K}) end st from weak, (values (0), (1)) s(side), (values ('A'), ('C'), ('G'), ('T')) c(b) where b <> substr(seq, cast(pos + 1 as int), 1)),
okay as (select read_idx, pos, side, count(*) c, min(b) b from tried join km on kmer = substr(seq, cast(st + 1 as int), cast(pos - st as int)) || b || substr(seq, cast(pos + 2 as int), cast({K} - 1 - (pos - st) as int))
  where n >= greatest(1, case when q >= 20 then 4 else 3 end) group by all having c = 1),
one as (select * from okay qualify row_number() over (partition by read_idx order by pos, side) = 1)"""


@query(sql(f"{_CORRECT} select read_idx, case when pos is null then seq else substr(seq, 1, cast(pos as int)) || b || substr(seq, cast(pos + 2 as int)) end as seq, not contains(mask, '0') as done, pos is not null as changed from reads join mask using (read_idx) left join one using (read_idx)", "reads"))
def correct_round1(spark, sf_dir):
    return correct.one_round(reads(spark, sf_dir), _counts(spark, sf_dir), K).select("read_idx", "seq", "done", "changed")


@query()
def correct_full(spark, sf_dir):
    return correct.correct(reads(spark, sf_dir), k=K).select("read_idx", "seq")


_MATCH = f"""
txt as (select name, seq, 0 as en from reads where false),
qs as (select name, 0::bigint as "end", substr(seq, 1, 40) seq from reads where length(seq) > 40 union all select name, 1, right(seq, 40) from reads where length(seq) > 40),
kms as (select substr(seq, cast(p as int), 40) kmer, count(*) n from (select seq, unnest(range(1, length(seq) - 40 + 2)) p from reads) group by all)"""


@query(sql(f"""{_MATCH} select q.name, q."end", q.seq, (coalesce(a.n, 0) + coalesce(b.n, 0))::bigint as "count" from qs q left join kms a on a.kmer = q.seq left join kms b on b.kmer = {rc('q.seq')}""", "reads"))
def match_ends(spark, sf_dir):
    own = reads(spark, sf_dir)
    return match.occurrences(match.ends(own, 40), own)


@query(sql(f"""
w as (select substr(seq, cast(p as int), l) kmer, l, count(*) n from (select seq, l, unnest(range(1, length(seq) - l + 2)) p from reads, (values (70), (85), (100)) t(l)) group by all)
select v.name, v.seq, (coalesce(a.n, 0) + coalesce(b.n, 0))::bigint as "count" from varied v left join w a on a.kmer = v.seq left join w b on b.kmer = {rc('v.seq')}""", "varied"))
def match_occurrences(spark, sf_dir):
    asked = varied_reads(spark, sf_dir).select("name", F.lit(0).alias("end"), "seq")
    return match.occurrences(asked, reads(spark, sf_dir)).select("name", "seq", "count")


@query(sql("select i as cycle, avg(q) mean_quality, avg((q >= 30)::int) fraction_q30 from (select i, ascii(substr(quality, cast(i + 1 as int), 1)) - 33 q from (select quality, unnest(range(0, length(quality))) i from reads)) group by all", "reads"))
def preqc_cycle_quality(spark, sf_dir):
    return preqc.cycle_quality(reads(spark, sf_dir), 1.0)


@query(sql(f"{_KMERS}, dep as (select n d from (select n, count(*) c from km where n > 1 group by all) order by c desc, n limit 1) select {K}::bigint k, d as depth, (sum(n) // any_value(d))::bigint size from km, dep group by all", "reads"))
def preqc_genome_size(spark, sf_dir):
    return kmers.genome_size(kmers.counts(reads(spark, sf_dir), K))


def _index(spark, sf_dir, reverse=False):
    return shared(spark, sf_dir, f"suffixes-{reverse}", lambda: index.suffixes(reads(spark, sf_dir), reverse=reverse))


def _suffixes(seq: str = "seq") -> str:
    return f"""
suf as (select read_idx, pos, case when pos = 0 then '$' else substr(s, cast(pos as int), 1) end c, row_number() over (order by substr(s, cast(pos + 1 as int)), read_idx) - 1 as rank
  from (select read_idx, {seq} s, unnest(range(0, length(seq) + 1)) pos from reads))"""


@query(sql(f"{_suffixes()} select read_idx, min(rank) least, max(rank) most, sum(rank * (pos + 1))::bigint total from suf group by all", "reads"))
def suffix_order(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("read_idx").agg(F.min("rank").alias("least"), F.max("rank").alias("most"), F.sum(F.col("rank") * (F.col("pos") + 1)).alias("total"))


@query(sql(f"{_suffixes()} select read_idx, rank from suf where pos = 0", "reads"))
def read_rank(spark, sf_dir):
    return index.read_ranks(_index(spark, sf_dir))


@query(sql(f"{_suffixes('reverse(seq)')} select read_idx, rank from suf where pos = 0", "reads"))
def reverse_index(spark, sf_dir):
    return index.read_ranks(_index(spark, sf_dir, True))


@query(sql(f"{_suffixes()} select rank // 1000 as block, string_agg(c, '' order by rank) bwt from suf group by all", "reads"))
def bwt_string(spark, sf_dir):
    blocks = _index(spark, sf_dir).groupBy(F.expr("rank div 1000").alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "bwt_char"))).alias("x"))
    return blocks.select("block", F.array_join("x.bwt_char", "").alias("bwt"))


_RUNS = f"""{_suffixes()},
mk as (select rank, c, case when c is distinct from lag(c) over (order by rank) then 1 else 0 end st from suf),
rn as (select rank, c, sum(st) over (order by rank)::bigint run from mk),
wh as (select run, any_value(c) symbol, count(*) n from rn group by all),
runs as (select run run_idx, part, symbol, least(31, n - part * 31) len from (select *, unnest(range(0, (n - 1) // 31 + 1)) part from wh))"""


@query(sql(f"{_RUNS} select symbol, len, count(*) n, sum(run_idx)::bigint places from runs group by all", "reads"))
def bwt_runs(spark, sf_dir):
    return index.runs(_index(spark, sf_dir)).groupBy("symbol", "len").agg(F.count("*").alias("n"), F.sum("run_idx").alias("places"))


@query(sql(f"{_RUNS} select sum(len)::bigint n_symbols, count(*) n_runs, sum(len)::double / count(*) symbols_per_run from runs", "reads"))
def index_info(spark, sf_dir):
    return index.info(index.runs(_index(spark, sf_dir)))


@query(sql("""n as (select c, (select coalesce(sum(length(seq) - length(replace(seq, c, ''))), 0)::bigint from reads) as n from (values ('A'), ('C'), ('G'), ('T')) t(c) union all select '$', (select count(*) from reads))
select c as symbol, coalesce((select sum(n)::bigint from n b where b.c < a.c), 0)::bigint as first from n a""", "reads"))
def c_array(spark, sf_dir):
    return index.c_array(reads(spark, sf_dir))


@query(sql(f"{_suffixes()}, oc as (select rank, " + ", ".join(f"sum((c = '{b}')::int) over (order by rank)::bigint \"{b}\"" for b in "ACGT") + " from suf) select * from oc where (rank + 1) % 8192 = 0", "reads"))
def occ_checkpoint(spark, sf_dir):
    return index.occ(_index(spark, sf_dir))


@query(sql(f"""e as (select substr(seq, cast(p as int), 12) kmer, substr(seq, cast(p + 12 as int), 1) b from (select seq, unnest(range(1, length(seq) - 13 + 2)) p from reads))
select kmer, {', '.join(f"count(*) filter (b = '{b}') as \"{b}\"" for b in 'ACGT')} from e group by all""", "reads"))
def extension_counts(spark, sf_dir):
    return index.extensions(reads(spark, sf_dir), 12)


_DUP = f"""
cls as (select least(seq, {rc('seq')}) c, min(name) name, count(*) n from varied group by all),
inn as (select distinct a.c from cls a, cls b where length(a.c) < length(b.c) and (contains(b.c, a.c) or contains(b.c, {rc('a.c')}))),
dup as (select v.read_idx, v.name, v.seq, case when i.c is not null then 0 else n end n_duplicates, v.name = k.name and i.c is null keep
  from varied v join cls k on k.c = least(v.seq, {rc('v.seq')}) left join inn i on i.c = k.c)"""
# The containment join by brute force is quadratic: SQL meets by the first 70 bases instead, on both strands.
_DUP = f"""
cls as (select least(seq, {rc('seq')}) c, min(name) name, count(*) n from varied group by all),
txt as (select c, c t from cls union all select c, {rc('c')} from cls),
big as (select c, substr(c, cast(p as int)) rest from (select c, unnest(range(1, length(c) - 70 + 2)) p from cls where length(c) > 70)),
inn as (select distinct txt.c from txt join big on substr(t, 1, 70) = substr(rest, 1, 70) where length(big.c) > length(t) and starts_with(rest, t)),
dup as (select v.read_idx, v.name, v.seq, case when i.c is not null then 0 else n end n_duplicates, v.name = k.name and i.c is null keep
  from varied v join cls k on k.c = least(v.seq, {rc('v.seq')}) left join inn i on i.c = k.c)"""


@query(sql(f"{_DUP} select name, seq, n_duplicates from dup where keep", "varied"))
def rmdup_keep(spark, sf_dir):
    return dedup.rmdup(varied_reads(spark, sf_dir))[0].select("name", "seq", "n_duplicates")


@query(sql(f"{_DUP} select name, seq, n_duplicates from dup where not keep", "varied"))
def rmdup_dups(spark, sf_dir):
    return dedup.rmdup(varied_reads(spark, sf_dir))[1].select("name", "seq", "n_duplicates")


@query(sql(f"select least(seq, {rc('seq')}) canonical, min(name) as name, count(*) n from reads group by 1", "reads"))
def copy_count(spark, sf_dir):
    return dedup.copies(reads(spark, sf_dir))


@query(sql(f"{_DUP} select name, (not keep)::bigint substring from dup", "varied"))
def substring_reads(spark, sf_dir):
    return overlap.containments(varied_reads(spark, sf_dir))


@query(sql("select name, length(seq) as length from reads", "reads"))
def read_info(spark, sf_dir):
    return reads(spark, sf_dir).select("name", F.length("seq").alias("length"))


@query(sql("select read_idx, rank, name from (select read_idx, name, row_number() over (order by seq, read_idx) - 1 as rank from reads)", "reads"))
def sorted_reads(spark, sf_dir):
    return ordered.global_rank(reads(spark, sf_dir).select("seq", "read_idx", "name"), "seq", "read_idx").select("read_idx", "rank", "name")


@query(sql("select b.read_idx // 2 as pair_idx, a.name as first, b.name as second from raw a join raw b on a.read_idx % 2 = 1 and b.read_idx = a.read_idx + 1 where left(a.name, length(a.name) - 1) || translate(right(a.name, 1), '12', '21') <> b.name", "raw"))
def mismatched_pairs(spark, sf_dir):
    """Pairs that begin with a second read: their names are no mates'."""
    shifted = raw_reads(spark, sf_dir).withColumn("read_idx", F.col("read_idx") + 1)
    return preprocess.mismatched(preprocess.paired(shifted)).select("pair_idx", "first", "second")


@query(sql(f"{_JUDGED}, {_PAIRS} select name_a || '/1' as name, seq_a as seq from pairs where drop_a is null and drop_b is null and name_a = name_b union all select name_b || '/2', seq_b from pairs where drop_a is null and drop_b is null and name_a = name_b".replace("read_idx, name, barcode, seq raw", "read_idx, regexp_replace(name, '/[^/]*$', '') as name, barcode, seq raw"), "raw"))
def renamed_pairs(spark, sf_dir):
    """Pairs whose mates have one name between them get /1 and /2."""
    own = _paired(spark, sf_dir).withColumn("name", dna.pair_basename("name"))
    o = preprocess.Options(**{**P.__dict__, "pairs": 2, "orientation": "ff"})
    return preprocess.filtered(own, o).where(F.col("name").rlike("/[12]$")).select("name", "seq")


@query(sql("select read_idx, quality from (select read_idx, string_agg(chr(ascii(c) - 31 + 31), '' order by i) quality from (select read_idx, i, substr(quality, cast(i as int), 1) c from (select read_idx, quality, unnest(range(1, length(quality) + 1)) i from reads)) group by all)", "reads"))
def phred64_read(spark, sf_dir):
    """Qualities as phred + 64 files have them, read as phred + 33."""
    old = F.array_join(F.transform(F.split("quality", ""), lambda c: F.char(F.ascii(c) + 31)), "")
    return reads(spark, sf_dir).select("read_idx", dna.from_phred64(old).alias("quality"))


@query(sql(f"{_suffixes()}, oc as (select rank, " + ", ".join(f"sum((c = '{b}')::int) over (order by rank)::bigint \"{b}\"" for b in "ACGT") + " from suf) select * from oc where rank % 977 = 3", "reads"))
def rank_query(spark, sf_dir):
    """How many of each base the transform has up to some ranks."""
    found = _index(spark, sf_dir)
    return index.ranks_at(found, found.where("rank % 977 = 3").select("rank"))


@query(sql(f"{_suffixes()} select a.rank // 1000 as block, count(b.rank) n, sum(b.rank)::bigint total, sum(b.rank * (a.rank % 1000))::bigint mixed from suf a left join suf b on b.read_idx = a.read_idx and b.pos = a.pos - 1 group by all", "reads"))
def lf_mapping(spark, sf_dir):
    """Where each rank's suffix, longer by the base before it, stands."""
    found = index.lf_map(_index(spark, sf_dir))
    return found.groupBy(F.expr("rank div 1000").alias("block")).agg(F.count("to").alias("n"), F.sum("to").alias("total"), F.sum(F.col("to") * (F.col("rank") % 1000)).alias("mixed"))


@query(sql("select u.name, w.ref, p as start, p + 100 as \"end\", false as turned from uread u join (select 'd' || doc_id as ref, s, unnest(range(0, length(s) - 100 + 1)) p from dna where length(s) >= 100) w on substr(w.s, cast(p + 1 as int), 100) = u.seq", "unique"))
def contig_placement(spark, sf_dir):
    """Where sequences stand in a reference: here the texts that the reads were cut from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    reference = docs.select(F.concat(F.lit("d"), "doc_id").alias("name"), derived.dna(F.col("text")).alias("seq")).where("seq <> ''")
    return paths.placed(unique_reads(spark, sf_dir).select("name", "seq"), reference)
