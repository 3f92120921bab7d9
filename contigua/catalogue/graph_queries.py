"""Queries over overlaps and the string graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna, links, scores
from ..graph import clean, features, model, paths
from ..operators import overlap
from ..plans import assemble
from ..sources import asqg
from .base import MIN_OVERLAP, edges, found_overlaps, graph, query, rc, reads, shared, sql, unique_reads

#: A genome so small that reads of these lengths can be unique.
GENOME = 5_000_000
_SCORE = f"sc as (select id, ({scores.READS}.0::double - coverage) * (ln({GENOME}.0::double - size) - ln({GENOME}.0::double - 2 * size)) - coverage * ln(2::double) s from deg)"


@query(sql("select * from ov", "overlaps"))
def overlap_exhaustive(spark, sf_dir):
    return overlap.overlaps(unique_reads(spark, sf_dir), MIN_OVERLAP).select("q", "q_rc", "t", "t_rc", "length")


@query(sql("select * from ov where q_rc = t_rc", "overlaps"))
def overlap_same_strand(spark, sf_dir):
    return overlap.overlaps(unique_reads(spark, sf_dir), MIN_OVERLAP, both_strands=False).select("q", "q_rc", "t", "t_rc", "length")


@query(sql("select q, q_rc, t, t_rc, length from irr", "reduced"))
def overlap_irreducible(spark, sf_dir):
    return overlap.irreducible(found_overlaps(spark, sf_dir), unique_reads(spark, sf_dir)).select("q", "q_rc", "t", "t_rc", "length")


@query(sql("select * from ed", "edges"))
def asqg_edges(spark, sf_dir):
    return overlap.string_graph(unique_reads(spark, sf_dir), MIN_OVERLAP)


@query(sql("""select 'VT' || chr(9) || name || chr(9) || seq || case when coverage > 0 then chr(9) || 'CR:i:' || coverage else '' end || chr(9) || 'BX:Z:' || (select string_agg(bx || '!' || n, ',' order by bx) from bars b where b.name = u.name) as line from uread u""", "unique"))
def asqg_vertices(spark, sf_dir):
    return asqg.vertex_lines(model.vertices_of(unique_reads(spark, sf_dir)))


@query(sql("select 'ED' || chr(9) || id0 || ' ' || id1 || ' ' || s0 || ' ' || e0 || ' ' || l0 || ' ' || s1 || ' ' || e1 || ' ' || l1 || ' ' || is_rc || ' ' || num_diff as line from ed", "edges"))
def asqg_edge_lines(spark, sf_dir):
    return asqg.edge_lines(edges(spark, sf_dir))


@query(sql("select edge_key, half, src, dst, dir, twin_dir, overlap from (select edge_key, half::bigint half, src, dst, dir::bigint dir, twin_dir::bigint twin_dir, overlap from he)", "graph"))
def half_edges(spark, sf_dir):
    return graph(spark, sf_dir).half_edges


@query(sql("select id, sense, antisense from deg", "graph"))
def degrees(spark, sf_dir):
    return model.degrees(graph(spark, sf_dir))


@query(sql("select count(*) vertices, sum(sense + antisense)::bigint edges, count(*) filter (sense = 0 and antisense = 0) islands, count(*) filter ((sense = 0) <> (antisense = 0)) tips, count(*) filter ((sense > 1) <> (antisense > 1)) monobranch, count(*) filter (sense > 1 and antisense > 1) dibranch, count(*) filter (sense = 1 or antisense = 1) simple from deg", "graph"))
def graph_stats(spark, sf_dir):
    return model.statistics(graph(spark, sf_dir))


def _part(q: str, d: str) -> str:
    return f"case when {d} = 0 then right({q}, cast(overlap as int)) else left({q}, cast(overlap as int)) end"


@query(sql(f"select edge_key, src, dst from (select he.*, {_part('a.seq', 'dir')} x, {_part('b.seq', 'twin_dir')} y from he join uread a on src = a.name join uread b on dst = b.name where half = 0) where x <> case when dir = twin_dir then {rc('y')} else y end", "graph"))
def validate_edges(spark, sf_dir):
    return model.violations(graph(spark, sf_dir))


@query(sql("select id from deg where (sense = 0 or antisense = 0) and size <= 150 and (greatest(coverage, 1) - 1) / size <= 1 / 150", "graph"))
def trim_tips(spark, sf_dir):
    return clean.tips(graph(spark, sf_dir), 150, 2)


_SINGLE = "sg as (select d.id, p.dst prev, p.twin_dir prev_dir, n.dst nxt, n.twin_dir next_dir from deg d join he p on p.src = d.id and p.dir = 1 join he n on n.src = d.id and n.dir = 0 where sense = 1 and antisense = 1)"


@query(sql(f"{_SINGLE} select id, prev as u from sg where prev = nxt and prev <> id", "graph"))
def loop_candidates(spark, sf_dir):
    return clean.loops(graph(spark, sf_dir)).select("id", F.col("prev").alias("u"))


_RANKED = f"""{_SCORE},
rk as (select *, row_number() over w r, max(overlap) over (partition by src, dir) most, first_value(dst = src) over w slf from he window w as (partition by src, dir order by overlap desc, dst, edge_key)),
beaten as (select rk.* from rk join sc on src = id where s >= 13 and r > 1 and most - overlap >= 5)"""


@query(sql(f"{_RANKED} select distinct edge_key from beaten", "graph"))
def max_overlap(spark, sf_dir):
    return clean.weaker_overlaps(graph(spark, sf_dir), 5, genome=GENOME)


@query(sql(f"{_RANKED} select distinct b.edge_key from beaten b join rk f on f.edge_key = b.edge_key and f.half = 1 - b.half where not case when b.dst = b.src then b.slf else f.r = 1 or f.most - f.overlap < 5 end", "graph"))
def max_overlap_careful(spark, sf_dir):
    return clean.weaker_overlaps(graph(spark, sf_dir), 5, careful=True, genome=GENOME)


_CHIMERIC = f"""{_SCORE}, {_SINGLE},
cand as (select sg.*, v.size, v.coverage from sg join deg v using (id) join deg p on p.id = prev join deg n on n.id = nxt where v.size <= 150 and p.sense >= 2 and n.antisense >= 2),
sib as (
  select c.id, 0 k, t.size > c.size a, t.coverage > c.coverage + 3 b from cand c join sc on sc.id = prev and s >= 0 join he h on h.src = prev and h.dir = 0 join deg t on t.id = h.dst where h.dst <> c.id
  union all
  select c.id, 1, t.size > c.size, t.coverage > c.coverage + 3 from cand c join sc on sc.id = nxt and s >= 0 join he h on h.src = nxt and h.dir = 1 join deg t on t.id = h.dst where h.dst <> c.id)"""


@query(sql(f"{_CHIMERIC} select distinct id from (select id, k from sib group by all having bool_and(a) or bool_and(b))", "graph"))
def chimeric(spark, sf_dir):
    return clean.chimeras(graph(spark, sf_dir), 150, genome=GENOME)


@query(sql("select distinct edge_key from (select edge_key, half, src, dst, (select count(*) from bars y join bars x on x.bx = y.bx where y.name = dst and x.name = src) n from he join deg on src = id where size > 50 and coverage > 1) where n <= 1", "graph"))
def linked_reads(spark, sf_dir):
    return clean.unlinked(graph(spark, sf_dir), 50, 1)


_COUNTERS = """
pr as (select distinct src x, dst y from he),
na as (select name, count(*) n from bars group by all),
cm as (select x, y, count(*) c, count(*) filter (b.n < a.n) mn, count(*) filter (b.n > a.n) mx, count(*) filter (b.n = a.n) md from pr join bars a on a.name = x join bars b on b.name = y and a.bx = b.bx group by all),
cnt as (select x, y, coalesce(a.n, 0) all_x, coalesce(b.n, 0) all_y, coalesce(c, 0) common_x, coalesce(c, 0) common_y, coalesce(mn, 0) link_min, coalesce(mx, 0) link_max, coalesce(md, 0) link_mid
  from pr left join na a on a.name = x left join na b on b.name = y left join cm using (x, y))"""


@query(sql(f"{_COUNTERS} select * from cnt", "graph"))
def barcode_features(spark, sf_dir):
    g = graph(spark, sf_dir)
    return features.barcode_counters(g, g.half_edges.select(F.col("src").alias("x"), F.col("dst").alias("y")))


def _links(alias: str, suffix: str) -> str:
    plain = [f"coalesce({alias}.{n}, 0)::double {m}_{suffix}" for n, m in zip(features.COUNTERS, features.LINKS[:7], strict=True)]
    ratio = [f"coalesce(case when {alias}.common_x = 0 or {alias}.common_y = 0 then 0 else {alias}.link_{m}::double / least({alias}.common_x, {alias}.common_y) end, 0)::double {m}ratio_{suffix}" for m in ("min", "max", "mid")]
    return ", ".join(plain + ratio)


def _vertex(alias: str, c: str) -> str:
    return f"{alias}.size::double len{c}, {alias}.coverage::double coverage{c}, ({alias}.size::double * {scores.READS} / {GENOME} - {alias}.coverage * ln(2::double)) repeat{c}, {alias}.antisense::double indegree{c}, {alias}.sense::double outdegree{c}, (greatest({alias}.coverage, 1) - 1)::double / {alias}.size point{c}"


_FEATURES = f"""{_COUNTERS},
rk as (select *, row_number() over (partition by src, dir order by overlap desc, dst, edge_key) - 1 r from he),
near as (select h.dir, c.* from (select distinct src, dst, dir from he) h join cnt c on c.x = h.src and c.y = h.dst qualify row_number() over (partition by h.dir, c.x order by link_min + link_mid + link_max desc, y desc) = 1),
oth as (select e.edge_key, e.half, count(*) filter (o.overlap >= e.overlap) n, count(*) filter (v.size >= w.size) k
  from he e join he o on o.src = e.dst and o.dir = 1 and (o.edge_key <> e.edge_key or o.half = e.half) join deg v on v.id = o.dst join deg w on w.id = e.src where e.dir = 0 group by all)
select e.edge_key, e.half::bigint half, e.src x, e.dst y, {_vertex('a', 'x')}, {_vertex('b', 'y')}, e.r::double orankx, coalesce(oth.n, 0)::double oranky, coalesce(oth.k, 0)::double sranky, e.overlap::double overlap,
  {_links('v', 'vx')}, {_links('c', 'xy')}, {_links('w', 'yw')}
from rk e join deg a on a.id = e.src join deg b on b.id = e.dst left join oth on oth.edge_key = e.edge_key and oth.half = e.half
  left join near v on v.x = e.src and v.dir = 1 left join cnt c on c.x = e.src and c.y = e.dst left join near w on w.x = e.dst and w.dir = 0 where e.dir = 0"""


@query(sql(_FEATURES, "graph"))
def edge_features(spark, sf_dir):
    return features.edge_features(graph(spark, sf_dir), genome=GENOME)


def _alignments(spark, sf_dir):
    """Where each read was cut from: a place on its document."""
    at = F.regexp_extract("name", r"\.(\d+)/", 1).cast("long") * 2 + F.right("name", F.lit(1)).cast("long") - 1
    return unique_reads(spark, sf_dir).select(F.col("name").alias("id"), F.lit("100=").alias("cigar"), F.split("name", r"\.")[0].alias("chr"), (at * 40).alias("pos"))


@query(sql("""al as (select name id, split_part(name, '.', 1) chr, (cast(regexp_extract(name, '\\.(\\d+)/', 1) as bigint) * 2 + cast(right(name, 1) as bigint) - 1) * 40 pos from uread)
select edge_key, half::bigint half, (a.chr = b.chr and a.pos + d.size - overlap = b.pos)::bigint as label from he join al a on a.id = src join al b on b.id = dst join deg d on d.id = src where dir = 0""", "graph"))
def edge_labels(spark, sf_dir):
    return features.labels(graph(spark, sf_dir), _alignments(spark, sf_dir))


@query()
def edge_votes(spark, sf_dir):
    g = graph(spark, sf_dir)
    table = shared(spark, sf_dir, "features", lambda: features.edge_features(g, genome=GENOME))
    return features.votes(table, features.fit_bag(table.join(features.labels(g, _alignments(spark, sf_dir)), ["edge_key", "half"])))


@query(sql("over_ as (select distinct edge_key from (select edge_key, row_number() over (partition by src, dir order by overlap desc, dst, edge_key) r from he) where r > 2) select distinct edge_key from he where edge_key not in (select edge_key from over_)", "graph"))
def max_edges_cap(spark, sf_dir):
    return model.cap_edges(graph(spark, sf_dir), 2).half_edges.select("edge_key").distinct()


_CHAINS = f"""
ar as (select src, dir = 1 src_rc, dst, twin_dir = 0 dst_rc, overlap, count(*) over (partition by src, dir) a, count(*) over (partition by dst, twin_dir) b from he),
li as (select ar.*, size - overlap step from ar join deg on id = src where a = 1 and b = 1 and src <> dst),
nd as (select id, rc from deg, (values (false), (true)) t(rc)),
ch as (
  select id head, rc head_rc, id, rc, 0 pos, 0::bigint bp, 0::bigint ov from nd where not exists (select 1 from li where dst = id and dst_rc = rc)
  union all select head, head_rc, li.dst, li.dst_rc, pos + 1, bp + step, li.overlap from ch join li on li.src = ch.id and li.src_rc = ch.rc),
rn as (select id, rc from nd anti join ch using (id, rc)),
rw as (
  select id s, rc s_rc, id, rc, 0 pos, 0::bigint bp, 0::bigint ov from rn
  union all select s, s_rc, li.dst, li.dst_rc, pos + 1, bp + step, li.overlap from rw join li on li.src = rw.id and li.src_rc = rw.rc where (li.dst, li.dst_rc) <> (s, s_rc)),
rh as (select s, s_rc from rw group by all having (s, s_rc) = min((id, rc))),
al as (select head, head_rc, id, rc, pos, bp, ov, false ring from ch union all select s, s_rc, id, rc, pos, bp, case when pos = 0 then 0 else ov end, true from rw join rh using (s, s_rc)),
tl as (select head, head_rc from al group by all having case when bool_or(ring) then not head_rc else (head, head_rc) <= (arg_max(id, pos), not arg_max(rc, pos)) end),
kp as (select al.* from al join tl using (head, head_rc)),
ctg as (select min(k.id) id, string_agg(substr(case when k.rc then {rc('d.seq')} else d.seq end, cast(ov + 1 as int)), '' order by pos) seq, count(*) n_reads, sum(d.coverage)::bigint coverage
  from kp k join deg d on d.id = k.id group by head, head_rc)"""


def _kept(spark, sf_dir):
    return shared(spark, sf_dir, "kept-chains", lambda: paths.kept_chains(graph(spark, sf_dir)))


@query(sql(f"{_CHAINS} select id, seq, n_reads, coverage from ctg", "graph", recursive=True))
def unitigs(spark, sf_dir):
    return paths.contigs(graph(spark, sf_dir), _kept(spark, sf_dir)).select("id", "seq", "n_reads", "coverage")


@query(sql(f"""{_CHAINS}, ln_ as (select length(seq) n, sum(length(seq)) over (order by length(seq) desc) s, sum(length(seq)) over () t from ctg)
select count(*) n_contigs, sum(n)::bigint total, max(n) longest, max(n) filter (s >= t * 0.5) n50, max(n) filter (s >= t * 0.9) n90 from ln_""", "graph", recursive=True))
def contig_stats(spark, sf_dir):
    return paths.contig_statistics(paths.contigs(graph(spark, sf_dir), _kept(spark, sf_dir)))


_ROOT = "root as (select id from deg order by sense + antisense desc, id limit 1)"


def _root(spark, sf_dir):
    return model.degrees(graph(spark, sf_dir)).orderBy(F.desc(F.col("sense") + F.col("antisense")), "id").limit(1).select("id")


@query(sql(f"{_ROOT}, kh as (select id, 0 hop from root union select he.dst, hop + 1 from kh join he on he.src = kh.id where hop < 5) select id, min(hop)::bigint hop from kh group by all", "graph", recursive=True))
def subgraph_khop(spark, sf_dir):
    return paths.khop(graph(spark, sf_dir), _root(spark, sf_dir), 5)


@query(sql(f"{_ROOT}, kh as (select id, 0 hop from root union select he.dst, hop + 1 from kh join he on he.src = kh.id where hop < 2) select distinct edge_key from he join kh on src = id where hop < 2", "graph", recursive=True))
def subgraph_edges(spark, sf_dir):
    return paths.subgraph(graph(spark, sf_dir), _root(spark, sf_dir), 2).half_edges.select("edge_key").distinct()


_STEPS = "st as (select src, dst, dir, dir = twin_dir rev, case when dir = 0 then a.size - overlap else overlap - b.size end step from he join deg a on a.id = src join deg b on b.id = dst)"
_WALK = "union select root, st.dst, distance + case when up = 0 then abs(step) else -abs(step) end, up, case when rev then 1 - own else own end from wk join st on st.src = wk.id and st.dir = own where abs(distance) <"


@query(sql(f"{_ROOT}, {_STEPS}, wk as (select id root, id, 0::bigint distance, d::bigint up, d::bigint own from root, (values (0), (1)) t(d) {_WALK} 400) select root, id, distance, up as dir, (up <> own)::bigint comp from wk where id <> root or distance <> 0", "graph", recursive=True))
def bfs_distance(spark, sf_dir):
    return paths.walks(graph(spark, sf_dir), _root(spark, sf_dir), 400)


_MATES = "mt as (select a.id, b.id mate from deg a join deg b on b.id = left(a.id, length(a.id) - 1) || translate(right(a.id, 1), '12', '21'))"


@query(sql(f"{_CHAINS}, {_MATES} select count(*) n, floor(avg(abs(a.bp - b.bp)))::bigint mean, floor(stddev_pop(abs(a.bp - b.bp)))::bigint deviation from kp a join mt on mt.id = a.id and a.id < mate join kp b on b.id = mate and b.head = a.head and b.head_rc = a.head_rc", "graph", recursive=True))
def insert_size(spark, sf_dir):
    return paths.insert_size(paths.insert_sizes(graph(spark, sf_dir), _kept(spark, sf_dir)))


_PAIRED = f"""{_STEPS}, {_MATES},
wk as (select id root, id, 0::bigint distance, d::bigint up, d::bigint own from mt, (values (0), (1)) t(d) {_WALK} 160),
re as (select root, id, min(abs(distance)) distance from wk where id <> root or distance <> 0 group by all),
lk as (select n.root src, n.id dst, n.distance from re n join mt a on a.id = n.root join mt b on b.id = n.id join re f on f.root = a.mate and f.id = b.mate
  where n.distance <= 80 and n.distance > 0 and n.root <> n.id and f.distance <= n.distance + 80)"""


def _paired_links(spark, sf_dir):
    return shared(spark, sf_dir, "paired-links", lambda: paths.paired_links(graph(spark, sf_dir), 80, 20))


@query(sql(f"{_PAIRED} select src, dst, distance from lk", "graph", recursive=True))
def paired_links(spark, sf_dir):
    return _paired_links(spark, sf_dir)


@query(sql(f"{_PAIRED} select src, dst, distance from lk l where not exists (select 1 from lk a join lk b on a.dst = b.src where a.src = l.src and b.dst = l.dst and a.distance < l.distance)", "graph", recursive=True))
def paired_links_direct(spark, sf_dir):
    return paths.direct_links(_paired_links(spark, sf_dir))


@query()
def assemble_contigs(spark, sf_dir):
    return assemble.assemble(graph(spark, sf_dir), assemble.Options(genome=GENOME, max_overlap_delta=5)).contigs


_REST = "case when {1} = 1 then substr({0}, cast(overlap + 1 as int)) else left({0}, cast(length({0}) - overlap as int)) end"


def _label(seq: str) -> str:
    rest = _REST.format(seq, "twin_dir")
    return f"case when dir = twin_dir then {rc(rest)} else {rest} end"


@query(sql(f"select edge_key, half::bigint half, {_label('seq')} as rest from he join uread on dst = name", "graph"))
def edge_rest(spark, sf_dir):
    """What the end of a half-edge has beyond the overlap, read on from its source."""
    g = graph(spark, sf_dir)
    rows = g.half_edges.join(g.vertices.select(F.col("id").alias("dst"), "seq"), "dst")
    n, size = F.col("overlap"), F.length("seq")
    start = F.when(F.col("twin_dir") == model.ANTISENSE, 0).otherwise(size - n)
    return rows.select("edge_key", "half", dna.edge_label("seq", start, start + n - 1, F.col("dir") == F.col("twin_dir")).alias("rest"))


@query(sql(f"select edge_key, half::bigint half from (select he.*, row_number() over (partition by src, dir, overlap, {_label('seq')} order by dst, edge_key) r from he join uread on dst = name) where r = 1", "graph"))
def reduced_edges(spark, sf_dir):
    return paths.reduced(graph(spark, sf_dir)).select("edge_key", "half")


@query(sql(f"select edge_key, half::bigint half, d::bigint as shift from (select he.*, d, a.seq x, case when dir = twin_dir then {rc('b.seq')} else b.seq end y from he join uread a on a.name = src join uread b on b.name = dst, (values (0), (1)) t(d)) where case when dir = 0 then starts_with(y, substr(x, cast(length(x) - overlap + d + 1 as int))) else starts_with(x, substr(y, cast(length(y) - overlap + d + 1 as int))) end", "graph"))
def consistent_links(spark, sf_dir):
    """Half-edges as links, with their own distance and one that is a base more: which of them the sequences bear out."""
    g = graph(spark, sf_dir)
    seq = lambda c: g.vertices.select(F.col("id").alias(c), F.col("seq").alias(f"_{c}"))
    rows = g.half_edges.join(seq("src"), "src").join(seq("dst"), "dst").withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    size = F.when(F.col("dir") == model.SENSE, F.length("_src")).otherwise(F.length("_dst"))
    sure = links.holds(F.col("_src"), F.col("_dst"), size - F.col("overlap") + F.col("shift"), F.col("dir"), (F.col("dir") == F.col("twin_dir")).cast("int"))
    return rows.where(sure).select("edge_key", "half", "shift")


@query("select d1, c1, d2, c2, case when c1 = 0 then d1 else 1 - d1 end as dir, (case when c1 = 0 then 1 - d1 else d1 end <> case when c2 = 0 then 1 - d2 else d2 end)::bigint as comp from (values (0::bigint), (1)) a(d1), (values (0::bigint), (1)) b(c1), (values (0::bigint), (1)) c(d2), (values (0::bigint), (1)) d(c2)")
def link_algebra(spark, sf_dir):
    """The link between the ends of two links, by their directions and strands."""
    bits = spark.range(16).select(*[((F.col("id") / (1 << k)).cast("int") % 2).alias(n) for k, n in enumerate(("d1", "c1", "d2", "c2"))])
    _, direction, comp = links.between(F.lit(0), F.col("d1"), F.col("c1"), F.lit(5), F.col("d2"), F.col("c2"))
    return bits.select("*", direction.alias("dir"), comp.alias("comp"))


_LONG = "160"
_NEAR = f"""{_STEPS}, {_MATES},
nw as (select root, dst id, case when dir = 0 then step else -abs(step) end::bigint distance, dir::bigint up, (case when rev then 1 - dir else dir end)::bigint own
  from (select m.id root, st.* from mt m join deg on deg.id = m.id and size > 80 join st on st.src = m.id where dir = 0 or rev)
  union select root, st.dst, distance + case when up = 0 then abs(step) else -abs(step) end, up, case when rev then 1 - own else own end from nw join st on st.src = nw.id and st.dir = own where abs(distance) < 80),
wk as (select id root, id, 0::bigint distance, d::bigint up, d::bigint own from mt, (values (0), (1)) t(d) {_WALK} {_LONG}),
fr as (select root, id, min(abs(distance)) far from wk where id <> root or distance <> 0 group by all),
sr as materialized (select n.root, n.id, n.distance, up as dir, (up <> own)::bigint comp from nw n join mt a on a.id = n.root join mt b on b.id = n.id join fr f on f.root = a.mate and f.id = b.mate
  where abs(distance) < 80 and distance <> 0 and n.root <> n.id and far < abs(distance) + 80),
l0 as (select root s, id t, distance, dir, comp from sr
  union all select a.id, b.id, b.distance - a.distance, case when a.comp = 0 then a.dir else 1 - a.dir end, (case when a.comp = 0 then a.dir else 1 - a.dir end <> case when b.comp = 0 then b.dir else 1 - b.dir end)::bigint
  from sr a join sr b on a.root = b.root and abs(a.distance) < abs(b.distance) and (a.distance < 0) = (b.distance < 0) and a.id <> b.id),
l1 as (select distinct case when distance < 0 then t else s end src, case when distance < 0 then s else t end dst, abs(distance) distance, case when distance < 0 and comp = 0 then 1 - dir else dir end dir, comp, root_ from (select *, exists (select 1 from sr where root = s and id = t and sr.distance = l0.distance and sr.dir = l0.dir and sr.comp = l0.comp) root_ from l0)),
hs as (select l1.*, a.seq x, case when comp = 1 then {rc('b.seq')} else b.seq end y from l1 join uread a on a.name = src join uread b on b.name = dst),
l2 as (select src, dst, distance, dir, comp from hs where root_ or (dir = 0 and distance < length(x) and starts_with(y, substr(x, cast(distance + 1 as int)))) or (dir = 1 and distance < length(y) and starts_with(x, substr(y, cast(distance + 1 as int))))),
pl2 as materialized (select * from l2 qualify row_number() over (partition by src, dst order by distance, dir, comp) = 1)"""


def _pair_links(spark, sf_dir):
    return shared(spark, sf_dir, "pair-links", lambda: paths.pair_links(graph(spark, sf_dir), 80, 20, None))


@query(sql(f"{_NEAR} select * from pl2", "graph", recursive=True))
def pair_links(spark, sf_dir):
    return _pair_links(spark, sf_dir)


_NEAREST = f"""{_NEAR},
pr2 as (select a.src, b.dst far, a.dst u, b.dst w, b.distance - a.distance distance, case when a.comp = 0 then a.dir else 1 - a.dir end d2,
  (case when a.comp = 0 then 1 - a.dir else a.dir end <> case when b.comp = 0 then 1 - b.dir else b.dir end)::bigint c2
  from pl2 a join pl2 b on a.src = b.src and a.dir = b.dir and (a.distance, a.dst) < (b.distance, b.dst)),
pr3 as (select src, far, case when distance < 0 then w else u end u, case when distance < 0 then u else w end w, abs(distance) distance, case when distance < 0 and c2 = 0 then 1 - d2 else d2 end d2, c2 from pr2),
gn2 as (select distinct src, far from (select pr3.*, a.seq x, case when c2 = 1 then {rc('b.seq')} else b.seq end y from pr3 join uread a on a.name = u join uread b on b.name = w)
  where (d2 = 0 and distance < length(x) and starts_with(y, substr(x, cast(distance + 1 as int)))) or (d2 = 1 and distance < length(y) and starts_with(x, substr(y, cast(distance + 1 as int))))),
nl as materialized (select pl2.* from pl2 left join gn2 on gn2.src = pl2.src and gn2.far = pl2.dst where gn2.src is null)"""


@query(sql(f"{_NEAREST} select * from nl", "graph", recursive=True))
def nearest_links(spark, sf_dir):
    return shared(spark, sf_dir, "nearest-links", lambda: paths.nearest_links(graph(spark, sf_dir), _pair_links(spark, sf_dir)))


@query(sql(f"""{_NEAREST},
aq as (select src, dst, dir, case when comp = 1 then dir else 1 - dir end twin_dir, case when dir = 0 then a.size else b.size end - distance overlap, a.size sa, b.size sb from nl join deg a on a.id = src join deg b on b.id = dst),
aq2 as (select src, dst, dir, twin_dir, overlap from aq where overlap > 0 and overlap < sa and overlap < sb),
kn as (select distinct edge_key from he join aq2 using (src, dst, dir, twin_dir, overlap)),
fs as (select aq2.* from aq2 anti join he using (src, dst, dir, twin_dir, overlap)),
fd as (select distinct case when sw then dst else src end src, case when sw then src else dst end dst, case when sw then twin_dir else dir end dir, case when sw then dir else twin_dir end twin_dir, overlap
  from (select *, (dst, twin_dir) < (src, dir) sw from fs)),
ad as (select '+ ' || src || ' ' || dst || ' ' || dir || ' ' || twin_dir || ' ' || overlap edge_key, 0 half, src, dst, dir, twin_dir, overlap from fd
  union all select '+ ' || src || ' ' || dst || ' ' || dir || ' ' || twin_dir || ' ' || overlap, 1, dst, src, twin_dir, dir, overlap from fd),
al2 as (select edge_key, half, src, dst, dir, twin_dir, overlap from he union all select * from ad),
tr as (select edge_key from kn union select edge_key from ad),
sd as (select distinct src, dir from al2 semi join tr using (edge_key)),
bk as (select distinct edge_key from al2 semi join sd using (src, dir) where edge_key not in (select edge_key from tr))
select edge_key, half::bigint half, src, dst, dir::bigint dir, twin_dir::bigint twin_dir, overlap::bigint overlap from al2 where edge_key not in (select edge_key from bk)""", "graph", recursive=True))
def resolved_edges(spark, sf_dir):
    """The graph with true edges added and their rivals gone."""
    found = nearest_links(spark, sf_dir)
    return paths.with_links(graph(spark, sf_dir), found)[0].half_edges


@query(sql(f"""rp as (select id, size::double * {scores.READS} / {GENOME} - coverage * ln(2::double) r from deg),
dg as (select src, dir, count(*) n from he group by all),
cd as (select he.* from he join dg on dg.src = he.src and dg.dir = he.dir and n = 1 join rp a on a.id = he.src join rp b on b.id = he.dst
  where he.dst in (select src from dg where n > 1) and a.r >= 0.5 and b.r < a.r and he.src <> he.dst qualify row_number() over (partition by he.src order by he.dir) = 1)
select src as id, dst as "end", dir::bigint as dir from cd""", "graph"))
def repeat_copies(spark, sf_dir):
    return paths.split_repeats(graph(spark, sf_dir), 0.5, genome=GENOME)[1]


def _uneven(g: model.Graph) -> model.Graph:
    """The graph with second mates covered better, so that some vertices stand out."""
    more = F.when(F.col("id").endswith("2"), 6).otherwise(0)
    return model.Graph(g.vertices.withColumn("coverage", F.col("coverage") + more), g.half_edges)


@query(sql(f"{_CHIMERIC} select distinct id from (select id, k from sib group by all having bool_and(a) or bool_and(b))", "graph").replace("deg as materialized (", "deg as materialized (select id, size, seq, coverage + case when id like '%2' then 6 else 0 end coverage, sense, antisense from (").replace("left join he on name = src group by all),", "left join he on name = src group by all)),"))
def chimeric_uneven(spark, sf_dir):
    return clean.chimeras(_uneven(graph(spark, sf_dir)), 150, genome=GENOME)


_WHOLE = "wh as (select id0, id1, case when half_ then 0 else s0 end s0, case when half_ then l0 - 1 else e0 end e0, l0, case when half_ then 0 else s1 end s1, case when half_ then l1 - 1 else e1 end e1, l1 from (select *, length(id0) % 2 = 0 half_ from ed))"


def _whole_edges(spark, sf_dir):
    """Edges of which some cover both reads whole."""
    whole = F.length("id0") % 2 == 0
    set_to = lambda c, v: F.when(whole, v).otherwise(F.col(c)).alias(c)
    return edges(spark, sf_dir).select("id0", "id1", set_to("s0", F.lit(0)), set_to("e0", F.col("l0") - 1), "l0", set_to("s1", F.lit(0)), set_to("e1", F.col("l1") - 1), "l1")


@query(sql(f"{_WHOLE} select id0 || ' ' || id1 || ' ' || s0 || ' ' || s1 || ' ' || d as edge_key, h::bigint half, case when h = 0 then id0 else id1 end src, case when h = 0 then id1 else id0 end dst, d::bigint dir, d::bigint twin_dir, (e0 - s0 + 1)::bigint overlap from wh, (values (0), (1)) t(d), (values (0), (1)) u(h) where (s0 = 0 and e0 = l0 - 1) or (s1 = 0 and e1 = l1 - 1)", "edges"))
def containment_edges(spark, sf_dir):
    return model.containment_halves(_whole_edges(spark, sf_dir))


@query(sql(f"{_WHOLE} select distinct greatest(id0, id1) as id from wh where s0 = 0 and e0 = l0 - 1 and s1 = 0 and e1 = l1 - 1", "edges"))
def contained_vertices(spark, sf_dir):
    """Of two reads that cover each other whole the greater name is contained."""
    return model.contained_ids(_whole_edges(spark, sf_dir))


@query(sql("select name as id from (select name, row_number() over (partition by least(seq, " + rc("seq") + ") order by name) r from reads) where r > 1", "reads"))
def identical_vertices(spark, sf_dir):
    return clean.identical(model.Graph(model.vertices_of(reads(spark, sf_dir)), None))


@query(sql(f"""{_SINGLE}, lp as (select sg.id, prev u, p.twin_dir leave, p.overlap po, n.overlap no_ from sg join he p on p.src = sg.id and p.dir = 1 join he n on n.src = sg.id and n.dir = 0 where prev = nxt and prev <> sg.id and p.twin_dir <> n.twin_dir),
l1 as (select * from lp qualify row_number() over (partition by u order by id) = 1),
sq as (select l1.*, case when leave = 0 then a.seq else {rc('a.seq')} end us, v.seq vs, a.coverage + v.coverage cov from l1 join deg a on a.id = u join deg v on v.id = l1.id),
pt as (select u, us || substr(vs, cast(po + 1 as int)) || substr(us, cast(no_ + 1 as int)) s, leave, cov from sq)
select d.id, coalesce(case when leave = 0 then s else {rc('s')} end, d.seq) seq, coalesce(cov, d.coverage) coverage from deg d left join pt on u = d.id where d.id not in (select id from l1)""", "graph"))
def unrolled_loops(spark, sf_dir):
    return clean.unroll_loops(graph(spark, sf_dir))[0].vertices.select("id", "seq", "coverage")
