"""Registry of queries, the tables they share, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..graph import model
from ..operators import dedup, overlap
from ..plans.storage import materialise
from ..sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Overlaps of the catalogue's graphs have at least so many bases.
MIN_OVERLAP = 50

_tables: dict[tuple, DataFrame] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir); whole numbers are returned as longs. sql: the oracle."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def shared(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session build on, written once to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = materialise(make(), name)
    return _tables[key]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.load(spark, sf_dir)


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as a sequencer has them: some in lower case, with unknown bases, or starting with a primer."""
    k = F.col("read_idx") % 1_000_000
    seq = F.replace("seq", F.lit("CATAG"), F.lit("CANAG"))
    seq = F.when(k % 7 == 3, F.concat(F.lit(dna.PRIMERS[0][:14]), F.substring(seq, 15, 1000))).otherwise(seq)
    return reads(spark, sf_dir).withColumn("seq", F.when(k % 2 == 1, F.lower(seq)).otherwise(seq))


def varied_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of several lengths, so that some stand within others."""
    n = 100 - 15 * (F.col("read_idx") % 3)
    return reads(spark, sf_dir).withColumns({"seq": F.left("seq", n), "quality": F.left("quality", n)})


def unique_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, seq, coverage, barcodes): one of each sequence, with how many reads have it and from which sources."""

    def make():
        own = reads(spark, sf_dir)
        kept, _ = dedup.rmdup(own)
        entries = own.groupBy(dna.canonical("seq").alias("_c"), "barcode").agg(F.count("*").alias("n"))
        lists = entries.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct(F.col("barcode").alias("bx"), "n"))).alias("barcodes"))
        return kept.withColumn("_c", dna.canonical("seq")).join(lists, "_c").select("name", "seq", F.col("n_duplicates").alias("coverage"), "barcodes")

    return shared(spark, sf_dir, "unique", make)


def found_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "overlaps", lambda: overlap.overlaps(unique_reads(spark, sf_dir), MIN_OVERLAP))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = unique_reads(spark, sf_dir)
    return shared(spark, sf_dir, "edges", lambda: overlap.edges(overlap.irreducible(found_overlaps(spark, sf_dir), own), own))


def graph(spark: SparkSession, sf_dir: str) -> model.Graph:
    whole = lambda: model.build(unique_reads(spark, sf_dir), edges(spark, sf_dir))
    return model.Graph(shared(spark, sf_dir, "graph-vertices", lambda: whole().vertices), shared(spark, sf_dir, "graph-edges", lambda: whole().half_edges))


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


_RAW = f"""
raw as (
  select read_idx, name, quality, barcode, case when k % 2 = 1 then lower(x) else x end as seq, k from (
    select *, case when k % 7 = 3 then '{dna.PRIMERS[0][:14]}' || substr(y, 15) else y end as x from (select *, replace(seq, 'CATAG', 'CANAG') y from reads)))"""
_VARIED = """
varied as (select read_idx, name, substr(seq, 1, cast(100 - 15 * (read_idx % 3) as int)) seq, substr(quality, 1, cast(100 - 15 * (read_idx % 3) as int)) quality, barcode from reads)"""
_UNIQUE = f"""
uread as materialized (select arg_min(seq, name) seq, min(name) as name, count(*) coverage from reads group by least(seq, {rc('seq')})),
bars as materialized (select u.name, b.bx, b.n from (select least(seq, {rc('seq')}) c, barcode bx, count(*) n from reads group by all) b join uread u on b.c = least(u.seq, {rc('u.seq')}))"""
_OVERLAPS = f"""
ori as materialized (select name, false rc, seq from uread union all select name, true, {rc('seq')} from uread),
pl as (select name q, rc q_rc, seq, unnest(range(2, length(seq) - {MIN_OVERLAP} + 2)) p from ori),
ov as materialized (
  select q, q_rc, o.name t, o.rc t_rc, max(length(pl.seq) - p + 1) length
  from pl join ori o on substr(pl.seq, p, {MIN_OVERLAP}) = substr(o.seq, 1, {MIN_OVERLAP})
  where pl.q <> o.name and starts_with(o.seq, substr(pl.seq, p)) and length(pl.seq) - p + 1 < length(o.seq) group by all)"""
_REDUCED = """
ext as materialized (select ov.*, substr(ori.seq, cast(length + 1 as int)) ext from ov join ori on t = name and t_rc = rc),
there as materialized (select q, q_rc, ext start, max(length) longer from ext group by all),
sizes as materialized (select distinct q, q_rc, length(ext) n from ext),
gone as materialized (
  select distinct a.q, a.q_rc, a.t, a.t_rc from ext a join sizes z on z.q = a.q and z.q_rc = a.q_rc and n <= length(a.ext)
  join there h on h.q = a.q and h.q_rc = a.q_rc and h.start = left(a.ext, n) and h.longer > a.length),
irr as (select * from ext anti join gone using (q, q_rc, t, t_rc))"""
_EDGES = """
ed as materialized (
  select q id0, t id1, case when q_rc then 0 else l0 - length end s0, case when q_rc then length - 1 else l0 - 1 end e0, l0,
         case when t_rc then l1 - length else 0 end s1, case when t_rc then l1 - 1 else length - 1 end e1, l1,
         cast(q_rc <> t_rc as bigint) is_rc, cast(0 as bigint) num_diff
  from (select irr.*, length(a.seq) l0, length(b.seq) l1 from irr join uread a on q = a.name join uread b on t = b.name) where q > t)"""
_GRAPH = """
he as materialized (
  select id0 || ' ' || id1 || ' ' || s0 || ' ' || s1 edge_key, 0 half, id0 src, id1 dst, case when s0 = 0 then 1 else 0 end dir,
         case when s1 = 0 then 1 else 0 end twin_dir, e0 - s0 + 1 overlap from ed
  union all
  select id0 || ' ' || id1 || ' ' || s0 || ' ' || s1, 1, id1, id0, case when s1 = 0 then 1 else 0 end, case when s0 = 0 then 1 else 0 end, e0 - s0 + 1 from ed),
deg as materialized (
  select name id, length(seq) size, seq, coverage, coalesce(sum(case when dir = 0 then 1 end), 0)::bigint sense, coalesce(sum(case when dir = 1 then 1 end), 0)::bigint antisense
  from uread left join he on name = src group by all)"""
_PARTS = {"reads": derived.SQL, "raw": _RAW, "varied": _VARIED, "unique": _UNIQUE, "overlaps": _OVERLAPS, "reduced": _REDUCED, "edges": _EDGES, "graph": _GRAPH}
_NEEDS = {"raw": ["reads"], "varied": ["reads"], "unique": ["reads"], "overlaps": ["unique"], "reduced": ["overlaps"], "edges": ["reduced"], "graph": ["edges"], "reads": []}


def sql(tail: str, *parts: str, recursive: bool = False) -> str:
    """An oracle: the tables named, those that they build on, and the query."""
    order: list[str] = []

    def add(p: str) -> None:
        for q in _NEEDS[p]:
            add(q)
        if p not in order:
            order.append(p)

    for p in parts:
        add(p)
    head = ",".join(_PARTS[p] for p in order)
    return f"with {'recursive ' if recursive else ''}{head}{',' if not tail.lstrip().startswith('select') else ''} {tail}"
