"""Operator 2: mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

A document's key is -ln(u) / weight, u from the md5 of its id: the smallest keys of a source are a sample without
replacement in proportion to weight. Whole epochs of a source come first; of the rest of its target, documents are
taken by rising key until the words run out.

Where they run out is one place in the order of a source, its border. It is found from sums of narrow ranges of the
key (cells, the same share of a key's size everywhere, so that none has more than some 4,000th of a source whatever
the weights), then from sums of equal rows in the border's cell, then by counting among the equal rows at the border
itself. Every document compares itself with its source's border: neither texts nor rows are sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Cells for each doubling of the key.
CELLS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def plausible_words(text: Column, size: Column) -> Column:
    """A quality weight that needs no model: 1 where letters per word are those of prose, else 0.25."""
    per_word = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.when(per_word.between(3.0, 12.0), F.lit(1.0)).otherwise(F.lit(0.25))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """totals (_src, _none, source_size) with target: share of all words by weight, none above max_epochs times its size.

    Sources weigh ``weights`` in turn, by code point, null last. Water-filling in closed form: in rising order of
    cap / weight, the first source whose equal share is within its cap sets the level for all after it.
    """
    in_order = Window.orderBy("_none", "_src")
    weighed = totals.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("_cap", F.col("source_size") * max_epochs)
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), "_none", "_src")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    filled = weighed.withColumn("_place", F.row_number().over(filling)).withColumn("_level", level)
    fits = F.col("_level") <= F.col("_cap") / F.col("_w")
    filled = filled.withColumn("_level", F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_place"))).over(everything))
    return filled.select("_src", "_none", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double"))).alias("target"))


_SOURCE = ["_src", "_none"]
_ORDER = ["_key", "_id", "size", "_tie"]


def _sized(docs: DataFrame, keep: list[str], weight: Column | None) -> DataFrame:
    """A row for each of docs: what is kept, its source, and its place in the source's order."""
    sized = docs.select(
        *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        F.col("doc_id").alias("_id"),
        F.coalesce("source", F.lit("")).alias("_src"),
        F.col("source").isNull().alias("_none"),
        n_words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("_tie"),
        F.monotonically_increasing_id().alias("_row"),
        (F.lit(None) if weight is None else weight).cast("double").alias("_weight"),
        F.col("text").alias("_text"),
    )
    chosen = plausible_words(F.col("_text"), F.col("size")) if weight is None else F.col("_weight")
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    sized = sized.withColumn("_key", -F.ln((digits + 0.5) / F.lit(float(1 << 48))) / chosen).drop("_weight", "_text")
    return sized.withColumn("_cell", F.floor(F.log2("_key") * CELLS))


def _place(prefix: str = "") -> Column:
    """What the order within a source goes by: key, id (null first), size, text."""
    c = lambda name: F.col(prefix + name)
    return F.struct(c("_key").alias("k"), c("_id").isNotNull().alias("some"), F.coalesce(c("_id"), F.lit(0)).alias("id"), c("size").alias("size"), c("_tie").alias("tie"))


def borders(numbers: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(_src, _none, source_size, target, epochs, b_*): a row for each source of numbers, the rows of _sized().

    Rows before the border (b_cell, b_place) are taken once more than epochs; of those equal to it the ones with row
    numbers up to b_row, which is null if there are none. b_place is null where all of the cell are taken.
    """
    cells = materialise(numbers.groupBy(*_SOURCE, "_cell").agg(F.sum("size").alias("_sum")), "mix-cells", numbers.count())
    few = cells.select(*_SOURCE).distinct().count()
    targets = source_targets(cells.groupBy(*_SOURCE).agg(F.sum("_sum").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    targets = targets.withColumn("epochs", epochs).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = materialise(targets, "mix-targets", few)
    # A source has no more cells than its keys have doublings, a thousand times.
    upto = cells.withColumn("_upto", F.sum("_sum").over(Window.partitionBy(*_SOURCE).orderBy("_cell"))).join(targets, _SOURCE)
    border = upto.where(F.col("_upto") > F.col("_rest")).groupBy(*_SOURCE).agg(F.min_by(F.struct(F.col("_cell").alias("cell"), (F.col("_upto") - F.col("_sum")).alias("first")), "_cell").alias("b"))
    border = materialise(targets.join(border, _SOURCE, "left"), "mix-border-cells", few)
    inside = border.select(*_SOURCE, "_rest", F.col("b.cell").alias("_cell"), F.col("b.first").alias("_first"))
    groups = numbers.join(inside, [*_SOURCE, "_cell"]).groupBy(*_SOURCE, "_cell", "_rest", "_first", *_ORDER).agg(F.count("*").alias("_n"))
    before = F.sum(F.col("_n") * F.col("size")).over(Window.partitionBy(*_SOURCE).orderBy(_place()).rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("_before", F.col("_first") + F.coalesce(before, F.lit(0)))
    fits = (2 * F.col("_before") + F.col("size")) <= 2 * F.col("_rest")
    several = F.floor((2 * F.col("_rest") - 2 * F.col("_before") - F.col("size")) / F.greatest(2 * F.col("size"), F.lit(1))) + 1
    taken = F.when(~fits, F.lit(0)).when((F.col("_n") == 1) | (F.col("size") == 0), F.col("_n")).otherwise(F.least(several, F.col("_n")))
    first = groups.withColumn("_m", taken.cast("long")).where(F.col("_m") < F.col("_n"))
    first = first.withColumn("_p", _place()).groupBy(*_SOURCE).agg(F.min_by(F.struct("_p", "_m"), "_p").alias("g"))
    found = border.join(first, _SOURCE, "left")
    found = found.select(*_SOURCE, "source_size", "target", "epochs", F.col("b.cell").alias("b_cell"), F.col("g._p").alias("b_place"), F.col("g._m").alias("_m"))
    found = materialise(found, "mix-borders", few)
    if not found.where("_m > 0").limit(1).count():
        return found.drop("_m").withColumn("b_row", F.lit(None).cast("long"))
    # Equal rows at a border are counted off in the order of their row numbers, one part of the table at a time.
    part = F.shiftright("_row", 33)
    equal = numbers.join(found.where("_m > 0").select(*_SOURCE, F.col("b_cell").alias("_cell"), "b_place", "_m"), [*_SOURCE, "_cell"])
    equal = materialise(equal.where(_place() == F.col("b_place")).select(*_SOURCE, "_m", "_row", part.alias("_part")), "mix-equal")
    parts = equal.groupBy(*_SOURCE, "_part").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_first", F.sum("_n").over(Window.partitionBy(*_SOURCE).orderBy("_part")) - F.col("_n")).drop("_n")
    number = F.row_number().over(Window.partitionBy(*_SOURCE, "_part").orderBy("_row"))
    last = equal.withColumn("_in", number).join(parts, [*_SOURCE, "_part"]).where(F.col("_first") + F.col("_in") == F.col("_m"))
    last = last.select(*_SOURCE, F.col("_row").alias("b_row"))
    return materialise(found.drop("_m").join(last, _SOURCE, "left"), "mix-borders", few)


def mix(docs: DataFrame, *, keep: list[str] | None = None, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows of docs (doc_id, text, source) with size, source_size, target, copies and taken (= copies * size).

    keep: the columns of docs to carry along, doc_id alone by default. Null or wordless texts have size 0; a source
    without any word has target 0 and its documents one copy each. Null ids share one key; equal keys go by id, then
    size, then text, and rows equal in all of these as they stand in docs. The document at the border is taken if at
    least half of it is within the budget. An empty table gives no rows; texts of any length are counted whole.
    docs is read twice if more is kept than ids: it should be a table, whose rows come in the same order again.
    """
    keep = keep or ["doc_id"]
    placed = _sized(docs, keep, weight)
    numbers = [*_SOURCE, *_ORDER, "_row", "_cell"]
    if keep == ["doc_id"]:
        placed = materialise(placed, "mix-sizes")
        held = placed.select(*numbers)
    else:
        held = materialise(placed.select(*numbers), "mix-sizes")
    met = placed.join(borders(held, weights, share, max_epochs), _SOURCE)
    own = _place()
    inside = F.col("b_place").isNull() | (own < F.col("b_place")) | ((own == F.col("b_place")) & F.coalesce(F.col("_row") <= F.col("b_row"), F.lit(False)))
    more = F.when(F.col("b_cell").isNull() | (F.col("_cell") < F.col("b_cell")), F.lit(True)).otherwise((F.col("_cell") == F.col("b_cell")) & inside)
    copies = F.least(F.col("epochs") + (more & (F.col("source_size") > 0)).cast("int"), F.lit(max_epochs)).cast("long")
    return met.withColumn("copies", copies).select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, **kinds) -> DataFrame:
    """docs, each row as often as the mix takes it; its columns alone, whatever they are called.

    Nulls, repeated rows, ties and empty tables as in mix(); copies of a row stand beside one another.
    """
    mixed = mix(docs, keep=docs.columns, **kinds)
    names = [f"k_{i}" for i in range(len(docs.columns))]
    several = mixed.toDF(*names, "size", "source_size", "target", "taken", "copies").where("copies > 0")
    several = several.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return several.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


ORACLE = r"""
with sized as (
  select doc_id, coalesce(source, '') src, source is null none,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size,
         length(coalesce(text, '')) chars
  from documents),
keyed as (
  select *, -ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) + 0.5::double) / 281474976710656.0::double)
         / case when chars / greatest(size, 1) between 3.0 and 12.0 then 1.0::double else 0.25::double end as k
  from sized),
totals as (select src, none, cast(sum(size) as bigint) source_size from sized group by all),
weighed as (select *, 1 + (row_number() over (order by none, src) - 1) % 3 as w, 3 * source_size as cap from totals),
filled as (
  select *, row_number() over f as place,
         (cast(sum(source_size) over () as double) - coalesce(sum(cap) over (f rows between unbounded preceding and 1 preceding), 0))
         / (sum(w) over () - coalesce(sum(w) over (f rows between unbounded preceding and 1 preceding), 0)) as lvl
  from weighed window f as (order by cap / w, none, src)),
target as (
  select src, none, source_size,
         least(cast(cap as double), (select arg_min(lvl, place) from filled where lvl <= cap / w) * w) as target
  from filled),
placed as (
  select *, coalesce(sum(size) over (partition by src, none order by k, doc_id nulls first, size
                                     rows between unbounded preceding and 1 preceding), 0) as before
  from keyed join target using (src, none)),
counted as (
  select *, least(case when source_size > 0 then floor(target / source_size)
                            + case when 2 * before + size <= 2 * (target - floor(target / source_size) * source_size) then 1 else 0 end
                       else 1 end, 3) as copies
  from placed)
select doc_id, size, source_size, target, cast(copies * size as bigint) taken, cast(copies as bigint) copies from counted
"""
