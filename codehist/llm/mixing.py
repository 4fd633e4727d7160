"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equal numbers of words. Slot k takes the k-th van der Corput point (its binary digits mirrored behind the point, exact in a
double) of the unit interval, on which every source owns a stretch as long as its share of the targets; so any run of slots holds each source close to its share. The r-th slot of a source takes the r-th block of
the source's words: its documents in a random but repeatable order, one after the other, then once more from the start. Documents are cut at block edges.

Ranks of slots and places in a source's order are running sums: counted in ranges of slots, or in buckets of the order, added up over these, and finished inside
each range or bucket. No source has to fit a task.

Defined results: a null or empty text has no words and is not taken; a null source is a source of its own, after all others; repeated rows (also of one doc_id)
are documents of their own; an empty table, or one without words, has an empty mix. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codehist.llm.tables import staged, table

WEIGHTS = (5.0, 2.0, 1.0)
#: The mix has this share of all words; a source gives at most MOST_COPIES times its words.
MIX_SHARE, MOST_COPIES = 1.5, 2
#: Words per slot. A source's words differ from its target by a few slots at most.
BLOCK = 64
SEED = 20
#: Hex digits of the order's key that name a bucket, slots per range in which ranks are counted, and cells of the unit interval.
BUCKET_DIGITS, RANGE, CELLS = 3, 65_536, 4096

NEXT_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL_BEFORE = (Window.unboundedPreceding, -1)


def zero() -> Column:
    return F.lit(0).cast("long")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), zero())


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = MIX_SHARE, copies: int = MOST_COPIES) -> DataFrame:
    """source, no, source_size, target: one row per source.

    A target is weight * level, or ``copies * size`` where that is less; the level is that at which all targets add up to the share. Sources are full in the order of
    size / weight, so the level follows from running sums over sources in this order: that of the first source that does not get full. (Worked out for a
    later one, as if those before it were full, it would be lower.) If even all full sources don't reach the share, all are full.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = sources.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    full = F.col("source_size") * copies
    order = Window.orderBy(full / F.col("weight"), "no")
    everything = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        numbered.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("used", F.coalesce(F.sum(full).over(order.rowsBetween(*ALL_BEFORE)), zero()))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
        .withColumn("found", F.max(F.when(F.col("level") * F.col("weight") <= full, F.col("level"))).over(everything))
    )
    return level.select("source", "no", "source_size", F.least(F.col("weight") * F.coalesce("found", F.lit(float("inf"))), full.cast("double")).alias("target"))


def corput(k: Column) -> Column:
    """The 64 bits of k mirrored, of which the first 53 make a double in [0, 1)."""
    v = k
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        low = F.lit(mask).cast("long")
        v = F.shiftrightunsigned(v, width).bitwiseAND(low).bitwiseOR(F.shiftleft(v.bitwiseAND(low), width))
    return F.shiftrightunsigned(v, 11) / F.lit(float(1 << 53))


def slot_sources(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, no: the source of each slot. The interval is cut into cells, so that slots meet the few stretches of their cell by an equi join."""
    spark = targets.sparkSession
    order = Window.orderBy("no")
    upper = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    line = targets.where("target > 0").select("no", upper.alias("upper"))
    line = line.select("no", F.lag("upper", 1, 0.0).over(order).alias("lower"), F.when(F.lead("no").over(order).isNull(), 2.0).otherwise(F.col("upper")).alias("upper"))
    last = F.least(F.ceil(F.col("upper") * CELLS) - 1, F.lit(CELLS - 1))
    cells = line.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") * CELLS).cast("int"), F.greatest(last, F.floor(F.col("lower") * CELLS)).cast("int"))))
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    points = spark.range(int(-(-words // block))).select(F.col("id").alias("slot"), corput(F.col("id")).alias("u"))
    met = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int")).join(cells, "cell")
    return met.where("u >= lower and u < upper").select("slot", "no")


def ranked_slots(slots: DataFrame) -> DataFrame:
    """slot, no, r: which of its source's slots a slot is, from 0."""
    ranged = slots.withColumn("range", F.floor(F.col("slot") / RANGE))
    counts = ranged.groupBy("no", "range").agg(F.count("*").alias("n"))
    base = counts.select("no", "range", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("range").rowsBetween(*ALL_BEFORE)), zero()).alias("base"))
    own = ranged.withColumn("own", F.row_number().over(Window.partitionBy("no", "range").orderBy("slot")) - 1)
    return own.join(base, ["no", "range"]).select("slot", "no", (F.col("base") + F.col("own")).alias("r"))


def in_order(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds bucket, place (with no, unique to a row) and begin: the words of its source before a document, in the source's shuffled order."""
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(seed)).cast("binary"))
    keyed = sizes.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    order = Window.partitionBy("no", "bucket").orderBy("key", "doc_id", "size", "t")
    placed = keyed.withColumn("place", F.row_number().over(order)).withColumn("own", F.coalesce(F.sum("size").over(order.rowsBetween(*ALL_BEFORE)), zero()))
    totals = keyed.groupBy("no", "bucket").agg(F.sum("size").alias("n"))
    base = totals.select("no", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("bucket").rowsBetween(*ALL_BEFORE)), zero()).alias("base"))
    return placed.join(base, ["no", "bucket"]).withColumn("begin", F.col("base") + F.col("own")).drop("key", "own", "base")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = MIX_SHARE, copies: int = MOST_COPIES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix: for each document and slot that takes words of it, slot, copy, first (its words before these) and words. A document of which nothing is
    taken has one row without a slot. All rows carry doc_id, t (a hash of the text), size, source, source_size, target and the document's key no, bucket, place."""
    sizes = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), F.xxhash64("text").alias("t")))
    targets = staged(source_targets(sizes, weights, share, copies))
    slots = staged(ranked_slots(slot_sources(targets, block)))
    quota = slots.groupBy("no").agg(F.count("*").alias("slots"))
    known = targets.join(quota, "no", "left").withColumnRenamed("source", "of")
    placed = in_order(sizes.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of"), seed)

    per_copy = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: F.col("begin") + c * F.col("source_size"))
    cuts = F.flatten(
        F.transform(
            per_copy,
            lambda a, c: F.when(
                (F.col("size") > 0) & (F.floor(a / block) < F.col("slots")),
                F.transform(
                    F.sequence(F.floor(a / block), F.least(F.floor((a + F.col("size") - 1) / block), F.col("slots") - 1)),
                    lambda r: F.struct(r.alias("r"), c.alias("copy"), F.greatest(a, r * block).alias("lo"), F.least(a + F.col("size"), (r + 1) * block).alias("hi"), a.alias("a")),
                ),
            ).otherwise(F.array().cast("array<struct<r:bigint,copy:int,lo:bigint,hi:bigint,a:bigint>>")),
        )
    )
    cut = placed.withColumn("cut", F.explode_outer(cuts)).select("*", "cut.*").drop("cut")
    return cut.join(slots, ["no", "r"], "left").select(
        "slot", "doc_id", "t", "size", "source", "source_size", "target", "no", "bucket", "place", "copy", (F.col("lo") - F.col("a")).alias("first"), (F.col("hi") - F.col("lo")).alias("words")
    )


def first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts ``text`` after its first ``words`` words where it has more (``size``)."""
    for batch in batches:
        sizes, counts = batch.column("size").to_numpy(), batch.column("words").to_numpy()
        short = np.flatnonzero(counts < sizes)
        if len(short):
            texts = batch.column("text").to_pylist()
            for k in short.tolist():
                ends = islice((m.end() for m in NEXT_WORD.finditer(texts[k])), int(counts[k]) - 1, None)
                texts[k] = texts[k][: next(ends)]
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        yield batch


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents with the columns of ``docs``, in the order of their first slots: as many copies of each as the mix takes; one that it takes in part
    keeps the words that are taken."""
    names = docs.columns
    dup = F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("source"))
    whole = mix(docs, **how).where("slot is not null").groupBy("no", "bucket", "place", "copy", "doc_id", "t", "size", "source").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    # rows that share id and text are told apart by numbers; which gets which does not matter, as far as the source is the same
    twin = F.dense_rank().over(Window.partitionBy("doc_id", "t").orderBy("source", "no", "bucket", "place"))
    whole = whole.withColumn("dup", twin).select(F.col("doc_id").alias("with_id"), F.col("t").alias("with_t"), "dup", "copy", "size", "words", "slot")
    others = F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("row")
    rows = docs.select(others, "text", "doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("t")).withColumn("own", dup)
    met = rows.drop("source").join(whole, (F.col("t") == F.col("with_t")) & (F.col("own") == F.col("dup")) & F.col("doc_id").eqNullSafe(F.col("with_id")))
    # the text goes through both shuffles once, other columns beside it
    taken = met.select("row", "text", "size", "words", "slot").repartitionByRange("slot").sortWithinPartitions("slot")
    cut = taken.mapInArrow(first_words, taken.schema)
    return cut.select(*(F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in names))


def op3_mixing(spark, sf_dir) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(zero()))
    rows = mixed.groupBy("no", "bucket", "place", "doc_id", "size", "source_size", "target").agg(taken.alias("taken"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = f"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as no from d group by source),
s1 as (select *, [5.0::double, 2.0::double, 1.0::double][cast(no % 3 + 1 as int)] as weight, cast({MOST_COPIES} * source_size as double) as full_size,
              (select sum(source_size) from s0) * {MIX_SHARE}::double as total from s0),
s2 as (select *, (total - coalesce(sum(full_size) over (order by full_size / weight, no rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by full_size / weight, no rows between current row and unbounded following) as level from s1),
s3 as (select source, no, source_size, least(weight * (select max(level) from s2 where level * weight <= full_size), full_size) as target from s2),
line0 as (select no, sum(target) over (order by no rows unbounded preceding) / (select sum(target) from s3) as upper from s3 where target > 0),
line as (select no, lag(upper, 1, 0.0) over (order by no) as lower, case when lead(no) over (order by no) is null then 2.0 else upper end as upper from line0),
pts as (select k, list_sum(list_transform(range(40), lambda j: ((k >> j) & 1) / power(2.0::double, j + 1))) as u
        from (select unnest(range(cast(ceil((select sum(target) from s3) / {BLOCK}) as bigint))) as k)),
quota as (select no, count(*) as slots from pts join line on u >= lower and u < upper group by no),
o as (select d.*, s3.no, source_size, target, coalesce(slots, 0) * {BLOCK} as words,
             coalesce(sum(size) over (partition by s3.no order by md5(concat_ws(':', cast(doc_id as varchar), '{SEED}')), doc_id, size
                                      rows between unbounded preceding and 1 preceding), 0) as begin
      from d join s3 on d.source is not distinct from s3.source left join quota using (no))
select doc_id, size, source_size, target,
       cast(greatest(0, least(size, words - begin)) + greatest(0, least(size, words - begin - source_size)) as bigint) as taken from o
"""
