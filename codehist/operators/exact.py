"""The stability cycle of files for which the closed form of ``history`` fails.

A rename seen by the detector without a reset makes the tracker forget which
threshold fired last, so thresholds fire again, one per change, and the cycle
may end late. Between two such renames (or resets) lies a *segment*, and that
has a closed form again. With ``c`` changes in the cycle at its start, threshold
``j`` fires at change ``max(t[j-1] + 1, cut[j] - c)`` of the segment; with the
last threshold the cycle ends, and from there on cycles are regular.

So all that a segment hands on is its last ``c``, and a reset hands on zero:

1. a segment is one row, with the number of its changes,
2. the segments that follow a reset are a chain. Chains are cut into blocks of
   commit counts; a block that others follow becomes a table from ``c`` at its
   start to ``c`` at its end, and the tables give each block its start,
3. segments of a block get their starts in turn, and events their places.

All of it is expressions: no Python runs. A row holds the segments of a block,
or the tables of a chain, one for every CHAIN commits of a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codehist.operators.events import CHANGE, ORDER
from codehist.plans.ordered import BLOCK, before, block_of, running, so_far
from codehist.session import staged

FILE = ["project", "lineage"]
AT = [*FILE, "_blk"]
CHAIN_KEY = [*FILE, "seg_base"]
#: Commit counts, hence segments, in one block of a chain.
CHAIN = 1 << 12
GIVEN = {"n0": "n", "c0": "c", "i0": "i", "done0": "done"}


def firing_times(cuts: Sequence[int], c: Column, passed: Column | None = None) -> list[Column]:
    """The change of a segment at which each threshold fires for the first time; 0 for the ``passed`` first ones."""
    times, t = [], F.lit(0)
    for j, cut in enumerate(cuts):
        t = F.greatest(t + 1, F.lit(cut) - c)
        if passed is not None:
            t = F.when(passed > j, F.lit(0)).otherwise(t)
        times.append(t)
    return times


def last_place(cuts: Sequence[int], c: Column, m: Column, passed: Column | None = None) -> Column:
    """Changes in the cycle after the ``m`` changes of a segment that starts with ``c``."""
    end = firing_times(cuts, c, passed)[-1]
    return F.when(m < end, c + m).otherwise((m - end) % cuts[-1]).cast("bigint")


def segments(rows: DataFrame, block: int, given: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Events with their segment (_seg: commit count at its start, -1 for the first), and one row per segment with its ``m`` changes."""
    marks = F.when((F.col("resets") > 0) | (F.col("clears") > 0), F.col("n"))
    rows = rows.withColumns({"_blk": block_of("walk_pos", block), "_ends": marks})
    last = rows.groupBy(*AT).agg(F.max("_ends").alias("_last"))
    came = last.select(*AT, F.max("_last").over(before(*FILE, order=["_blk"])).alias("_came"))
    seg = F.coalesce(F.greatest("_came", F.max("_ends").over(so_far(*AT, order=ORDER))), F.lit(-1)).cast("bigint")
    rows = staged(rows.join(came, AT).withColumn("_seg", seg).drop("_came", "_ends", "_blk"))
    per = rows.groupBy(*CHAIN_KEY, "_seg").agg(F.max("n").alias("_end"))
    if given is None:
        per = per.withColumns({n: F.lit(0).cast("bigint") for n in GIVEN})
    else:
        start = given.select(*FILE, *[F.col(c).cast("bigint").alias(n) for n, c in GIVEN.items()])
        per = per.join(start, FILE, "left").na.fill(0, list(GIVEN))
    start = F.when(F.col("_seg") < 0, F.col("n0")).otherwise(F.col("_seg"))
    return rows, per.withColumns({"_start": start, "m": F.col("_end") - start})


def segment_starts(per: DataFrame, cuts: Sequence[int], chain: int) -> DataFrame:
    """Adds ``c``, the changes in the cycle when the segment starts, and ``i``, the thresholds passed by then."""
    top = cuts[-1]
    first = per.filter("_seg < 0").withColumnsRenamed({"c0": "c", "i0": "i"})
    handed = first.select(*CHAIN_KEY, last_place(cuts, F.col("c"), F.col("m"), F.col("i")).alias("_handed"))

    listed = per.filter("_seg >= 0").withColumn("_cb", block_of("_seg", chain))
    blocks = listed.groupBy(*CHAIN_KEY, "_cb").agg(F.sort_array(F.collect_list(F.struct("_seg", "m"))).alias("segs"))
    goes_on = F.max("_cb").over(Window.partitionBy(*CHAIN_KEY)) > F.col("_cb")

    def through(c: Column) -> Column:
        """State after a block: its last ``c``, and whether a cycle ended (if not, ``c`` only grew)."""
        begin = F.struct(c.cast("bigint").alias("c"), F.lit(False).alias("ended"))
        return F.aggregate("segs", begin, lambda a, s: F.struct(
            last_place(cuts, a["c"], s["m"]).alias("c"), (a["ended"] | (s["m"] >= firing_times(cuts, a["c"])[-1])).alias("ended"),
        ))

    tables = F.when(goes_on, F.transform(F.sequence(F.lit(0), F.lit(top)), through))
    blocks = blocks.withColumn("table", tables)

    def after(c: Column, table: Column) -> Column:
        # beyond the largest threshold all starts behave alike
        at = F.least(c, F.lit(top).cast("bigint"))
        end = F.element_at(table, at.cast("int") + 1)
        return F.coalesce(F.when(end["ended"], end["c"]).otherwise(c + end["c"] - at), c)

    none = F.array().cast("array<struct<_cb:bigint,c:bigint>>")
    chains = blocks.groupBy(*CHAIN_KEY).agg(F.sort_array(F.collect_list(F.struct("_cb", "table"))).alias("tables")).join(handed, CHAIN_KEY, "left")
    walked = F.aggregate(
        "tables", F.struct(F.coalesce("_handed", F.lit(0).cast("bigint")).alias("c"), none.alias("out")),
        lambda a, b: F.struct(after(a["c"], b["table"]).alias("c"), F.concat(a["out"], F.array(F.struct(b["_cb"].alias("_cb"), a["c"].alias("c")))).alias("out")),
    )
    starts = chains.select(*CHAIN_KEY, F.inline(walked["out"]))
    none = F.array().cast("array<struct<_seg:bigint,c:bigint>>")
    inside = F.aggregate(
        "segs", F.struct(F.col("c"), none.alias("out")),
        lambda a, s: F.struct(last_place(cuts, a["c"], s["m"]).alias("c"), F.concat(a["out"], F.array(F.struct(s["_seg"].alias("_seg"), a["c"].alias("c")))).alias("out")),
    )
    found = blocks.drop("table").join(starts, [*CHAIN_KEY, "_cb"]).select(*CHAIN_KEY, F.inline(inside["out"]))
    rest = listed.drop("_cb", "c0", "i0").join(found, [*CHAIN_KEY, "_seg"]).withColumn("i", F.lit(0).cast("bigint"))
    return first.select(rest.columns).unionByName(rest)


def exact_cycles(history: DataFrame, thresholds: Sequence[int], block: int = BLOCK, carry: DataFrame | None = None, chain: int = CHAIN) -> DataFrame:
    """``history`` with since_base, fired, step and cycles (finished so far) as the tracker has them.

    ``carry`` holds the state (n, c, i, done) files start from; zero without it.
    """
    cuts = sorted(set(int(t) for t in thresholds))
    top = cuts[-1]
    rows, per = segments(history.drop("since_base", "fired", "step", "exact"), block, carry)
    segs = staged(segment_starts(per, cuts, chain))
    times = firing_times(cuts, F.col("c"), F.col("i"))
    ended = F.when(F.col("m") >= times[-1], 1 + F.floor((F.col("m") - times[-1]) / top)).otherwise(0).cast("bigint")
    segs = segs.withColumns({"_at": F.col("_seg") + 1, "_own": ended})
    segs = running(segs, FILE, "_at", ["_at", "seg_base"], {"_all": F.col("_own")}, block)
    segs = segs.select(*CHAIN_KEY, "_seg", "_start", "c", "i", (F.col("_all") - F.col("_own") + F.col("done0")).alias("_done"))

    rows = rows.join(segs, [*CHAIN_KEY, "_seg"]).withColumn("m", F.col("n") - F.col("_start"))
    rows = rows.withColumns({f"_t{j}": t for j, t in enumerate(times)})
    ts, m = [F.col(f"_t{j}") for j in range(len(cuts))], F.col("m")
    end, is_change = ts[-1], F.col("phase") == CHANGE
    early = F.when(is_change, m <= end).otherwise(m < end)
    later = F.when(is_change, (m - end - 1) % top + 1).otherwise((m - end) % top)
    since = F.when(early, F.col("c") + m).otherwise(later).cast("bigint")
    at_first = F.coalesce(*(F.when(m == t, F.lit(cut)) for t, cut in zip(ts, cuts)))
    fired = F.when(is_change, F.when(early, at_first).otherwise(F.when(later.isin(cuts), later)))
    counter = (m - end) % top
    before_end, behind_end = (sum((c.cast("int") for c in marks[1:]), marks[0].cast("int")) for marks in ([t <= m for t in ts], [counter >= cut for cut in cuts]))
    cycles = F.col("_done") + F.when(m >= end, 1 + F.floor((m - end) / top)).otherwise(0)
    rows = rows.withColumns({
        "since_base": since, "fired": fired.cast("int"), "step": F.when(m < end, before_end).otherwise(behind_end).cast("int"), "cycles": cycles.cast("bigint"),
    })
    return rows.drop("_seg", "_start", "_done", "c", "i", "m", *(f"_t{j}" for j in range(len(cuts))))


def with_exact_cycles(history: DataFrame, thresholds: Sequence[int], block: int = BLOCK, carry: DataFrame | None = None, chain: int = CHAIN) -> DataFrame:
    """Replace the closed form in ``history`` by the cycles that took place."""
    rows = exact_cycles(history, thresholds, block, carry, chain).withColumn("exact", F.lit(True))
    return rows.withColumns(
        {"base_n": F.col("n") - F.col("since_base"), "refactorings": F.col("resets_total") + F.col("cycles")}
    ).select(*history.columns)
