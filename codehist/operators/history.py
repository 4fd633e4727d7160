"""Process metrics and stability of every file after every event.

The tracker of a file is a state machine: changes add up, labels and renames
reset the commit counter, and the counter starts again each time the largest
threshold is reached. Its closed form needs only running totals: with ``n``
changes since the last reset the place in the cycle is ``(n - 1) % top + 1``,
and the file is stable exactly when that place is a threshold.

A file's events are cut into blocks of walk positions; each block starts with
opening rows holding the totals of the earlier blocks (see plans.ordered), so
no task sees more than one block of a file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.operators.events import CHANGE, ORDER
from codehist.operators.exact import with_exact_cycles
from codehist.plans.ordered import BLOCK, before, block_of, so_far, spread
from codehist.session import shuffles_removed, staged

@dataclass
class Carry:
    """State to continue from: one row per file, and per file and author."""

    files: DataFrame
    authors: DataFrame


FILE = ["project", "lineage"]
AT = [*FILE, "_blk"]
TOTALS = {"n": "_chg", "lines_added": "added", "lines_deleted": "deleted", "bug_fixes": "is_bug"}


#: Files that are cut are known to the driver by name; if there are more, all files are cut.
FEW = 10_000


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def _segments(rows: DataFrame, order: Sequence) -> DataFrame:
    """Running totals, commit count at the last reset, and finished cycles.

    ``_mark`` is the commit count at a reset; a segment is what lies between
    two resets, and every full cycle of ``top`` changes in it fired ``top``.
    """
    run, prev = so_far(*AT, order=order), before(*AT, order=order)
    rows = rows.withColumns(
        {n: F.sum(c).over(run) for n, c in TOTALS.items()} | {"resets_total": F.sum("resets").over(run)}
    )
    mark = F.when(F.col("resets") > 0, F.col("n"))
    if "_open" in rows.columns:
        mark = F.when(F.col("_open"), F.col("_base")).otherwise(mark)
    rows = rows.withColumn("_mark", mark)
    return rows.withColumns({"seg_base": F.max("_mark").over(run), "_prev": F.max("_mark").over(prev)})


def _block_summary(ev: DataFrame, top: int) -> DataFrame:
    """Per (file, block): totals, first and last reset, finished cycles between."""
    rows = _segments(ev, ORDER)
    inner = F.when(F.col("_prev").isNotNull(), _div(F.col("_mark") - F.col("_prev"), top))
    event = F.struct(*ORDER, "commit_id")
    return rows.groupBy(*AT).agg(
        *[F.sum(c).alias(n) for n, c in TOTALS.items()],
        F.sum("resets").alias("resets_total"),
        F.min("_mark").alias("_first"),
        F.max("_mark").alias("_last"),
        F.coalesce(F.sum(inner), F.lit(0)).alias("_inner"),
        F.max(F.when(F.col("resets") > 0, event)).alias("_reset_at"),
        F.min(event).alias("_born"),
    )


def _carried(carry: DataFrame, ev: DataFrame) -> DataFrame:
    """Rows of a carried state for the files of this log, as block -1."""
    here = ev.select(*FILE).distinct()
    return carry.join(here, FILE, "left_semi").withColumn("_blk", F.lit(-1).cast("bigint"))


def _openings(ev: DataFrame, top: int, carry: DataFrame | None) -> DataFrame:
    """Opening rows: what a file's earlier blocks add up to."""
    prev = before(*FILE, order=["_blk"])
    names = [*TOTALS, "resets_total"]
    per = _block_summary(ev, top).withColumn("_given", F.lit(None).cast("bigint"))
    if carry is not None:
        at = [F.lit(0).cast(t).alias(c) for c, t in zip(ORDER, ("bigint", "int", "bigint"))]
        origin = F.struct(*at, F.col("reset_commit").alias("commit_id"))
        given = _carried(carry, ev).select(
            *AT,
            *names,
            F.col("seg_base").alias("_last"),
            F.col("closed").alias("_given"),
            origin.alias("_reset_at"),
            origin.alias("_born"),
        )
        per = per.unionByName(given, allowMissingColumns=True)
    per = per.withColumns(
        {f"_c_{n}": F.sum(n).over(prev) for n in names}
        | {"_c_reset_at": F.max("_reset_at").over(prev), "_c_born": F.min("_born").over(prev)}
    )
    start = F.coalesce("_c_n", F.lit(0))
    per = per.withColumn("_base", F.coalesce(F.max(start + F.col("_last")).over(prev), F.lit(0)))
    # cycles finished in this block by segments that a reset closed
    closed = F.when(
        F.col("_first").isNotNull(),
        _div(start - F.col("_base") + F.col("_first"), top) + F.col("_inner"),
    ).otherwise(0)
    per = per.withColumn("_closed", F.coalesce("_given", closed))
    per = per.withColumn("_closed", F.sum("_closed").over(prev))
    return per.filter("_c_n is not null").select(
        *AT,
        *[F.col(f"_c_{n}").alias(c) for n, c in TOTALS.items()],
        F.col("_c_resets_total").alias("resets"),
        "_base",
        "_closed",
        *[F.when(F.col(f"_c{c}").isNotNull(), F.struct(F.col(f"_c{c}.commit_id").alias("commit_id"))).alias(c) for c in ("_reset_at", "_born")],
    )


def _author_openings(ev: DataFrame, carry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Opening rows per (file, author, block) and per (file, block).

    Labels and renames have no author; they keep blocks without changes in.
    """
    by_author = ev.groupBy(*AT, "author").agg(F.sum("_chg").alias("_cnt"))
    if carry is not None:
        given = _carried(carry, ev).select(*AT, "author", F.col("k").alias("_cnt"))
        by_author = by_author.unionByName(given)
    prior = F.coalesce(F.sum("_cnt").over(before(*FILE, "author", order=["_blk"])), F.lit(0))
    by_author = by_author.withColumn("_k", prior)
    own = by_author.filter("_k > 0").select(*AT, "author", "_k")
    prev = before(*FILE, order=["_blk"])
    per = by_author.groupBy(*AT).agg(
        F.sum(((F.col("_k") == 0) & (F.col("_cnt") > 0)).cast("int")).alias("_new"),
        F.max(F.col("_k") + F.col("_cnt")).alias("_top"),
    )
    per = per.select(*AT, F.sum("_new").over(prev).alias("_seen"), F.max("_top").over(prev).alias("_top"))
    return own, per.filter("_seen is not null")


def _in_blocks(events: DataFrame, block: int, uncut: int) -> tuple[DataFrame, DataFrame | None]:
    """Events with their block, and the events of files that are cut into blocks, if any are.

    A file of at most ``uncut`` events is one block, wherever in the walk its events lie: its totals need no sums of blocks.
    """
    at = block_of("walk_pos", block)
    if not uncut:
        ev = events.withColumn("_blk", at)
        return ev, ev
    large = events.groupBy(*FILE).count().filter(F.col("count") > uncut).select(*FILE).limit(FEW + 1)
    with shuffles_removed(events.sparkSession):
        names = large.collect()
    if len(names) > FEW:
        return _in_blocks(events, block, 0)
    if not names:
        return events.withColumn("_blk", F.lit(0).cast("bigint")), None
    known = events.sparkSession.createDataFrame(names, large.schema).toDF("_project", "_lineage").withColumn("_cut", F.lit(True))
    same = events["project"].eqNullSafe(known["_project"]) & events["lineage"].eqNullSafe(known["_lineage"])
    ev = events.join(F.broadcast(known), same, "left").drop("_project", "_lineage")
    ev = ev.withColumn("_blk", F.when(F.col("_cut"), at).when(F.col("_cut").isNull(), 0))
    return ev.drop("_cut"), ev.filter("_cut").drop("_cut")


def file_history(
    events: DataFrame,
    thresholds: Sequence[int],
    authors: bool = False,
    block: int = BLOCK,
    carry: Carry | None = None,
) -> DataFrame:
    """State of every file after each event.

    Files whose tracker forgot a fired threshold (a detector rename without a
    reset) are replayed, all others follow the closed form. The result is
    written once, as it is looked at several times. With ``carry`` the log
    continues from an earlier state.
    """
    history = staged(closed_form_history(events, thresholds, authors, block, carry))
    forgot = (
        history.filter((F.col("clears") > 0) & (F.col("resets") == 0))
        .filter(F.col("since_base") >= min(thresholds))
        .select(*FILE)
        .distinct()
    )
    if carry is not None:
        earlier = carry.files.filter("exact").join(history.select(*FILE).distinct(), FILE, "left_semi").select(*FILE)
        forgot = forgot.unionByName(earlier).distinct()
    forgot = staged(forgot)
    if forgot.isEmpty():
        return history
    replayed = staged(
        with_exact_cycles(history.join(forgot, FILE, "left_semi"), thresholds, block, carry.files if carry is not None else None)
    )
    return history.join(forgot, FILE, "left_anti").unionByName(replayed)


def closed_form_history(
    events: DataFrame,
    thresholds: Sequence[int],
    authors: bool = False,
    block: int = BLOCK,
    carry: Carry | None = None,
    uncut: int = 0,
) -> DataFrame:
    """State of a file after each event by running totals, one row per event.

    Files of at most ``uncut`` events are not cut into blocks (all are with a
    ``carry``, whose totals come as a block of their own). For that the events
    are counted at once.

    n, lines_added, lines_deleted, bug_fixes: totals of the file.
    refactorings: resets so far, by labels, renames and finished cycles.
    seg_base: commit count at the last reset; base_n: commit count at the start
    of the running cycle; since_base: changes since then.
    fired: the threshold reached by this change, if any.
    reset_commit: commit of the last reset, or the one that created the file.
    authors, top_author: number of authors, commits of the busiest one.
    """
    cuts = sorted(set(int(t) for t in thresholds))
    top = cuts[-1]
    ev, cut = _in_blocks(events.withColumn("_chg", (F.col("phase") == CHANGE).cast("int")), block, 0 if carry is not None else uncut)
    event = F.struct("commit_id")
    body = ev.withColumns(
        {
            "_reset_at": F.when(F.col("resets") > 0, event),
            "_born": event,
            "_closed": F.lit(None).cast("bigint"),
            "_open": F.lit(False),
        }
    )
    both = body.withColumn("_base", F.lit(None).cast("bigint"))
    if cut is not None:
        openings = _openings(cut, top, carry.files if carry is not None else None)
        both = both.unionByName(openings.withColumn("_open", F.lit(True)), allowMissingColumns=True)
    if authors:
        both = both.withColumns(
            {"_k": F.col("_chg").cast("bigint"), "_seen": F.lit(None).cast("bigint"), "_top": F.lit(None).cast("bigint")}
        ).withColumn("_k", F.when(F.col("_open"), 0).otherwise(F.col("_k")))
        for rows in _author_openings(cut, carry.authors if carry is not None else None) if cut is not None else ():
            both = both.unionByName(rows.withColumn("_open", F.lit(True)), allowMissingColumns=True)
    order = [F.col("_open").desc(), *ORDER, "commit_id"]
    run = so_far(*AT, order=order)
    # a block that is the same everywhere is left out of the windows, and would keep them from using what it is dealt by
    rows = spread(both, *(AT if cut is not None else FILE))
    if authors:
        # before all other totals, so that these need one sort by time
        rows = rows.withColumn("k", F.sum("_k").over(so_far(*AT, "author", order=order)))
        is_new = ((F.col("_chg") == 1) & (F.col("k") == 1)).cast("bigint")
        rows = rows.withColumns(
            {
                "authors": F.sum(F.when(F.col("_open"), F.col("_seen")).otherwise(is_new)).over(run),
                "top_author": F.max(
                    F.when(F.col("_open"), F.col("_top")).when(F.col("_chg") == 1, F.col("k"))
                ).over(run),
            }
        )
    # rows come in the order of events: the last reset so far, the first event
    rows = _segments(rows, order).withColumns(
        {"_reset_at": F.last("_reset_at", True).over(run), "_born": F.first("_born", True).over(run)}
    )
    seg_base = F.coalesce("seg_base", F.lit(0))
    ended = F.when(F.col("_open"), F.col("_closed")).when(
        F.col("resets") > 0, _div(F.col("n") - F.coalesce("_prev", F.lit(0)), top)
    )
    rows = rows.withColumns({"seg_base": seg_base, "_closed": F.sum(ended).over(run)})
    rows = rows.filter(~F.col("_open"))
    in_segment = F.col("n") - F.col("seg_base")
    is_change = F.col("_chg") == 1
    cycle = F.when(is_change, _div(in_segment - 1, top)).otherwise(_div(in_segment, top))
    place = F.col("since_base")
    rows = rows.withColumn("base_n", F.col("seg_base") + cycle * top)
    rows = rows.withColumn("since_base", F.col("n") - F.col("base_n"))
    rows = rows.withColumn("fired", F.when(is_change & place.isin(cuts), place).cast("int"))
    # thresholds passed in the running cycle
    counter = F.when(F.col("fired") == top, 0).otherwise(F.col("since_base"))
    passed = sum(((counter >= t).cast("int") for t in cuts[1:]), (counter >= cuts[0]).cast("int"))
    rows = rows.withColumns({"step": passed, "exact": F.lit(False)})
    finished = F.coalesce("_closed", F.lit(0)) + _div(in_segment, top)
    out = rows.withColumns(
        {
            "refactorings": F.col("resets_total") + finished,
            "reset_commit": F.coalesce("_reset_at.commit_id", "_born.commit_id"),
        }
    )
    columns = [
        "project", "lineage", "path", *ORDER, "commit_id", "resets", "clears", "author",
        "n", "lines_added", "lines_deleted", "bug_fixes", "resets_total", "refactorings",
        "seg_base", "base_n", "since_base", "fired", "step", "exact", "reset_commit",
    ]
    if authors:
        out = out.withColumns(
            {"authors": F.coalesce("authors", F.lit(0)), "top_author": F.coalesce("top_author", F.lit(0))}
        )
        columns += ["k", "authors", "top_author"]
    return out.select(*columns)
