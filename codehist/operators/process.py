"""Author metrics, and process metrics of labels and of stable files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.operators.events import CHANGE, DELETION, LABEL, ORDER
from codehist.operators.history import FILE, Carry
from codehist.plans.ordered import BLOCK, block_of, opening_sums, running, so_far, spread

# fixed values: output name, and the history column
METRICS = {
    "qtyOfCommits": "n",
    "linesAdded": "lines_added",
    "linesDeleted": "lines_deleted",
    "bugFixCount": "bug_fixes",
    "refactoringsInvolved": "refactorings",
    "qtyOfAuthors": "authors",
    "qtyMinorAuthors": "minor",
    "qtyMajorAuthors": "major",
    "authorOwnership": "ownership",
}


def process_metrics(refactorings: Column | None = None) -> Column:
    """The nine metrics of a history row as one struct, zero where unknown."""
    given = {"refactorings": refactorings} if refactorings is not None else {}
    return F.struct(
        *[
            F.coalesce(given.get(c, F.col(c)), F.lit(0.0 if c == "ownership" else 0)).alias(name)
            for name, c in METRICS.items()
        ]
    )


def author_stats(
    history: DataFrame, block: int = BLOCK, carry: Carry | None = None, asked: Column | None = None
) -> DataFrame:
    """Add major, minor and ownership to a history with authors.

    Reads the history several times; ``file_history`` has it written already.
    All changes count, but only the rows ``asked`` for are returned (default:
    all) and take their wide columns through the window.

    An author with ``k`` of a file's ``n`` commits is minor while 20 k < n. A
    commit of theirs therefore makes (or keeps) them major until commit 20 k:
    every change adds at most one step up and one step down on the commit axis
    of its file, and the major authors at ``n`` are the running sum of steps.

    Rows are dealt to blocks of commits once. Steps inside the block of their
    change are made there; those into a later block travel by themselves, and
    steps of earlier blocks come summed up.
    """
    is_change = F.col("phase") == CHANGE
    k, n = F.col("k"), F.col("n")
    until = 20 * (k - 1)

    def step(at: Column, by: int) -> Column:
        return F.struct(at.cast("bigint").alias("n"), F.lit(by).cast("bigint").alias("d"))

    was_major = (k > 1) & (until >= n)
    steps = (
        F.when(was_major, F.array(step(until + 1, 1), step(20 * k + 1, -1)))
        .when(20 * k >= n, F.array(step(n, 1), step(20 * k + 1, -1)))
        .otherwise(F.array().cast("array<struct<n:bigint,d:bigint>>"))
    )

    def block_at(s: Column) -> Column:
        return F.call_function("div", s["n"], F.lit(int(block)).cast("bigint"))

    changes = history.filter(is_change).select(*FILE, "n", "k").withColumn("_blk", block_of("n", block))
    moves = changes.select(*FILE, F.explode(steps).alias("s"))
    travel = changes.select(*FILE, F.explode(F.filter(steps, lambda s: block_at(s) > F.col("_blk"))).alias("s"))
    if carry is not None:
        # an author who is major in the carried state stays so until commit 20 k
        known = carry.files.join(history.select(*FILE).distinct(), FILE, "left_semi").select(*FILE, "n")
        known = known.join(carry.authors, FILE).filter(20 * F.col("k") >= F.col("n"))
        known = known.select(*FILE, F.explode(F.array(step(n, 1), step(20 * k + 1, -1))).alias("s"))
        moves, travel = moves.unionByName(known), travel.unionByName(known)
    totals = moves.groupBy(*FILE, block_at(F.col("s")).alias("_blk")).agg(F.sum("s.d").alias("_step"))
    rows = history.withColumn("_blk", block_of("n", block)).withColumn("_row", F.lit(2))
    if asked is not None:
        # the other changes take part by their steps
        given = F.coalesce(asked, F.lit(False))
        rows = rows.withColumn("_row", F.when(given, 2).when(is_change, 1)).filter("_row is not null")
        kept = {*FILE, "n", "k", "phase", "_blk", "_row"}
        rows = rows.select(*[F.col(c) if c in kept else F.when(F.col("_row") == 2, F.col(c)).alias(c) for c in rows.columns])
    # a block may have rows but no steps of its own: carry the total there too
    later = rows.filter((F.col("n") >= block) & (F.col("_row") == 2)).select(*FILE, "_blk").distinct()
    opening = opening_sums(totals.unionByName(later.withColumn("_step", F.lit(0).cast("bigint"))), FILE, "_blk", {"_step": F.col("_step")})
    travel = travel.select(*FILE, F.col("s.n").alias("n"), block_at(F.col("s")).alias("_blk"), F.col("s.d").alias("_step"))
    both = rows.withColumn("_step", F.lit(None).cast("bigint"))
    both = both.unionByName(travel.withColumn("_row", F.lit(1)), allowMissingColumns=True)
    both = both.unionByName(opening.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    both = spread(both, *FILE, "_blk")

    def entry(at: Column, row: Column, by: Column) -> Column:
        return F.struct(at.cast("bigint").alias("n"), row.cast("int").alias("row"), by.cast("bigint").alias("step"))

    own = F.filter(F.when(is_change, steps), lambda s: block_at(s) == F.col("_blk"))
    own = F.transform(own, lambda s: entry(s["n"], F.lit(1), s["d"]))
    none = F.array().cast("array<struct<n:bigint,row:int,step:bigint>>")
    given = F.array(entry(n, F.col("_row"), F.col("_step")))
    both = both.withColumn("_e", F.explode(F.concat(given, F.coalesce(own, none))))
    # steps are made of their row, but don't take its columns through the sort
    both = both.select(*FILE, "_blk", "_e", *[F.when(F.col("_e.row") == 2, F.col(c)).alias(c) for c in history.columns if c not in FILE])
    w = so_far(*FILE, "_blk", order=[F.coalesce("_e.n", F.lit(-1)), "_e.row", *ORDER])
    major = F.coalesce(F.sum("_e.step").over(w), F.lit(0))
    out = both.withColumn("major", major).filter("_e.row = 2")
    ownership = F.when(F.col("n") > 0, F.col("top_author") / F.col("n")).otherwise(F.lit(0.0))
    out = out.withColumns({"minor": F.col("authors") - F.col("major"), "ownership": ownership})
    return out.select(*history.columns, "major", "minor", "ownership")


def label_process_asof(instances: DataFrame, history: DataFrame, block: int = BLOCK) -> DataFrame:
    """Give each label the state of its file just before the commit.

    The labels of one file in one commit see the same state, but each finds
    one refactoring more than the label before it. Only the first metric row
    of a label takes part; the others keep empty process metrics.
    """
    key = ["project", "commit_id", "filePath"]
    ranked = running(
        instances,
        key,
        "ref_pos",
        ["ref_pos", "class_pos", "match_pos"],
        {"_nth": F.when(F.col("match_pos") == 1, 1)},
        block,
    )
    state = history.filter(F.col("phase") == LABEL).select(
        "project",
        "commit_id",
        F.col("path").alias("filePath"),
        F.col("resets").alias("_resets"),
        *METRICS.values(),
    )
    seen = F.col("refactorings") - F.col("_resets") + F.col("_nth") - 1
    metrics = F.when(F.col("match_pos") == 1, process_metrics(seen))
    return (
        ranked.join(state, key, "left")
        .withColumn("processMetrics", metrics)
        .drop("_nth", "_resets", *METRICS.values())
    )


def latest_state(history: DataFrame) -> DataFrame:
    """Current state of every live file: the last event of its lineage.

    A file overwritten by a rename, renamed away or deleted has no state of its own.
    """
    when = F.struct(*ORDER)
    state = F.struct(*[c for c in history.columns if c not in FILE])
    last = history.groupBy(*FILE).agg(F.max_by(state, when).alias("s")).select(*FILE, "s.*").filter(F.col("phase") != DELETION)
    owner = history.groupBy("project", "path").agg(F.max_by("lineage", when).alias("lineage"))
    return last.join(owner, ["project", "path", "lineage"], "left_semi")
