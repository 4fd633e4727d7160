"""The commits that a branch holds, and the order to walk them in, from their parents.

A walk from the head takes newer commits first, and none before its children. Clocks
differ, so a commit counts as no newer than any commit of the branch above it:
``eff(x) = min(time(x), eff of its children)``. Its depth is the longest way from the head.

Both are found by shortening links. A link says what is known of a commit in terms of
one nearer to the head: ``eff(x) <= min(cap, eff(y))``, ``depth(x) >= hops + depth(y)``.
In each round every link to a commit with a single link is drawn on to that one's end;
links of one commit with the same end become one; links to commits from which nothing
leads to the head go. Runs of commits halve in every round, and a branch that was merged
becomes a run when both its sides end in the same place. So rounds grow with the
logarithm of the longest run, and with the nesting of branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codehist.session import staged

COMMIT = ["project", "commit_id"]
LINK = ["x", "y"]


def branch_links(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """project, x, cap, hops: each commit with a way from the head of its project (heads: project, commit_id), and what the ways allow it.

    ``commits`` has project, commit_id, parents and time. The head itself has no row; parents that are no
    commits of the table are left out, and so is a commit that is its own parent.
    """
    # commits go by numbers: rounds shuffle, sort and sum no texts. Written, so that all rounds see the same numbers
    nodes = commits.groupBy(*COMMIT).agg(F.min("time").alias("cap")).withColumn("x", F.monotonically_increasing_id())
    nodes = staged(nodes)
    numbers = nodes.select(*COMMIT, F.col("x").alias("y"))
    head = heads.select(*COMMIT).join(numbers, COMMIT).select("project", F.col("y").alias("head"))
    edges = commits.select("project", F.explode("parents").alias("parent"), "commit_id").filter("parent <> commit_id").distinct()
    edges = edges.join(numbers, COMMIT).select("project", F.col("parent").alias("commit_id"), "y")
    links = edges.join(nodes, COMMIT).join(head, "project")
    # ways end at the head: what lies above it is not looked at
    links = links.filter("x <> head").select(*LINK, "cap", F.lit(1).cast("bigint").alias("hops"), (F.col("y") == F.col("head")).alias("done"))
    links = staged(links)
    while not links.filter("not done").isEmpty():
        one = links.groupBy("x").agg(*(F.min(c).alias(c) for c in ("y", "cap", "hops", "done")), F.count("*").alias("n"))
        ends = one.select(F.col("x").alias("y"), F.when(F.col("n") == 1, F.struct("y", "cap", "hops", "done")).alias("on"))
        # commits without links, the head apart, are not in ``ends``: links to them go
        drawn = links.filter("not done").join(ends, "y").select(
            "x", F.coalesce("on.y", "y").alias("y"), F.least("cap", "on.cap").alias("cap"),
            (F.col("hops") + F.coalesce("on.hops", F.lit(0))).alias("hops"), F.coalesce("on.done", F.lit(False)).alias("done"),
        )
        both = links.filter("done").unionByName(drawn)
        links = staged(both.groupBy(*LINK).agg(F.min("cap").alias("cap"), F.max("hops").alias("hops"), F.max("done").alias("done")))
    return links.join(nodes.select(*COMMIT, "x"), "x").select("project", F.col("commit_id").alias("x"), "cap", "hops")


def reachable_commits(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """The commits that the heads hold, with eff and depth (see above)."""
    links = branch_links(commits, heads)
    at = heads.select(*COMMIT).join(commits.select(*COMMIT, "time"), COMMIT)
    top = at.select("project", F.col("time").alias("_top"))
    below = links.join(top, "project").select("project", F.col("x").alias("commit_id"), F.least("cap", "_top").alias("eff"), F.col("hops").alias("depth"))
    found = at.select(*COMMIT, F.col("time").alias("eff"), F.lit(0).cast("bigint").alias("depth")).unionByName(below)
    return commits.join(found, COMMIT)


def commit_walk(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """The commits of ``reachable_commits`` with walk_pos: from 1 per project, oldest first, parents before children.

    Commits are in the order of their times where these agree with the graph; ties go by depth, then by id. Rows
    are dealt by ranges and numbered there, so no task holds a project of any size.
    """
    order = ["project", "eff", F.col("depth").desc(), "commit_id"]
    rows = reachable_commits(commits, heads).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    parts = rows.groupBy("project", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("project").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(parts.select("project", "_part", (before - F.col("_first") + 1).alias("_offset")))
    numbered = rows.join(offsets, ["project", "_part"]).withColumn("walk_pos", F.col("_row") + F.col("_offset"))
    return numbered.drop("_part", "_row", "_offset", "eff", "depth")
