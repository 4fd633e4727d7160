"""The commit walk: which commits are processed, in which order, and their diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehist.functions.names import (
    commit_url,
    is_local_url,
    parent_id,
    parse_thresholds,
    project_name,
    trimmed,
)
from codehist.plans.ordered import BLOCK, running


def commit_range(commits: DataFrame, bounds: DataFrame) -> DataFrame:
    """Commits from ``first`` up to ``last`` of their project, both included.

    ``bounds`` has project, first, last; a null leaves that end open. Bounds
    are looked up before merges are dropped, so a merge can be a bound. A
    ``first`` that never comes leaves nothing; a ``last`` that does not come
    after it leaves the range open.
    """
    at = F.col("walk_pos")
    ends = (
        commits.join(bounds, "project")
        .filter("commit_id = first or commit_id = last")
        .groupBy("project")
        .agg(
            F.min(F.when(F.col("commit_id") == F.col("first"), at)).alias("_lo"),
            F.min(F.when(F.col("commit_id") == F.col("last"), at)).alias("_hi"),
        )
    )
    wanted = bounds.select("project", F.col("first").isNotNull().alias("_bound")).join(
        ends, "project", "left"
    )
    rows = commits.join(wanted, "project", "left")
    started = F.when(F.col("_bound"), at >= F.col("_lo")).otherwise(True)
    past_end = (F.col("_hi") >= F.coalesce("_lo", F.lit(0))) & (at > F.col("_hi"))
    return rows.filter(started & ~F.coalesce(past_end, F.lit(False))).drop("_bound", "_lo", "_hi")


def without_merges(commits: DataFrame) -> DataFrame:
    return commits.filter(F.size("parents") <= 1)


def with_detection(commits: DataFrame) -> DataFrame:
    """Commits whose labels count: the root has nothing to compare with."""
    return commits.filter(F.size("parents") == 1)


def commit_replay(commits: DataFrame, bounds: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Processed commits with ``commit_number``, counted from 1 per project."""
    walked = commits if bounds is None else commit_range(commits, bounds)
    return running(
        without_merges(walked), ["project"], "walk_pos", ["walk_pos"], {"commit_number": F.lit(1)}, block
    )


def commit_totals(commits: DataFrame) -> DataFrame:
    """Per project: number of commits, merges included, and the newest one."""
    return commits.groupBy("project").agg(
        F.count("*").alias("commits"),
        F.max_by("commit_id", "walk_pos").alias("last_commit_hash"),
    )


def commit_meta(commits: DataFrame, projects: DataFrame) -> DataFrame:
    """``commits`` numbered by ``commit_replay``; ``projects`` has project, git_url."""
    rows = commits.join(projects.select("project", "git_url"), "project")
    commit_id = trimmed(F.col("commit_id"))
    return rows.select(
        "project",
        commit_id.alias("commitId"),
        trimmed(F.col("message")).alias("commitMessage"),
        commit_url(F.col("git_url"), commit_id).alias("commitUrl"),
        F.col("author_ts").alias("commitDate"),
        F.col("author_tz").alias("commitTimeZone"),
        F.col("commit_number").alias("commitNumber"),
        parent_id(F.col("parents")).alias("parentCommitId"),
    )


def churn(changes: DataFrame, edits: DataFrame) -> DataFrame:
    """Add lines_added and lines_deleted to every file change."""
    key = ["project", "commit_id", "entry_pos"]
    sums = edits.groupBy(*key).agg(
        F.sum("len_b").cast("bigint").alias("lines_added"),
        F.sum("len_a").cast("bigint").alias("lines_deleted"),
    )
    return changes.join(sums, key, "left").na.fill(0, ["lines_added", "lines_deleted"])


def project_table(
    requested: DataFrame, totals: DataFrame, inventory: DataFrame, thresholds: str
) -> DataFrame:
    """One row per project, as written when its run starts.

    ``requested`` has project, dataset, git_url, date_of_processing and
    size_in_bytes; ``totals`` and ``inventory`` come from ``commit_totals`` and
    ``project_inventory``.
    """
    cuts = parse_thresholds(F.lit(thresholds)).cast("string")
    return (
        requested.join(totals, "project", "left")
        .join(inventory, "project", "left")
        .select(
            "project",
            F.col("dataset").alias("datasetName"),
            F.col("git_url").alias("gitUrl"),
            project_name(F.col("git_url")).alias("projectName"),
            F.col("date_of_processing").alias("dateOfProcessing"),
            F.lit(None).cast("timestamp").alias("finishedDate"),
            F.coalesce("commits", F.lit(0)).alias("commits"),
            cuts.alias("commitCountThresholds"),
            *[
                F.coalesce(c, F.lit(0)).alias(c)
                for c in (
                    "javaLoc", "numberOfProductionFiles", "numberOfTestFiles",
                    "productionLoc", "testLoc", "exceptionsCount",
                )
            ],
            F.coalesce("size_in_bytes", F.lit(-1)).alias("projectSizeInBytes"),
            F.col("last_commit_hash").alias("lastCommitHash"),
            is_local_url(F.col("git_url")).alias("isLocal"),
        )
    )
