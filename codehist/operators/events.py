"""The event log: everything that touches the state of a file, in order.

Within a commit the order is: labels (1), renames seen by the detector (2),
renames seen only by the diff (3), changes (4), deletions (5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.functions.names import is_bug_fix, is_java_file

LABEL, DETECTOR_RENAME, DIFF_RENAME, CHANGE, DELETION = 1, 2, 3, 4, 5
ORDER = ["walk_pos", "phase", "pos"]

EVENT_COLUMNS = (
    "project string, path string, old_path string, walk_pos bigint, phase int, pos bigint, "
    "commit_id string, resets bigint, clears int, author string, added bigint, deleted bigint, "
    "is_bug int, ends int"
)


def _event(df: DataFrame, phase: int, **columns: Column) -> DataFrame:
    fields = dict(f.rsplit(" ", 1) for f in EVENT_COLUMNS.split(", "))
    defaults = {"phase": F.lit(phase), "pos": F.lit(0), "clears": F.lit(0), "is_bug": F.lit(0), "ends": F.lit(0)}
    defaults |= {c: F.lit(0) for c in ("resets", "added", "deleted")}
    defaults |= {c: F.col(c) for c in ("project", "walk_pos", "commit_id")}
    given = defaults | columns
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])


def change_events(
    commits: DataFrame, changes: DataFrame, keep_deletes: bool = False
) -> DataFrame:
    """One event per changed Java file; ``changes`` carries its line counts.

    Deleted files have no new path, so they never pass the Java filter. With
    ``keep_deletes`` they end the life of the old path instead.
    """
    position = commits.select(
        "project",
        "commit_id",
        "walk_pos",
        F.coalesce("author", F.lit("")).alias("author"),
        is_bug_fix(F.col("message")).cast("int").alias("is_bug"),
    )
    is_delete = F.col("change_type") == "DELETE"
    rows = changes.filter(is_java_file(F.col("new_path")) & ~is_delete).join(position, ["project", "commit_id"])
    log = _event(
        rows,
        CHANGE,
        path=F.col("new_path"),
        pos=F.col("entry_pos"),
        author=F.col("author"),
        added=F.col("lines_added"),
        deleted=F.col("lines_deleted"),
        is_bug=F.col("is_bug"),
    )
    if not keep_deletes:
        return log
    gone = changes.filter(is_java_file(F.col("old_path")) & is_delete).join(position, ["project", "commit_id"])
    return log.unionByName(_event(gone, DELETION, path=F.col("old_path"), pos=F.col("entry_pos"), ends=F.lit(1)))


def label_events(commits: DataFrame, labels: DataFrame) -> DataFrame:
    """One event per (commit, file) with labels; ``resets`` counts the labels.

    ``labels`` has project, commit_id and path (the path before the commit).
    """
    counted = labels.groupBy("project", "commit_id", "path").agg(F.count("*").alias("resets"))
    rows = counted.join(commits.select("project", "commit_id", "walk_pos"), ["project", "commit_id"])
    return _event(rows, LABEL, path=F.col("path"), resets=F.col("resets"))


def rename_events(commits: DataFrame, renames: DataFrame, detector: bool = False) -> DataFrame:
    """``renames`` has project, commit_id, pos, old_path, new_path.

    A rename seen only by the diff also resets the file. One seen by the
    detector does not, but the moved state forgets the last fired threshold.
    """
    rows = renames.filter("old_path <> new_path").join(
        commits.select("project", "commit_id", "walk_pos"), ["project", "commit_id"]
    )
    return _event(
        rows,
        DETECTOR_RENAME if detector else DIFF_RENAME,
        path=F.col("new_path"),
        old_path=F.col("old_path"),
        pos=F.col("pos"),
        resets=F.lit(0 if detector else 1),
        clears=F.lit(1 if detector else 0),
    )


def event_log(
    commits: DataFrame,
    changes: DataFrame,
    labels: DataFrame | None = None,
    diff_renames: DataFrame | None = None,
    detector_renames: DataFrame | None = None,
    keep_deletes: bool = False,
) -> DataFrame:
    log = change_events(commits, changes, keep_deletes)
    if labels is not None:
        log = log.unionByName(label_events(commits, labels))
    if diff_renames is not None:
        log = log.unionByName(rename_events(commits, diff_renames))
    if detector_renames is not None:
        log = log.unionByName(rename_events(commits, detector_renames, detector=True))
    return log
