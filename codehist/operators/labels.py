"""Detected labels: which count, which files and classes they concern, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehist.functions.names import (
    file_is_missing,
    is_anonymous_class,
    is_class_rename,
    is_legacy_type,
    is_studied,
    refactoring_level,
    simplify_method_name,
    takes_all_classes,
)

COMMIT = ["project", "commit_id"]
LABEL = [*COMMIT, "ref_pos"]


def studied_refactorings(labels: DataFrame, legacy_only: bool = False) -> DataFrame:
    """Labels of the 41 studied types, with their level code."""
    kept = labels.filter(is_studied(F.col("type")))
    if legacy_only:
        kept = kept.filter(is_legacy_type(F.col("type")))
    return kept.withColumn("level", refactoring_level(F.col("type")))


def _selected(side: str):
    """All classes of the label, or the first one only, in detector order."""
    distinct = F.array_distinct(side)
    return F.when(takes_all_classes(F.col("type")), distinct).otherwise(F.slice(distinct, 1, 1))


def refactored_classes(labels: DataFrame) -> DataFrame:
    """One row per (label, concerned class): adds class_pos, file and class."""
    return labels.select("*", F.posexplode(_selected("before")).alias("class_pos", "_pair")).select(
        *labels.columns, "class_pos", "_pair.file", F.col("_pair.class").alias("class")
    )


def failing_labels(labels: DataFrame) -> DataFrame:
    """Per commit the first place at which working through its labels fails, and why.

    Labels are taken in order, and the classes of a label in order: adds ref_pos,
    class_pos and reason. What comes before that place counts, what comes after
    is lost. Labels that concern all their classes may have none.
    """
    studied = labels.filter(is_studied(F.col("type")))
    no_class = (F.coalesce(F.size("before"), F.lit(0)) <= 0) & ~takes_all_classes(F.col("type"))
    unnamed = F.transform(_selected("before"), lambda p: p["file"].isNull() | (~file_is_missing(p["file"]) & p["class"].isNull()))
    at = F.coalesce(F.array_position(unnamed, True), F.lit(0))
    method = F.col("method_full_name")
    unreadable = (F.coalesce(F.size("before"), F.lit(0)) > 0) & method.isNotNull() & simplify_method_name(method).isNull()
    reason = (
        F.when(F.col("summary").isNull(), "no summary")
        .when(no_class, "no class before")
        .when(unreadable & (at != 1), "method name not readable")
        .when(at > 0, "no class name")
    )
    place = F.when(reason == "no class name", at - 1).otherwise(0).cast("int")
    failing = studied.select(*LABEL, place.alias("class_pos"), reason.alias("reason")).filter("reason is not null")
    first = failing.groupBy(*COMMIT).agg(F.min(F.struct("ref_pos", "class_pos", "reason")).alias("first"))
    return first.select(*COMMIT, "first.*")


def until_failure(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """``rows`` (ref_pos, class_pos) of each commit that come before its failure."""
    cut = failures.select(*COMMIT, F.struct("ref_pos", "class_pos").alias("_fails"))
    kept = rows.join(cut, COMMIT, "left").filter(F.col("_fails").isNull() | (F.struct("ref_pos", "class_pos") < F.col("_fails")))
    return kept.drop("_fails")


def old_path_map(changes: DataFrame) -> DataFrame:
    """Old path of every new path in a commit; the last diff entry wins."""
    return changes.groupBy(*COMMIT, "new_path").agg(F.max_by("old_path", "entry_pos").alias("old_path"))


def class_aliases(labels: DataFrame) -> DataFrame:
    """Class name before a rename, per commit and name after it; the last label wins."""
    return (
        labels.filter(is_class_rename(F.col("type")))
        .select(
            *LABEL,
            F.get("after", 0)["class"].alias("class"),
            F.get("before", 0)["class"].alias("alias"),
        )
        .groupBy(*COMMIT, "class")
        .agg(F.max_by("alias", "ref_pos").alias("alias"))
    )


def label_targets(commits: DataFrame, labels: DataFrame, changes: DataFrame) -> DataFrame:
    """Studied labels of processed commits, one row per concerned class.

    Adds parent_id, level, class_pos, class, alias and path: the path before
    the commit. Labels on new files and on anonymous classes are dropped, and
    so are those that come after a label that fails.
    """
    parents = commits.filter(F.size("parents") == 1).select(
        *COMMIT, F.get("parents", 0).alias("parent_id")
    )
    studied = studied_refactorings(labels).join(parents, COMMIT)
    rows = until_failure(refactored_classes(studied), failing_labels(labels))
    # only commits with labels need their old paths
    asked = changes.join(studied.select(*COMMIT).distinct(), COMMIT, "left_semi")
    old = old_path_map(asked).withColumnRenamed("new_path", "file")
    path = F.when(~is_class_rename(F.col("type")), F.col("old_path"))
    rows = rows.join(old, [*COMMIT, "file"], "left").withColumn("path", F.coalesce(path, "file"))
    rows = rows.filter(~file_is_missing(F.col("path")) & ~is_anonymous_class(F.col("class")))
    return rows.join(class_aliases(labels), [*COMMIT, "class"], "left").drop("old_path")


def diff_renames(changes: DataFrame) -> DataFrame:
    """Distinct (old, new) pairs the diff saw as renames, per commit."""
    return (
        changes.filter("change_type = 'RENAME'")
        .groupBy(*COMMIT, "old_path", "new_path")
        .agg(F.min("entry_pos").alias("pos"))
    )


def detector_renames(labels: DataFrame) -> DataFrame:
    """Distinct (old, new) pairs of the class-rename labels, per commit.

    Labels without classes on one side have no pair; see ``quality.quarantine``.
    """
    return (
        labels.filter(is_class_rename(F.col("type")))
        .select(
            *LABEL,
            F.get("before", 0)["file"].alias("old_path"),
            F.get("after", 0)["file"].alias("new_path"),
        )
        .filter("old_path is not null and new_path is not null")
        .groupBy(*COMMIT, "old_path", "new_path")
        .agg(F.min("ref_pos").alias("pos"))
    )


def missed_renames(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """Renames the diff saw and the detector did not."""
    return diff_renames(changes).join(
        detector_renames(labels), [*COMMIT, "old_path", "new_path"], "left_anti"
    )


def broken_commits(labels: DataFrame) -> DataFrame:
    """Commits with a class rename that lacks a class on one side.

    Such a label fails the whole commit: it keeps its number, but none of its
    rows and state changes.
    """
    empty = (F.coalesce(F.size("before"), F.lit(0)) <= 0) | (F.coalesce(F.size("after"), F.lit(0)) <= 0)
    return labels.filter(is_class_rename(F.col("type")) & empty).select(*COMMIT).distinct()
