"""Data-quality checks and clean-up of the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.functions.names import error_state, is_class_rename
from codehist.operators.labels import failing_labels
from codehist.plans.ordered import spread, unbroadcast

COMMIT = ["project", "commit_id"]
# the columns that make two rows the same instance: label instances and stable ones
SAME = [
    "project", "commit_id", "filePath", "className", "isTest", "level", "classMetrics",
    "methodMetrics", "variableMetrics", "fieldMetrics", "processMetrics",
]
OF_LABELS, OF_STABLE = ["refactoring", "refactoringSummary"], ["commitThreshold"]


def mark_invalid(instances: DataFrame, limit: int = 50) -> DataFrame:
    """Commits with ``limit`` or more labels on one class: all rows turn invalid."""
    bad = (
        instances.groupBy(*COMMIT, "className")
        .agg(F.count("className").alias("_n"))
        .filter(F.col("_n") >= limit)
        .select(*COMMIT)
        .distinct()
        .withColumn("_bad", F.lit(True))
    )
    valid = F.coalesce("isValid", F.lit(True)) & F.col("_bad").isNull()
    return instances.join(bad, COMMIT, "left").withColumn("isValid", valid).drop("_bad")


def valid_instances(instances: DataFrame, project: str | None = None) -> DataFrame:
    """Rows marked as valid, of one project if given; rows without a mark are left out."""
    valid = instances.filter(F.col("isValid"))
    return valid if project is None else valid.filter(F.col("project") == project)


def in_order(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows sorted by project, place of the commit in the walk, and id: a stable order to read in."""
    at = commits.select(*COMMIT, "walk_pos")
    return rows.join(at, COMMIT, "left").orderBy("project", "walk_pos", "id").drop("walk_pos")


def duplicate_instances(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per project: valid rows, distinct ones, and how many are one too many."""
    same = columns or [c for c in [*SAME, *OF_LABELS, *OF_STABLE] if c in rows.columns]
    if "isValid" in rows.columns:
        rows = valid_instances(rows)
    counted = rows.groupBy(*{"project": 0, **dict.fromkeys(same, 0)}).agg(F.count("*").alias("_n"))
    return counted.groupBy("project").agg(
        F.sum("_n").alias("rows"),
        F.count("*").alias("distinct_rows"),
        (F.sum("_n") - F.count("*")).alias("duplicates"),
    )


def distinct_names(rows: DataFrame) -> DataFrame:
    """Distinct classes and files per project, production and test apart."""
    # one row per name first: the counts then need no sets in memory
    classes = rows.select("project", "isTest", F.lit("class").alias("what"), F.col("className").alias("name"))
    files = rows.select("project", "isTest", F.lit("file").alias("what"), F.col("filePath").alias("name"))
    names = classes.unionByName(files).distinct()
    return names.groupBy("project", "isTest").agg(
        F.count_if(F.col("what") == "class").alias("classes"),
        F.count_if(F.col("what") == "file").alias("files"),
    )


def orphan_commits(instances: DataFrame, stable: DataFrame, commit_meta: DataFrame) -> DataFrame:
    """Commits used by valid rows but not described, or described but not used."""
    used = valid_instances(instances).select(*COMMIT).unionByName(stable.select(*COMMIT)).distinct()
    known = commit_meta.select(*COMMIT).distinct()
    return (
        used.join(known, COMMIT, "left_anti")
        .withColumn("problem", F.lit("not described"))
        .unionByName(known.join(used, COMMIT, "left_anti").withColumn("problem", F.lit("not used")))
    )


def inconsistent_projects(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("exceptionsCount") > 0)


def new_projects(requested: DataFrame, projects: DataFrame) -> DataFrame:
    """Requested projects not in the tables yet, by URL."""
    known = projects.select(F.col("gitUrl").alias("git_url"))
    return requested.join(known, "git_url", "left_anti")


def repeated_projects(requested: DataFrame) -> DataFrame:
    return requested.groupBy("git_url").agg(F.count("*").alias("times")).filter("times > 1")


def unfinished(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("finishedDate").isNull()).select("project")


def drop_projects(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given projects."""
    return {n: t.join(gone.select("project"), "project", "left_anti") for n, t in tables.items()}


def drop_unfinished(tables: dict[str, DataFrame], projects: DataFrame) -> dict[str, DataFrame]:
    """Tables (and projects) without the projects that never finished."""
    left = drop_projects(tables, unfinished(projects))
    return left | {"project": projects.filter(F.col("finishedDate").isNotNull())}


def drop_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """Every table without one project; rows that name no project stay."""
    gone = F.col("project").eqNullSafe(F.lit(project))
    return {n: t.filter(~gone) for n, t in tables.items()}


#: Characters of the pieces by which lines and what they may contain are brought together.
GRAM = 12
#: Tasks over which the lines of one piece are dealt.
DEALT = 16


def _grams(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substr(text, k, size)))


def containing(lines: DataFrame, needles: DataFrame) -> DataFrame:
    """Pairs of lines (column line) and needles (column needle) that they contain, with all their columns; an empty needle is in no line.

    A line that contains a needle contains all its pieces. Of these the one that the fewest
    lines have brings both together; shorter needles are pieces of their own. Pieces are many more
    than the bytes of their tables tell, so lines are spread first (by a hash,
    as Spark drops a shuffle by columns that rows lie by already) and no side is broadcast; the lines of a
    piece that most of them have are dealt to several tasks, and the needles copied to each of them.
    """
    size = F.least(F.length("needle"), F.lit(GRAM))
    asked = spread(needles.filter("length(needle) > 0"), F.xxhash64("needle")).withColumn("_size", size)
    sizes = sorted(r["_size"] for r in asked.select("_size").distinct().collect())  # at most GRAM of them
    held = spread(lines, F.xxhash64("line")).withColumn("_size", F.explode(F.lit(sizes).cast("array<int>"))).filter(F.length("line") >= F.col("_size"))
    held = held.withColumn("_gram", F.explode(_grams(F.col("line"), F.col("_size")))).drop("_size")
    counts = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    pieces = asked.select("needle", F.explode(_grams(F.col("needle"), F.col("_size"))).alias("_gram")).distinct()
    rarest = pieces.join(unbroadcast(counts), "_gram").groupBy("needle").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    found = asked.drop("_size").join(unbroadcast(rarest), "needle").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dealt = held.withColumn("_deal", F.pmod(F.xxhash64("line"), F.lit(DEALT)).cast("int"))
    return found.join(unbroadcast(dealt), ["_gram", "_deal"]).filter(F.contains("line", "needle")).drop("_gram", "_deal")


def failed_projects(runs: DataFrame) -> DataFrame:
    """The failure ledger: the lines of projects that are running or have failed.

    ``runs`` has git_url, dataset, status (started, finished, failed), reason,
    exception and pos, the place of each step in the order of the run. A start
    adds a line with URL and dataset, a failure one with URL, reason and
    exception. At the end of a run every line so far that *contains* its URL and
    dataset goes, also of other runs (``x, set1`` is part of ``x, set10``).
    """
    info = F.concat_ws(", ", "git_url", "dataset")
    line = F.when(F.col("status") == "started", info).otherwise(F.concat_ws(", ", "git_url", "reason", "exception"))
    lines = runs.filter("status in ('started', 'failed')").select("git_url", "status", "pos", line.alias("line"))
    ends = runs.filter("status <> 'started'").groupBy(info.alias("needle")).agg(F.max("pos").alias("_end"))
    gone = containing(lines.groupBy("line").agg(F.min("pos").alias("_first")), ends).filter("_first <= _end")
    gone = gone.groupBy("line").agg(F.max("_end").alias("_end"))
    return lines.join(unbroadcast(gone), "line", "left").filter("_end is null or pos > _end").select("git_url", "line")


def quarantine(labels: DataFrame) -> DataFrame:
    """Per commit the label at which it fails, with the reason and a text for the log."""
    no_before, no_after = (F.coalesce(F.size(side), F.lit(0)) <= 0 for side in ("before", "after"))
    broken = labels.filter(is_class_rename(F.col("type")) & (no_before | no_after))
    reason = F.when(no_before, "no class before").otherwise("rename without class after")
    renames = broken.groupBy(*COMMIT).agg(F.min(F.struct("ref_pos", reason.alias("reason"))).alias("first")).select(*COMMIT, "first.*")
    # a rename that lacks a class fails before the first label is looked at
    others = failing_labels(labels).select(*COMMIT, "ref_pos", "reason").join(renames.select(*COMMIT), COMMIT, "left_anti")
    return renames.unionByName(others).select(*COMMIT, "ref_pos", "reason", error_state(F.col("commit_id"), F.col("project")).alias("state"))
