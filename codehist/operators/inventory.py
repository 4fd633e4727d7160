"""Source files: listing, line counts, texts at a commit, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.functions.loc import source_loc
from codehist.functions.names import file_name_only, is_java_file, is_test_file

REQUEST = ["project", "commit_id", "path"]


def java_files(source_files: DataFrame, contains: str | None = None) -> DataFrame:
    path = F.col("path")
    kept = source_files.filter(is_java_file(path) & ~path.contains("/.git/"))
    return kept.filter(path.contains(contains)) if contains is not None else kept


def project_inventory(source_files: DataFrame) -> DataFrame:
    """Files and source lines per project, production and test apart.

    A file that could not be decoded (no text) has no lines and counts as one
    exception.
    """
    rows = java_files(source_files).select(
        "project",
        is_test_file(F.col("path")).alias("is_test"),
        source_loc(F.col("text")).cast("bigint").alias("loc"),
        F.col("text").isNull().alias("broken"),
    )

    def total(value: Column, test: bool) -> Column:
        return F.sum(F.when(F.col("is_test") == test, value).otherwise(0))

    return rows.groupBy("project").agg(
        total(F.lit(1), False).alias("numberOfProductionFiles"),
        total(F.lit(1), True).alias("numberOfTestFiles"),
        total(F.col("loc"), False).alias("productionLoc"),
        total(F.col("loc"), True).alias("testLoc"),
        F.sum("loc").alias("javaLoc"),
        F.count_if("broken").alias("exceptionsCount"),
    )


def source_at_commit(requests: DataFrame, source_files: DataFrame) -> DataFrame:
    """Text of every requested (project, commit_id, path); ``found`` tells misses."""
    texts = source_files.select(*REQUEST, "text", F.lit(True).alias("_hit"))
    rows = requests.join(texts, REQUEST, "left")
    return rows.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def source_archive(
    instances: DataFrame, labels: DataFrame, commits: DataFrame, source_files: DataFrame
) -> DataFrame:
    """Texts of all files of a label before (first parent) and after the commit.

    One row per (instance id, side, file name); files that cannot be read are
    left out. When two files share a name the later one stays, as on disk.
    """
    key = ["project", "commit_id", "ref_pos"]
    parents = commits.select("project", "commit_id", F.get("parents", 0).alias("_parent"))
    ids = instances.filter("match_pos = 1").select(*key, "id")
    rows = labels.select(*key, "before", "after").join(ids, key).join(parents, key[:2])
    sides = [("before", "_parent"), ("after", "commit_id")]
    asked = [
        rows.select(
            "project",
            "id",
            F.lit(side).alias("side"),
            F.col(at).alias("_at"),
            F.posexplode(side).alias("_pos", "_pair"),
        )
        for side, at in sides
    ]
    asked = asked[0].unionByName(asked[1]).withColumnsRenamed({"_at": "commit_id"})
    asked = asked.withColumn("path", F.col("_pair.file")).drop("_pair")
    found = source_at_commit(asked, source_files).filter(F.col("found") & F.col("text").isNotNull())
    return found.groupBy("project", "id", "side", file_name_only(F.col("path")).alias("file_name")).agg(
        F.max_by("text", "_pos").alias("text")
    )


def stable_archive(stable: DataFrame, source_files: DataFrame) -> DataFrame:
    """Texts of stable files as of their base commit; written for every firing."""
    asked = stable.select("project", F.col("base_commit").alias("commit_id"), "path", "fired")
    found = source_at_commit(asked, source_files).filter("found and text is not null")
    return found.select(
        "project", "commit_id", "path", "fired", F.lit("not-refactored").alias("side"), "text"
    )
