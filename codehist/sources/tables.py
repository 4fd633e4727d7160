"""Readers of the input tables and lists, and writers of the result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codehist.session import staged

def project_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``x,git_url,dataset``: no header, no quoting, further fields ignored."""
    parts = F.split(column, ",")
    return lines.select(F.get(parts, 2).alias("dataset"), F.get(parts, 1).alias("git_url"))


def scan_projects(spark: SparkSession, path: str) -> DataFrame:
    return project_lines(spark.read.text(path))


def scan_sources(spark: SparkSession, folder: str, project: str, commit_id: str) -> DataFrame:
    """Java files below a folder as a ``source_files`` table, with their sizes.

    Bytes that are not UTF-8 give a null text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    java = files.filter(F.lower("path").endswith(".java") & ~F.col("path").contains("/.git/"))
    return java.select(
        F.lit(project).alias("project"),
        F.lit(commit_id).alias("commit_id"),
        "path",
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
        "length",
    )


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Text files (globs allowed) as (file, line_no, line), lines counted from 1.

    Large files are read in several splits. Lines are counted per split first,
    which shuffles counts only; a second scan adds each split's offset where the
    lines are read. Both scans see the same splits, as long as the files stay.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
    )
    splits = rows.groupBy("file", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first") + 1
    # written, so that its size is known: broadcast while it is small
    offsets = staged(splits.select("file", "_start", offset.alias("_offset")))
    numbered = rows.join(offsets, ["file", "_start"])
    return numbered.select("file", (F.col("_row") + F.col("_offset")).alias("line_no"), "line")


def write_rows(rows: DataFrame, path: str) -> None:
    """Write training rows by project; a re-run replaces its projects.

    Rebalancing gathers small projects and splits large ones into several
    files. Rows are sorted by level, so that readers skip by its min and max.
    """
    (
        rows.hint("rebalance", F.col("project"))
        .sortWithinPartitions("project", "level")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("project")
        .parquet(path)
    )


#: Rows of one row group of a stored state, at most; a lookup reads whole row groups.
GROUP_BYTES = 1 << 20


def write_state(latest: DataFrame, path: str) -> None:
    """Latest state of all files, laid out for lookups by project and path.

    Files of one project are sorted by path into small row groups, and each has a
    Bloom filter, so that a lookup reads the row groups that hold its paths and no others.
    """
    (
        latest.hint("rebalance", F.col("project"))
        .sortWithinPartitions("project", "path")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#path", "true")
        .option("parquet.block.size", str(GROUP_BYTES))
        .option("parquet.block.row.count.limit", "4096")
        .partitionBy("project")
        .parquet(path)
    )


def find_files(spark: SparkSession, path: str, project: str, paths: list[str]) -> DataFrame:
    """State of the files with these paths; what is not stored gives no row."""
    wanted = [F.col("path") == p for p in dict.fromkeys(paths)]
    if not wanted:
        return spark.read.parquet(path).limit(0)
    # one test per path, as sets of many values are not looked up in Bloom filters
    return spark.read.parquet(path).filter((F.col("project") == project) & reduce(lambda a, b: a | b, wanted))
