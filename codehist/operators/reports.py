"""Run statistics, from the result tables and from the run logs.

A log table has (file, line_no, line); see ``sources.tables.scan_log``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line formats of the run logs.
FINISHED = r"Finished mining http.+ in [0-9]+.[0-9]+ minutes"
FINISHED_MINUTES = r"Finished mining http.+ in ([0-9]+.[0-9]+) minutes"
FOUND = r"Found ([0-9]+) refactoring- and ([0-9]+) stable instances"
FOUND_AT = r"Found ([0-9]+) stable instances in the project with threshold: ([0-9]+)"
# letters, with single other characters between them: all an exception name may hold
NAME_RUN = r"^(?:[a-zA-Z]++[^a-zA-Z]?+)++"
EXCEPTION = r"^(..+Exception):"
ERROR_SITE = r"[a-zA-Z0-9_-]+ [0-9-]+ [0-9:]+ ERROR ([a-zA-Z]+:[0-9]+)"
OUT_OF_MEMORY = "java.lang.OutOfMemoryError:"
COMMIT_TIME = r"Processing commit ([a-zA-Z0-9]+) took ([0-9]+) milliseconds\."
# Thresholds of the run report.
REPORT_THRESHOLDS = [*range(15, 51, 5), *range(60, 101, 10)]
BLOCK_LINES = 15


def _group(pattern: str, group: int, of: str = "line") -> Column:
    return F.regexp_extract(of, pattern, group)


def _number(pattern: str, group: int) -> Column:
    return F.when(F.col("line").rlike(pattern), _group(pattern, group).cast("bigint"))


def project_stats(instances: DataFrame, stable: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows found per project, and stable rows per configured threshold.

    ``projects`` has project and thresholds (array); zero counts are kept.
    """
    found = instances.groupBy("project").agg(F.count("*").alias("refactorings"))
    at = stable.groupBy("project", F.col("commitThreshold").alias("threshold")).agg(
        F.count("*").alias("stable_at_threshold")
    )
    total = at.groupBy("project").agg(F.sum("stable_at_threshold").alias("stable"))
    rows = projects.select("project", F.explode("thresholds").alias("threshold"))
    return (
        rows.join(found, "project", "left")
        .join(total, "project", "left")
        .join(at, ["project", "threshold"], "left")
        .na.fill(0, ["refactorings", "stable", "stable_at_threshold"])
        .select("project", "threshold", "refactorings", "stable", "stable_at_threshold")
    )


def _minutes() -> Column:
    """Minutes of a finish line."""
    return F.when(F.col("line").rlike(FINISHED), _group(FINISHED_MINUTES, 1).try_cast("double"))


def run_totals(log: DataFrame) -> DataFrame:
    """Projects, minutes, refactoring and stable rows of all finished runs."""
    return log.agg(
        F.count_if(F.col("line").rlike(FINISHED)).alias("projects"),
        F.coalesce(F.sum(_minutes()), F.lit(0.0)).alias("minutes"),
        F.coalesce(F.sum(_number(FOUND, 1)), F.lit(0)).alias("refactorings"),
        F.coalesce(F.sum(_number(FOUND, 2)), F.lit(0)).alias("stable"),
    )


def threshold_totals(log: DataFrame, thresholds: Sequence[int] = tuple(REPORT_THRESHOLDS)) -> DataFrame:
    """Stable rows per threshold of the report, zero when there are none."""
    hits = log.filter(F.col("line").rlike(FOUND_AT)).select(
        _group(FOUND_AT, 2).cast("int").alias("threshold"), _group(FOUND_AT, 1).cast("bigint").alias("n")
    )
    sums = hits.groupBy("threshold").agg(F.sum("n").alias("stable"))
    wanted = log.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    )
    return wanted.join(sums, "threshold", "left").na.fill(0, ["stable"])


def _with_totals(sites: DataFrame, name: str) -> DataFrame:
    """Counts per name, and one row with a null name for all of them."""
    counts = sites.groupBy(name).agg(F.count("*").alias("n"))
    return counts.rollup(name).agg(F.sum("n").alias("n"), F.count("*").alias("distinct_names"))


def exception_counts(log: DataFrame) -> DataFrame:
    """Logged exceptions by class, with a total row (class null)."""
    run = _group(NAME_RUN, 0)
    names = log.filter(F.col("line").contains("Exception:")).select(
        F.regexp_extract(run, EXCEPTION, 1).alias("exception")
    )
    return _with_totals(names.filter("exception <> ''"), "exception")


def error_sites(error_log: DataFrame, terminal_log: DataFrame) -> DataFrame:
    """Logged errors by source line, and out-of-memory errors of the terminal."""
    hits = error_log.filter(F.col("line").rlike(ERROR_SITE)).select(_group(ERROR_SITE, 1).alias("site"))
    times = (F.length("line") - F.length(F.replace("line", F.lit(OUT_OF_MEMORY), F.lit("")))) / len(OUT_OF_MEMORY)
    oom = terminal_log.filter(F.col("line").contains(OUT_OF_MEMORY)).select(
        F.explode(F.array_repeat(F.lit(OUT_OF_MEMORY.rstrip(":")), times.cast("int"))).alias("site")
    )
    return _with_totals(hits.unionByName(oom), "site")


def project_blocks(log: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Finish lines with the lines after them.

    Every finish line asks for its following line numbers; overlapping blocks
    are joined, each line comes once.
    """
    asked = (
        log.filter(F.col("line").rlike(FINISHED))
        .select("file", F.explode(F.sequence("line_no", F.col("line_no") + lines)).alias("line_no"))
    )
    return log.join(asked, ["file", "line_no"], "left_semi")


def project_totals(blocks: DataFrame) -> DataFrame:
    """Sums over the lines of the finish blocks, and the average time per commit."""

    def total(name: str, alias: str) -> Column:
        found = F.regexp_extract_all("line", F.lit(f"{name}=([0-9]+)"), F.lit(1))
        numbers = F.transform(found, lambda x: x.cast("bigint"))
        return F.coalesce(
            F.sum(F.reduce(numbers, F.lit(0).cast("bigint"), lambda a, b: a + b)), F.lit(0)
        ).alias(alias)

    sums = blocks.agg(
        total("commits", "commits"),
        total("numberOfProductionFiles", "production_files"),
        total("numberOfTestFiles", "test_files"),
        total("javaLoc", "java_loc"),
        F.sum(_minutes()).alias("_minutes"),
    )
    per_commit = F.when(F.col("commits") > 0, F.col("_minutes") / F.col("commits") * 60000)
    return sums.withColumn("millis_per_commit", per_commit).drop("_minutes")


def commit_times(log: DataFrame) -> DataFrame:
    return log.filter(F.col("line").rlike(COMMIT_TIME)).select(
        _group(COMMIT_TIME, 1).alias("commit_id"), _group(COMMIT_TIME, 2).cast("bigint").alias("millis")
    )


def commit_timing(log: DataFrame) -> DataFrame:
    """Count, sum, whole average, and every commit tied for fastest or slowest.

    The extremes come from one aggregate; the ties are found by joining back.
    """
    times = commit_times(log)
    total = times.agg(
        F.count("*").alias("commits"),
        F.sum("millis").alias("total_millis"),
        F.expr("sum(millis) div count(*)").alias("average_millis"),
        F.min("millis").alias("_min"),
        F.max("millis").alias("_max"),
    )
    ends = total.select(
        "commits", "total_millis", "average_millis",
        F.explode(
            F.array(
                F.struct(F.lit("fastest").alias("end"), F.col("_min").alias("millis")),
                F.struct(F.lit("slowest").alias("end"), F.col("_max").alias("millis")),
            )
        ).alias("_e"),
    ).select("commits", "total_millis", "average_millis", "_e.*")
    return times.join(F.broadcast(ends), "millis")
