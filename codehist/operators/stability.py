"""Files that stayed unrefactored for a chosen number of commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.operators.events import ORDER
from codehist.operators.history import FILE
from codehist.operators.process import METRICS, latest_state, process_metrics


def _metric_names(history: DataFrame) -> list[str]:
    return [c for c in METRICS.values() if c in history.columns and c != "refactorings"]


def may_start(thresholds: Sequence[int]) -> Column:
    """Events a streak may start from: resets and ends of cycles."""
    return F.coalesce(F.col("fired") == max(thresholds), F.lit(False)) | (F.col("resets") > 0)


def streak_starts(history: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Rows a streak may start from, by commit count."""
    top = max(thresholds)
    return (
        history.filter(may_start(thresholds))
        .groupBy(*FILE, F.col("n").alias("base_n"))
        .agg(
            F.max(F.when(F.col("fired") == top, F.col("commit_id"))).alias("_cycle_commit"),
            *[F.max(c).alias(c) for c in _metric_names(history)],
        )
    )


def with_streak_start(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Add base_commit and the metrics as of base_n, zero at the very start."""
    names = [c for c in starts.columns if c not in (*FILE, "base_n", "_cycle_commit")]
    found = rows.drop(*names).join(starts, [*FILE, "base_n"], "left")
    in_cycle = F.col("base_n") > F.col("seg_base")
    return found.withColumns(
        {"base_commit": F.when(in_cycle, F.col("_cycle_commit")).otherwise(F.col("reset_commit"))}
        | {c: F.coalesce(c, F.lit(0.0 if c == "ownership" else 0)) for c in names}
    ).drop("_cycle_commit")


def stable_files(
    history: DataFrame,
    thresholds: Sequence[int],
    earlier: DataFrame | None = None,
    measured: DataFrame | None = None,
) -> DataFrame:
    """One row per firing, with the state at the commit the streak started from.

    That commit is the last reset (or the one that created the file), unless a
    full cycle lies behind: then it is the change that ended the cycle. Both
    are rows of the history, found by file and commit count; ``earlier`` holds
    those from before the history. ``measured`` holds the rows that may start a
    streak with more metrics than the history; metrics both lack are left out.
    """
    measured = history if measured is None else measured
    starts = streak_starts(measured, thresholds)
    if earlier is not None:
        starts = starts.unionByName(earlier.select(starts.columns)).groupBy(*FILE, "base_n")
        starts = starts.agg(*[F.max(c).alias(c) for c in ("_cycle_commit", *_metric_names(measured))])
    last = (F.col("fired") == max(thresholds)).cast("int")
    fired = history.filter(F.col("fired").isNotNull()).withColumns(
        {"stable_commit": F.col("commit_id"), "refactorings": F.col("refactorings") - last}
    )
    return with_streak_start(fired, starts).select(
        *FILE, "path", *ORDER, "stable_commit", "fired", "base_commit", "base_n", "refactorings",
        *_metric_names(measured),
    )


def stable_process_metrics(stable: DataFrame) -> DataFrame:
    """The base state of stable files as a processMetrics struct."""
    given = stable.withColumn("n", F.col("base_n"))
    return given.select(
        "project", "lineage", "path", "walk_pos", "stable_commit", "fired", "base_commit",
        process_metrics().alias("processMetrics"),
    )


def stable_now(history: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Live files whose commit counter stands on a threshold at the end.

    The counter is back at zero after the largest one.
    """
    cuts = sorted(set(thresholds))[:-1]
    return latest_state(history).filter(F.col("since_base").isin(cuts) if cuts else F.lit(False))
