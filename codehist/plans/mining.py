"""The whole run as one plan: history tables in, training rows out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehist.operators import labels as lb
from codehist.operators.commits import with_detection, without_merges
from codehist.operators.events import LABEL, event_log
from codehist.operators.history import file_history
from codehist.operators.instances import refactoring_instances, stable_rows, training_set
from codehist.operators.lineage import rename_lineage
from codehist.operators.process import author_stats, label_process_asof, process_metrics
from codehist.operators.stability import may_start, stable_files
from codehist.plans.ordered import BLOCK
from codehist.schemas import DEFAULT_THRESHOLDS
from codehist.session import staged


@dataclass
class Mined:
    instances: DataFrame
    stable: DataFrame
    history: DataFrame
    targets: DataFrame

    def training_set(self) -> DataFrame:
        return training_set(self.instances, self.stable)


def history_events(
    commits: DataFrame, changes: DataFrame, labels: DataFrame, resets: DataFrame, keep_deletes: bool = False
) -> DataFrame:
    """Event log of the processed commits.

    ``labels`` are all detected labels (for their renames), ``resets`` the
    labels that became rows: project, commit_id, path.
    """
    seen = labels.join(with_detection(commits).select(*lb.COMMIT), lb.COMMIT, "left_semi")
    return event_log(
        commits,
        changes,
        resets,
        lb.missed_renames(changes, seen),
        lb.detector_renames(seen),
        keep_deletes,
    )


def mine(
    commits: DataFrame,
    changes: DataFrame,
    labels: DataFrame,
    ck: DataFrame,
    thresholds: Sequence[int] = DEFAULT_THRESHOLDS,
    block: int = BLOCK,
    keep_deletes: bool = False,
) -> Mined:
    """``commits`` are the commits of the walk (or a range), ``changes`` carry churn."""
    processed = without_merges(commits).join(lb.broken_commits(labels), lb.COMMIT, "left_anti")
    targets = lb.label_targets(processed, labels, changes)
    found = staged(refactoring_instances(targets, ck))
    resets = found.filter("match_pos = 1").select(*lb.COMMIT, F.col("filePath").alias("path"))
    # both are read several times: by the rename edges, and by totals and rows
    log = staged(history_events(processed, changes, labels, resets, keep_deletes))
    events = staged(rename_lineage(log, block))
    history = file_history(events, thresholds, authors=True, block=block)
    # author metrics are asked for at labels and where a streak may start
    asked = (F.col("phase") == LABEL) | may_start(thresholds)
    measured = staged(author_stats(history, block, asked=asked))
    base = stable_files(history, thresholds, measured=measured).withColumn("n", F.col("base_n"))
    base = base.withColumn("processMetrics", process_metrics()).select(
        "project", "path", "base_commit", "stable_commit", "fired", "processMetrics"
    )
    return Mined(label_process_asof(found, measured, block), stable_rows(base, ck), history, targets)
