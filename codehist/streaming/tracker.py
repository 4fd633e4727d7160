"""The file tracker as a stream of event logs.

Each micro-batch continues the tables the last one left: totals per file and
commits per file and author. The work inside a batch is the batch operators',
so files of a busy project are spread over tasks; nothing is keyed by project.

Input rows are events (operators.events) plus one marker per commit: phase 0,
walk_pos the commit's number in its project counted from 1, resets the number
of its other rows. Commits wait until all their rows and all earlier commits
are there. Rows of commits already processed go to a table of their own.

State and results are written per batch id and only read from the batch
before, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codehist.operators.events import EVENT_COLUMNS, LABEL
from codehist.operators.history import FILE, Carry, file_history
from codehist.operators.lineage import rename_lineage
from codehist.operators.process import METRICS, author_stats, latest_state
from codehist.operators.stability import stable_files, streak_starts, with_streak_start
from codehist.plans.ordered import BLOCK, running, spread, unbroadcast
from codehist.schemas import DEFAULT_THRESHOLDS
from codehist.session import staged

_BASE = [c for c in METRICS.values() if c != "refactorings"]
FILES = (
    "project string, lineage string, path string, n bigint, lines_added bigint, lines_deleted bigint, "
    "bug_fixes bigint, resets_total bigint, seg_base bigint, closed bigint, reset_commit string, "
    "exact boolean, c bigint, i int, done bigint, base_n bigint, base_commit string, "
    + ", ".join(f"at_base_{c} {'double' if c == 'ownership' else 'bigint'}" for c in _BASE)
)
AUTHORS = "project string, lineage string, author string, k bigint"
PROGRESS = "project string, next bigint"
MARKER = 0


class FileTracker:
    """State in ``folder``, one version per micro-batch."""

    def __init__(
        self, spark: SparkSession, folder: str, thresholds: Sequence[int] = DEFAULT_THRESHOLDS, block: int = BLOCK
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.thresholds, self.block = tuple(sorted(thresholds)), block

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _load(self, table: str, schema: str, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table, batch))

    def _save(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(table, batch))

    def process(self, rows: DataFrame, batch: int) -> None:
        files = self._load("files", FILES, batch - 1)
        authors = self._load("authors", AUTHORS, batch - 1)
        progress = self._load("progress", PROGRESS, batch - 1)
        given = rows.select(*[f.rsplit(" ", 1)[0] for f in EVENT_COLUMNS.split(", ")])
        waiting = staged(given.unionByName(self._load("pending", EVENT_COLUMNS, batch - 1)))
        ready, pending, late, reached = self._split(waiting, progress)
        self._save(pending, "pending", batch)
        self._save(late, "late", batch)
        self._save(reached, "progress", batch)

        events = self._lineage(staged(ready.filter(F.col("phase") != MARKER)), files, batch)
        carry = Carry(files, authors)
        history = file_history(events, self.thresholds, authors=True, block=self.block, carry=carry)
        history = staged(author_stats(history, self.block, carry))
        earlier = files.select(
            *FILE, "base_n", F.col("base_commit").alias("_cycle_commit"),
            *[F.col(f"at_base_{c}").alias(c) for c in _BASE],
        )
        labels = history.filter(F.col("phase") == LABEL)
        self._save(labels.select(*FILE, "path", "commit_id", "walk_pos", "resets", *METRICS.values()), "labels", batch)
        self._save(stable_files(history, self.thresholds, earlier), "stable", batch)
        self._save_state(events, history, files, authors, earlier, batch)

    def _split(self, waiting: DataFrame, progress: DataFrame):
        """Rows that are ready, that wait, that come too late; and the new progress."""
        commit = ["project", "walk_pos"]
        # one number per project; a shuffle by project would put all rows of a busy one into one task
        known = waiting.join(F.broadcast(progress), "project", "left").na.fill(1, ["next"])
        late = known.filter("walk_pos < next").drop("next")
        open_rows = known.filter("walk_pos >= next")
        is_marker = F.col("phase") == MARKER
        complete = (
            open_rows.groupBy(*commit, "next")
            .agg(
                F.max(F.when(is_marker, F.col("resets"))).alias("_rows"),
                F.count_if(~is_marker).alias("_seen"),
            )
            .filter("_rows = _seen")
        )
        ranked = running(complete, ["project"], "walk_pos", ["walk_pos"], {"_rank": F.lit(1)}, self.block, slim=True)
        done = ranked.filter("walk_pos = next - 1 + _rank").select(*commit)
        ready = open_rows.drop("next").join(unbroadcast(done), commit, "left_semi")
        pending = open_rows.drop("next").join(unbroadcast(done), commit, "left_anti")
        reached = done.groupBy("project").agg((F.max("walk_pos") + 1).alias("next"))
        reached = reached.unionByName(progress).groupBy("project").agg(F.max("next").alias("next"))
        return ready, pending, late, reached

    def _lineage(self, events: DataFrame, files: DataFrame, batch: int) -> DataFrame:
        """Lineages of the batch, joined to those of the files known before."""
        root = F.regexp_extract("lineage", r"(?s)^(.*)#0\z", 1)
        local = rename_lineage(events, self.block).withColumn("_root", root)
        known = files.select("project", F.col("path").alias("_root"), F.col("lineage").alias("_known"))
        fresh = F.concat("lineage", F.lit(f"@{batch}"))
        rows = local.join(unbroadcast(known), ["project", "_root"], "left")
        return staged(rows.withColumn("lineage", F.coalesce("_known", fresh)).drop("_root", "_known"))

    def _save_state(self, events, history, files, authors, earlier, batch: int) -> None:
        top = self.thresholds[-1]
        starts = streak_starts(history, self.thresholds)
        starts = starts.unionByName(earlier.select(starts.columns)).groupBy(*FILE, "base_n")
        starts = starts.agg(*[F.max(c).alias(c) for c in ("_cycle_commit", *_BASE)])
        at_top = F.coalesce(F.col("fired") == top, F.lit(False))
        # after a full cycle the streak starts at this very change
        last = latest_state(history).withColumns(
            {"base_n": F.when(at_top, F.col("n")).otherwise(F.col("base_n")),
             "c": F.when(at_top, 0).otherwise(F.col("since_base")).cast("bigint"),
             "i": F.col("step")}
        )
        # the metrics of the start take the names of the current ones
        last = last.withColumns({f"_now_{c}": F.col(c) for c in _BASE})
        based = with_streak_start(last, starts)
        finished = F.floor((F.col("_now_n") - F.col("seg_base")) / F.lit(top)).cast("bigint")
        total = ["n", "lines_added", "lines_deleted", "bug_fixes"]
        updated = based.select(
            *FILE, "path", *[F.col(f"_now_{c}").alias(c) for c in total], "resets_total", "seg_base",
            (F.col("refactorings") - F.col("resets_total") - finished).alias("closed"),
            "reset_commit", "exact", "c", "i",
            (F.col("refactorings") - F.col("resets_total")).alias("done"),
            "base_n", "base_commit", *[F.col(c).alias(f"at_base_{c}") for c in _BASE],
        )
        touched = history.select(*FILE).distinct()
        entered = events.filter("old_path is not null").select("project", "path").distinct()
        kept = files.join(unbroadcast(touched), FILE, "left_anti").join(unbroadcast(entered), ["project", "path"], "left_anti")
        fields = [f.strip().split(" ") for f in FILES.split(",")]
        updated = updated.select(*[F.col(n).cast(t).alias(n) for n, t in fields])
        self._save(updated.unionByName(kept), "files", batch)
        live = self._load("files", FILES, batch).select(*FILE)
        counts = events.filter("author is not null").groupBy(*FILE, "author").agg(F.count("*").alias("k"))
        counts = spread(counts.unionByName(authors), *FILE)
        merged = counts.groupBy(*FILE, "author").agg(F.sum("k").alias("k"))
        self._save(merged.join(unbroadcast(live), FILE, "left_semi"), "authors", batch)


def stream_file_state(
    events: DataFrame,
    folder: str,
    thresholds: Sequence[int] = DEFAULT_THRESHOLDS,
    block: int = BLOCK,
    **trigger,
) -> StreamingQuery:
    """Start the tracker on a streaming event log; results lie below ``folder``."""
    tracker = FileTracker(events.sparkSession, folder, thresholds, block)
    writer = events.writeStream.foreachBatch(tracker.process)
    writer = writer.option("checkpointLocation", f"{tracker.folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def results(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All batches of ``labels``, ``stable`` or ``late``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}")
