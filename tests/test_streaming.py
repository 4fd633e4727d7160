import random

import pytest
from pyspark.sql import functions as F

from codehist.operators.events import EVENT_COLUMNS
from codehist.streaming.tracker import MARKER, PROGRESS, FileTracker, results, stream_file_state

from tests.replay import replay
from tests.test_history import random_log


def with_markers(log, commits):
    per = {p: 0 for p in range(1, commits + 1)}
    for e in log:
        per[e["walk_pos"]] += 1
    marks = [dict(project="p", path=None, old_path=None, walk_pos=p, phase=0, pos=0, commit_id=f"c{p}", resets=n,
                  clears=0, author=None, added=0, deleted=0, is_bug=0, ends=0) for p, n in per.items()]
    return log + marks


@pytest.mark.parametrize("seed,detector,deletes", [(21, False, 0.0), (22, True, 0.0), (23, False, 0.15)])
def test_stream_equals_replay(spark, tmp_path, seed, detector, deletes):
    cuts, commits, files = (2, 5, 6), 160, 4
    log = random_log(seed, commits=commits, files=files, detector=detector, deletes=deletes)
    if detector:
        log = [e for e in log if e["phase"] != 1 or e["walk_pos"] % 4 == 0]
    rows = with_markers(log, commits)
    # rows of neighbouring commits end up in different files: commits must wait for them
    rnd = random.Random(seed)
    order = sorted(rows, key=lambda e: e["walk_pos"] + rnd.randrange(12))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    size = len(order) // files + 1
    for i in range(0, len(order), size):
        spark.createDataFrame(order[i:i + size], EVENT_COLUMNS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENT_COLUMNS).option("maxFilesPerTrigger", 1).parquet(src)
    stream_file_state(stream, out, cuts, block=16).awaitTermination(900)
    labels, fired, _, live = replay(log, cuts)
    stable = [
        (r.stable_commit, r.path, r.fired, r.base_commit, (
            r.base_n, r.lines_added, r.lines_deleted, r.bug_fixes, r.refactorings,
            r.authors, r.minor, r.major, round(r.ownership, 9)))
        for r in results(spark, out, "stable").collect()
    ]
    assert sorted(stable) == sorted(fired)
    got = [
        (r.commit_id, r.path, (r.n, r.lines_added, r.lines_deleted, r.bug_fixes, r.refactorings - r.resets + i,
                               r.authors, r.minor, r.major, round(r.ownership, 9)))
        for r in results(spark, out, "labels").collect() for i in range(r.resets)
    ]
    assert sorted(got) == sorted(labels)
    for batch in range(files):
        paths = [(r.project, r.path) for r in spark.read.parquet(f"{out}/files/batch={batch}").collect()]
        assert len(paths) == len(set(paths))
    last = spark.read.parquet(f"{out}/files/batch={files - 1}").collect()
    assert {(r.path, r.n) for r in last} == {(p, t.metrics[0]) for p, t in live.items()}
    assert results(spark, out, "late").count() == 0


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = with_markers(random_log(5, commits=30, files=3), 30)
    first = [e for e in rows if e["walk_pos"] <= 15]
    tracker = FileTracker(spark, str(tmp_path / "t"), (2, 5), block=8)
    tracker.process(spark.createDataFrame(first, EVENT_COLUMNS), 0)
    rest = spark.createDataFrame([e for e in rows if e["walk_pos"] > 10], EVENT_COLUMNS)
    seen = []
    for _ in range(2):
        tracker.process(rest, 1)
        seen.append(sorted(map(tuple, results(spark, str(tmp_path / "t"), "stable").collect()), key=str))
    assert seen[0] == seen[1]
    late = results(spark, str(tmp_path / "t"), "late")
    assert {r.walk_pos for r in late.collect()} == set(range(11, 16))


def test_a_busy_project_is_not_split_in_one_task(spark, tmp_path):
    rows = [("p", None, None, i, MARKER, 0, f"c{i}", 0, 0, None, 0, 0, 0, 0) for i in range(1, 400)]
    waiting = spark.createDataFrame(rows, EVENT_COLUMNS).repartition(8)
    progress = spark.createDataFrame([("p", 300)], PROGRESS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ready, pending, late, reached = FileTracker(spark, str(tmp_path))._split(waiting, progress)
        tasks = late.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == 299 and max(r["count"] for r in tasks) < 100
        assert ready.count() == 100 and pending.count() == 0 and reached.collect()[0].next == 400
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
