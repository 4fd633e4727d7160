"""What windows and written tables carry: no more than they need."""

import re
import time

import __spark_entry__ as entry
from codehist.operators.events import EVENT_COLUMNS
from codehist.operators.history import closed_form_history
from codehist.session import shuffles_removed, staged, tables_made
from workload import views as vw

FOLDER = "/root/testdata/sf0.001"


def test_events_are_numbered_before_their_texts_are_made(spark, tmp_path):
    rows = [(i, i % 3, "view", None, float(i), '{"k": 5}') for i in range(1, 30)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = vw.fx(spark, str(tmp_path))
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(i for i, line in enumerate(lines) if "Window [" in line)
    assert not any("concat(" in line for line in lines[window:])
    got = {r.event_id: (r.commit_id, r.ver) for r in found.collect()}
    assert got == {i: (f"c{i}", sum(j % 7 == 0 for j in range(1, i + 1) if j % 3 == i % 3)) for i in range(1, 30)}


def test_totals_of_a_history_need_one_order(spark):
    log = spark.createDataFrame([], f"{EVENT_COLUMNS}, lineage string")
    plan = closed_form_history(log, (2, 5), authors=True)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_open" in line]
    assert len(windows) == 4 and not any(re.search(r"(max|min)\(_(reset_at|born)", line) for line in windows)


def test_author_metrics_write_only_what_they_are_made_of(spark):
    with tables_made() as paths:
        entry.queries()["wide_author_stats"](spark, FOLDER)
    (path,) = paths
    assert not {"lines_added", "bug_fixes", "reset_commit"} & set(spark.read.parquet(path).columns)


def test_lines_of_the_order_history_are_dealt_once(spark):
    plan = vw.wide_events(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "hashpartitioning(l_partkey" not in plan


def test_shuffle_files_of_a_written_table_are_removed(spark):
    def blocks():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {str(found.apply(i)) for i in range(found.size()) if str(found.apply(i)).startswith("shuffle_")}

    rows, before = spark.range(1000).repartition(7, "id"), blocks()
    with shuffles_removed(spark):
        kept = staged(rows)
    waits = time.time() + 20
    while blocks() - before and time.time() < waits:
        time.sleep(0.2)
    assert not blocks() - before and kept.count() == 1000
    staged(rows)
    assert blocks() - before
