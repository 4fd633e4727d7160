"""Every registered query against its DuckDB text on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from codehist.operators import commits as cm
from codehist.operators import labels as lb
from codehist.operators.events import event_log
from codehist.operators.history import file_history
from codehist.operators.lineage import rename_lineage
from codehist.session import staged
from tests.compare import difference, duck
from workload import catalog
from workload import views as vw

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.DUCK) == set(catalog.SPARK) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.SPARK))
def test_query_equals_sql(spark, con, name):
    text = difference(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert not text or text == "both empty", text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "project", "path", "stable_commit", "fired", "base_commit", "base_n", "refactorings"
    ]
    assert df.count() > 0


@pytest.mark.parametrize("cuts,counts", [((2, 5), {2: 218, 5: 148}), ((3, 8), {3: 130, 8: 80})])
def test_known_firings(spark, cuts, counts):
    """Every signup label and every rename resets; counts worked out beforehand."""
    commits = cm.without_merges(vw.commits(spark, FOLDER))
    changes = vw.changes(spark, FOLDER)
    labels = vw.fx(spark, FOLDER).filter("is_label").selectExpr(
        "project", "commit_id", "concat(stem, ver, '.java') as path"
    )
    log = event_log(commits, changes, labels, lb.diff_renames(changes))
    history = file_history(staged(rename_lineage(staged(log))), cuts)
    fired = history.filter("fired is not null").groupBy("fired").count().collect()
    assert {r.fired: r["count"] for r in fired} == counts


# queries that only build a plan; the others write tables on the way
LAZY = [
    "commit_replay", "commit_range", "commit_meta", "churn", "label_targets", "label_method_join",
    "refactoring_instances", "mark_invalid", "distinct_names", "wide_stable_files", "project_inventory",
    "project_blocks", "project_totals", "exception_counts", "error_sites", "commit_timing", "new_projects",
]


@pytest.mark.parametrize("name", LAZY)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"):
        assert word not in plan
