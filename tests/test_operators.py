import random
from datetime import datetime

from pyspark.sql import functions as F

from codehist import schemas
from codehist.operators import commits as cm
from codehist.operators import instances as ins
from codehist.operators import labels as lb
from codehist.operators import quality as ql
from codehist.operators.events import EVENT_COLUMNS, event_log
from codehist.operators.history import closed_form_history, file_history
from codehist.operators.lineage import rename_lineage
from codehist.operators.process import author_stats, latest_state
from codehist.plans.mining import mine
from codehist.plans.ordered import running
from codehist.session import staged
from codehist.sources import tables as tb


def commit_rows(spark, parents, project="p"):
    rows = [
        (project, f"c{i}", ["x"] * n, "a", datetime(2024, 1, 1), "UTC", "m", i)
        for i, n in enumerate(parents, 1)
    ]
    return spark.createDataFrame(rows, schemas.COMMITS)


def ids(df):
    return [r.commit_id for r in df.orderBy("walk_pos").collect()]


def test_commit_range(spark):
    commits = commit_rows(spark, [0, 1, 2, 1, 2, 1])

    def between(first, last):
        bounds = spark.createDataFrame([("p", first, last)], "project string, first string, last string")
        return ids(cm.commit_replay(commits, bounds))

    assert between(None, None) == ["c1", "c2", "c4", "c6"]
    assert between("c3", "c5") == ["c4"]  # merges are bounds, but not processed
    assert between("c2", "c4") == ["c2", "c4"]
    assert between("gone", None) == []
    assert between(None, "gone") == ["c1", "c2", "c4", "c6"]
    assert between("c4", "c2") == ["c4", "c6"]  # the end never comes after the start
    numbers = cm.commit_replay(commits).orderBy("walk_pos").collect()
    assert [r.commit_number for r in numbers] == [1, 2, 3, 4]


def test_running_sums_over_blocks(spark):
    df = spark.range(1, 1001).selectExpr("id % 3 = 0 as g", "id as p", "id % 7 as v")
    for block in (1, 10, 333, 5000):
        rows = running(df, ["g"], "p", ["p"], {"s": F.col("v")}, block).collect()
        total = {}
        for r in sorted(rows, key=lambda r: r.p):
            total[r.g] = total.get(r.g, 0) + r.v
            assert r.s == total[r.g]
        assert len(rows) == 1000


def change(pos, path="A", author="a", added=1, deleted=1, bug=0):
    return dict(project="p", path=path, old_path=None, walk_pos=pos, phase=4, pos=0, commit_id=f"c{pos}",
                resets=0, clears=0, author=author, added=added, deleted=deleted, is_bug=bug, ends=0)


def label(pos, path="A", resets=1):
    return change(pos, path, None, 0, 0) | dict(phase=1, resets=resets)


def rename(pos, old, new):
    return change(pos, new, None, 0, 0) | dict(phase=3, old_path=old, resets=1)


def history(spark, log, thresholds=(10, 25)):
    events = staged(rename_lineage(spark.createDataFrame(log, EVENT_COLUMNS)))
    return author_stats(file_history(events, thresholds, authors=True))


def test_three_files_worked_out_by_hand(spark):
    """Q: an author with one of twenty commits owns exactly 5 %, and is minor one commit later, when two others are level. R: a label between, then a rename to S, then a new R."""
    who = ["ann", "ben"] * 9 + ["ann", "cy", "ben"]
    log = [change(i, "Q", a, added=i % 3, deleted=0, bug=int(i == 5)) for i, a in enumerate(who, 1)]
    log += [change(i, "R", added=0, deleted=i) for i in (31, 32, 33)] + [label(34, "R")] + [change(i, "R", added=0, deleted=1) for i in (35, 36, 37, 38)]
    log += [rename(39, "R", "S"), change(40, "S", added=7), change(41, "R", added=3)]
    rows = staged(history(spark, log, (4, 7)))
    q = {r.n: r for r in rows.filter("path = 'Q'").collect()}
    assert (q[20].authors, q[20].major, q[20].minor, q[20].ownership) == (3, 3, 0, 0.5)
    assert (q[21].authors, q[21].major, q[21].minor) == (3, 2, 1) and abs(q[21].ownership - 10 / 21) < 1e-9
    assert (q[21].lines_added, q[21].lines_deleted, q[21].bug_fixes, q[21].refactorings) == (21, 0, 1, 3)
    assert sorted((n, r.fired) for n, r in q.items() if r.fired) == [(4, 4), (7, 7), (11, 4), (14, 7), (18, 4), (21, 7)]
    fired = [(r.walk_pos, r.fired, r.base_n, r.reset_commit) for r in rows.filter("path = 'R' and fired is not null").collect()]
    assert fired == [(38, 4, 3, "c34")]
    now = {r.path: (r.n, r.lines_added, r.lines_deleted, r.refactorings) for r in latest_state(rows).collect()}
    assert now == {"Q": (21, 21, 0, 3), "S": (8, 7, 101, 2), "R": (1, 3, 1, 0)}


def test_deletes_are_optional(spark):
    commits = commit_rows(spark, [0, 1, 1])
    rows = [("p", "c1", 0, "ADD", "/dev/null", "A.java", 1, 0), ("p", "c2", 0, "DELETE", "A.java", "/dev/null", 0, 1),
            ("p", "c3", 0, "ADD", "/dev/null", "A.java", 1, 0), ("p", "c3", 1, "MODIFY", "b.txt", "b.txt", 1, 0)]
    changes = spark.createDataFrame(
        rows, "project string, commit_id string, entry_pos int, change_type string, old_path string, "
        "new_path string, lines_added long, lines_deleted long")

    def counts(keep):
        log = rename_lineage(staged(event_log(commits, changes, keep_deletes=keep)))
        return sorted(r.n for r in file_history(staged(log), (2,)).filter("phase = 4").collect())

    assert counts(False) == [1, 2]
    assert counts(True) == [1, 1]


def test_a_change_without_author_is_a_change(spark):
    log = [change(1), change(2, author=None), change(3)]
    assert [(r.path, r.n) for r in latest_state(history(spark, log)).collect()] == [("A", 3)]


def test_a_deleted_file_has_no_state(spark):
    gone = dict(phase=5, author=None, added=0, deleted=0, ends=1)
    log = [change(1), change(2) | gone, change(3, "B"), change(4, "C"), change(5, "C") | gone, change(6, "C")]
    assert sorted((r.path, r.n) for r in latest_state(history(spark, log)).collect()) == [("B", 1), ("C", 1)]


def label_row(no, type_, before, after=None, method=None, element=None):
    pair = lambda ps: [(f, c) for f, c in ps]
    return ("p", "c2", no, type_, type_.title(), f" {type_} ", pair(before), pair(after or before), method, element)


def test_labels_to_instances(spark):
    commits = commit_rows(spark, [0, 1])
    changes = spark.createDataFrame(
        [("p", "c2", 0, "RENAME", "A.java", "B.java", 1, 1), ("p", "c2", 1, "ADD", "/dev/null", "N.java", 1, 0)],
        "project string, commit_id string, entry_pos int, change_type string, old_path string, new_path string, "
        "lines_added long, lines_deleted long")
    a = ("A.java", "x.A")
    labels = spark.createDataFrame([
        label_row(0, "RENAME_CLASS", [a], [("B.java", "x.B")]),
        label_row(1, "RENAME_METHOD", [("B.java", "x.B")], method="Run/1[Map<K,V>]"),
        label_row(2, "RENAME_VARIABLE", [a], method="run/1[Map]", element="v"),
        label_row(3, "RENAME_VARIABLE", [a], method="run/1[Map]", element="none"),
        label_row(4, "RENAME_ATTRIBUTE", [a], element="f"),
        label_row(5, "EXTRACT_METHOD_X", [a]),
        label_row(6, "MOVE_OPERATION", [a], method="gone/0"),
        label_row(7, "EXTRACT_CLASS", [("N.java", "x.N")]),
        label_row(8, "EXTRACT_CLASS", [("A.java", "x.A.run")]),
        label_row(9, "EXTRACT_SUPERCLASS", [a, ("A.java", "x.A.I")]),
        label_row(10, "EXTRACT_CLASS", [a, ("A.java", "x.A.I")]),
    ], schemas.REFACTORINGS)

    def ck(name, kind):
        method = [("run/1[java.util.Map<K,V>]", 5, *[1] * 23, {"v": 3}, {"f": 2}),
                  ("other/0", 9, *[2] * 23, {}, {"f": 4})]
        metrics = [0.357 if m == "classTCC" else 1.0 if m == "classLCC" else 7 for m in schemas.CLASS_METRICS]
        return ("p", "x", "A.java", name, kind, *metrics, method)

    metrics = spark.createDataFrame([ck("x.A", "class"), ck("x.A$I", "innerclass")], schemas.CK_CLASSES)
    targets = lb.label_targets(cm.without_merges(commits), labels, changes)
    rows = {(r.ref_pos, r.class_pos): r for r in ins.refactoring_instances(targets, metrics).collect()}
    assert sorted(rows) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (9, 0), (9, 1), (10, 0)]
    assert rows[1, 0].className == "x.A" and rows[1, 0].filePath == "A.java"  # by its alias and old path
    assert rows[1, 0].methodMetrics.fullMethodName == "run/1[Map]"
    assert rows[2, 0].variableMetrics.variableAppearances == 3
    assert rows[3, 0].variableMetrics.variableAppearances == -1
    assert rows[4, 0].fieldMetrics.fieldAppearances == 6
    assert (rows[0, 0].classMetrics.classTCC, rows[0, 0].classMetrics.classLCC) == (365, 1024)
    assert [rows[9, i].classMetrics.isInnerClass for i in (0, 1)] == [False, True]
    assert rows[0, 0].refactoringSummary == "RENAME_CLASS"
    lost = ins.labels_without_metrics(targets, ins.refactoring_instances(targets, metrics))
    assert [r.ref_pos for r in lost.collect()] == [6]
    assert lb.missed_renames(changes, labels).count() == 0
    stable = spark.createDataFrame([("p", "A.java", "x", 2)], "project string, path string, base_commit string, fired int")
    units = ins.stable_rows(stable, metrics).groupBy("className", "level").count().collect()
    assert {(r.className, r.level): r["count"] for r in units} == {
        (c, level): n for c in ("x.A", "x.A.I") for level, n in ((1, 1), (2, 2), (3, 1), (4, 1))}


def test_the_first_match_is_one_that_has_the_method(spark):
    """The class of the new name lacks the method, that of the old name has it: the label keeps its metrics and resets the file."""
    commits = commit_rows(spark, [0, 1])
    changes = spark.createDataFrame(
        [("p", f"c{i}", 0, "MODIFY", "A.java", "A.java", 1, 0) for i in (1, 2)],
        "project string, commit_id string, entry_pos int, change_type string, old_path string, new_path string, "
        "lines_added long, lines_deleted long")
    labels = spark.createDataFrame([
        label_row(0, "RENAME_CLASS", [("A.java", "x.Old")], [("A.java", "x.New")]),
        label_row(1, "RENAME_METHOD", [("A.java", "x.New")], method="run/0"),
    ], schemas.REFACTORINGS)

    def ck(name, kind, *methods):
        return ("p", "x", "A.java", name, kind, *[7.0 if m.endswith("CC") else 7 for m in schemas.CLASS_METRICS],
                [(m, 1, *[1] * 23, {}, {}) for m in methods])

    rows = [ck("x.New", "class", "other/0"), ck("x.Old", "class", "run/0"), ck("x.Old", "enum", "run/0")]
    mined = mine(commits, changes, labels, spark.createDataFrame(rows, schemas.CK_CLASSES), (2,))
    found = {(r.ref_pos, r.className, r.match_pos): r.processMetrics for r in mined.instances.collect() if r.ref_pos == 1}
    assert set(found) == {(1, "x.Old", 1), (1, "x.Old", 2)}
    assert found[1, "x.Old", 1].qtyOfCommits == 1 and found[1, "x.Old", 2] is None
    assert [r.resets for r in mined.history.filter("phase = 1").collect()] == [2]


def test_valid_rows_in_order(spark):
    rows = [("p", "c2", "i3", True), ("p", "c1", "i9", True), ("p", "c2", "i1", True), ("p", "c1", "i2", None), ("p", "c1", "i4", False), ("q", "c1", "i0", True), (None, "c1", "i7", True)]
    df = spark.createDataFrame(rows, "project string, commit_id string, id string, isValid boolean")
    assert sorted(r.id for r in ql.valid_instances(df).collect()) == ["i0", "i1", "i3", "i7", "i9"]
    commits = commit_rows(spark, [0, 1]).withColumnRenamed("x", "y")
    assert [r.id for r in ql.in_order(ql.valid_instances(df, "p"), commits).collect()] == ["i9", "i1", "i3"]
    assert sorted(r.id for r in ql.drop_project({"t": df}, "p")["t"].collect()) == ["i0", "i7"]
    assert [r.id for r in ins.commit_instances(df, "c2").orderBy("id").collect()] == ["i1", "i3"]


def test_duplicates_and_used_commits_among_valid_rows(spark):
    columns = "project string, commit_id string, className string, refactoring string, refactoringSummary string, isValid boolean"
    rows = [("p", "c1", "A", "Rename", "s", True)] * 2 + [("p", "c1", "A", "Move", "s", True), ("p", "c1", "A", "Rename", "s", False), ("p", "c2", "A", "Rename", "s", False)]
    df = spark.createDataFrame(rows, columns)
    assert [tuple(r) for r in ql.duplicate_instances(df).collect()] == [("p", 3, 2, 1)]
    meta = spark.createDataFrame([("p", "c1"), ("p", "c3")], "project string, commit_id string")
    stable = meta.limit(0)
    got = {(r.commit_id, r.problem) for r in ql.orphan_commits(df, stable, meta).collect()}
    assert got == {("c3", "not used")}


def test_broken_commit_changes_nothing(spark):
    commits = commit_rows(spark, [0, 1, 1])
    changes = spark.createDataFrame(
        [("p", f"c{i}", 0, "MODIFY", "A.java", "A.java", 1, 0) for i in (1, 2, 3)],
        "project string, commit_id string, entry_pos int, change_type string, old_path string, new_path string, "
        "lines_added long, lines_deleted long")
    labels = spark.createDataFrame(
        [label_row(0, "RENAME_CLASS", [], [("A.java", "x.A")])], schemas.REFACTORINGS)
    metrics = spark.createDataFrame([], schemas.CK_CLASSES)
    mined = mine(commits, changes, labels, metrics, (2,))
    assert sorted((r.commit_id, r.n) for r in mined.history.collect()) == [("c1", 1), ("c3", 2)]
    assert [r.reason for r in ql.quarantine(labels).collect()] == ["no class before"]


def test_invalid_marks_whole_commits(spark):
    rows = [("p", "c1", "A")] * 3 + [("p", "c1", "B"), ("p", "c2", "A")]
    df = spark.createDataFrame(rows, "project string, commit_id string, className string").withColumn("isValid", F.lit(True))
    out = ql.mark_invalid(df, 3).collect()
    assert sorted((r.commit_id, r.isValid) for r in out) == [("c1", False)] * 4 + [("c2", True)]


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "list.csv").write_text('1,https://x.org/a.git,set\n2,"q",set2,more\n')
    rows = tb.scan_projects(spark, str(tmp_path / "list.csv")).collect()
    assert [tuple(r) for r in rows] == [("set", "https://x.org/a.git"), ("set2", '"q"')]
    src = tmp_path / "src"
    (src / ".git").mkdir(parents=True)
    (src / "A.Java").write_text("int a;")
    (src / "B.java").write_bytes(b"\xff\xfe")
    (src / "c.txt").write_text("x")
    (src / ".git" / "D.java").write_text("x")
    files = {r.path.rsplit("/", 1)[1]: r.text for r in tb.scan_sources(spark, str(src), "p", "c").collect()}
    assert files == {"A.Java": "int a;", "B.java": None}
    lines = [f"line {i} " + "x" * (i % 50) for i in range(1, 4001)]
    (tmp_path / "run_INFO.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = tb.scan_log(spark, str(tmp_path / "*_INFO.log")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in sorted(got, key=lambda r: r.line_no)] == lines
    assert sorted(r.line_no for r in got) == list(range(1, 4001))


def test_write_replaces_only_its_partitions(spark, tmp_path):
    out = str(tmp_path / "rows")
    df = spark.createDataFrame([("p", 1, "a"), ("q", 1, "b")], "project string, level int, x string")
    tb.write_rows(df, out)
    tb.write_rows(df.filter("project = 'p'").withColumn("x", F.lit("new")), out)
    assert {(r.project, r.x) for r in spark.read.parquet(out).collect()} == {("p", "new"), ("q", "b")}


def test_ledger_against_a_plain_file(spark):
    """Steps are taken in turn: a line is added, or all lines that contain the text go."""
    rnd = random.Random(3)
    urls = ["u", "https://x.org/a", "https://x.org/ab", "https://x.org/a, set1", ""]
    rows, ledger = [], []
    for pos in range(300):
        url, dataset, status = rnd.choice(urls), rnd.choice(["set1", "set10", "t", ""]), rnd.choice(["started", "started", "finished", "failed"])
        reason, error = rnd.choice(["gone", "set1", "t"]), rnd.choice(["E: x", "https://x.org/a, set1"])
        rows.append((url, dataset, status, reason, error, pos))
        if status != "finished":
            ledger.append((url, f"{url}, {dataset}" if status == "started" else f"{url}, {reason}, {error}"))
        if status != "started":
            ledger = [(u, line) for u, line in ledger if f"{url}, {dataset}" not in line]
    runs = spark.createDataFrame(rows, "git_url string, dataset string, status string, reason string, exception string, pos long")
    assert sorted(tuple(r) for r in ql.failed_projects(runs).collect()) == sorted(ledger) and ledger
    assert ql.failed_projects(runs.limit(0)).collect() == []


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_ledger_lines_are_not_broadcast(spark):
    """Small tables become many pieces: none may pass through the driver, nor lie in one task."""
    rows = [(f"https://x.org/s{i}", f"set{i}", s, "r", "e", 2 * i + (s == "failed")) for i in range(50) for s in ("started", "failed")]
    runs = spark.createDataFrame(rows, "git_url string, dataset string, status string, reason string, exception string, pos long")
    assert "Broadcast" not in plan(ql.failed_projects(runs))
    texts = spark.createDataFrame([(f"a common start {i}",) for i in range(200)], "line string")
    found = ql.containing(texts, texts.selectExpr("line as needle").filter("line like '%1'"))
    assert {(r.needle, r.line) for r in found.collect()} == {
        (f"a common start {i}", f"a common start {j}") for i in range(1, 200, 10) for j in range(200) if str(j).startswith(str(i))
    }


def test_wide_windows_of_files_stay_spread(spark):
    """Rows of the log repeat their texts: joined by their bytes in the shuffle, most files would be in one task."""
    rows = [("p", f"F{i}.java", None, i + 1, 4, 0, f"c{i}", 0, 0, "a", 1, 0, 0, 0) for i in range(200)]
    log = spark.createDataFrame(rows, EVENT_COLUMNS).withColumn("lineage", F.col("path"))
    history = closed_form_history(log, (2, 5), authors=True)
    assert history.rdd.getNumPartitions() == 8
    assert author_stats(staged(history)).rdd.getNumPartitions() == 8


def test_metric_rows_are_found_by_key_first(spark):
    """Rows of files asked for come as often as they stand in the metrics, however often they are asked for."""
    ck = spark.createDataFrame([("p", "c1", "A", 1), ("p", "c1", "A", 1), ("p", "c1", "B", 2), ("p", None, "A", 3)], "project string, commit_id string, file string, v int")
    files = spark.createDataFrame([("p", "c1", "A"), ("p", "c1", "A"), ("p", None, "A")], "project string, commit_id string, file string")
    assert [r.v for r in ins.metrics_asked_for(ck, files).collect()] == [1, 1]


def test_a_failing_label_ends_its_commit(spark):
    ok = [("A.java", "x.A"), ("B.java", "x.B")]
    rows = [label_row(0, "EXTRACT_INTERFACE", ok, ok), label_row(1, "EXTRACT_INTERFACE", [("A.java", "x.A"), ("B.java", None)], ok), label_row(2, "EXTRACT_INTERFACE", ok, ok)]
    labels = spark.createDataFrame(rows, schemas.REFACTORINGS)
    failures = lb.failing_labels(labels)
    assert [(r.ref_pos, r.class_pos, r.reason) for r in failures.collect()] == [(1, 1, "no class name")]
    left = lb.until_failure(lb.refactored_classes(labels), failures)
    assert sorted((r.ref_pos, r.class_pos) for r in left.collect()) == [(0, 0), (0, 1), (1, 0)]
