import pytest

from codehist.sources.stored import StoredTable, delete_projects, delete_unfinished, only_pointed_to_by

KIND = "project string, id long, n int"


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame(rows, kind).repartition(3)


def stored(spark, path, rows, kind=KIND, keys=("project", "id")):
    table = StoredTable(spark, str(path), frame(spark, [], kind).schema, keys)
    table.overwrite(frame(spark, rows, kind))
    return table


def rows_of(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def files_of(table, project):
    return {r.file for r in table.manifest().collect() if r.project == project}


@pytest.fixture
def table(spark, tmp_path):
    return stored(spark, tmp_path / "t", [(p, i, i) for p in ("a", "b", "7") for i in range(6)] + [(None, 1, 1), ("a", None, 5)])


def test_merge_updates_adds_and_keeps(spark, table):
    before = {p: files_of(table, p) for p in ("a", "b", "7", None)}
    table.merge(frame(spark, [("a", 2, 20), ("a", 99, 99), ("new", 1, 1), (None, 1, 10), ("a", None, 50)]))
    want = [(p, i, 20 if (p, i) == ("a", 2) else i) for p in ("a", "b", "7") for i in range(6)]
    want += [(None, 1, 10), ("a", None, 50), ("a", 99, 99), ("new", 1, 1)]
    assert rows_of(table) == sorted(want, key=repr)
    assert files_of(table, "b") == before["b"] and files_of(table, "7") == before["7"]
    assert not files_of(table, "a") & before["a"] and not files_of(table, None) & before[None]
    table.merge(frame(spark, []))
    assert rows_of(table) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="two updates"):
        table.merge(frame(spark, [("a", 1, 1), ("a", 1, 2)]))


def test_a_killed_run_changes_nothing(spark, table, monkeypatch):
    before, at = rows_of(table), table.version()

    def killed(manifest):
        raise RuntimeError("killed")

    monkeypatch.setattr(table, "_publish", killed)
    with pytest.raises(RuntimeError):
        table.merge(frame(spark, [("a", 2, 20)]))
    monkeypatch.undo()
    # a manifest that was begun and not finished
    (frame(spark, [("nowhere", "a")], "file string, project string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
     .parquet(f"{table.folder}/manifests/v{at + 1:08d}"))
    assert table.version() == at and rows_of(table) == before
    table.merge(frame(spark, [("a", 2, 20)]))
    assert table.version() == at + 1 and len(rows_of(table)) == len(before)


def test_deletes(spark, table):
    before = files_of(table, "b")
    table.delete(frame(spark, [("a", 1), ("a", None), ("zz", 4)], "project string, id long"))
    assert ("a", 1, 1) not in rows_of(table) and ("a", None, 5) not in rows_of(table) and len(rows_of(table)) == 18
    table.delete(frame(spark, [(3,)], "id long"), ["id"])
    assert all(r[1] != 3 for r in rows_of(table)) and len(rows_of(table)) == 15
    left = files_of(table, "7")
    assert files_of(table, "b") != before
    table.drop_projects(frame(spark, [("a",), (None,), ("b",)], "project string"))
    assert {r[0] for r in rows_of(table)} == {"7"} and files_of(table, "7") == left
    table.vacuum()
    assert {r[0] for r in rows_of(table)} == {"7"}
    table.drop_projects(frame(spark, [("7",)], "project string"))
    assert rows_of(table) == [] and table.version() > 0
    table.merge(frame(spark, [("x", 1, 1)]))
    assert rows_of(table) == [("x", 1, 1)]


def test_projects_go_with_what_only_they_point_to(spark, tmp_path):
    fact = "project string, id long, class_metrics long"
    labels = stored(spark, tmp_path / "labels", [("a", 1, 10), ("a", 2, 11), ("b", 3, 11), ("b", 4, 12), ("c", 5, None), ("c", 6, 13)], fact)
    stable = stored(spark, tmp_path / "stable", [("a", 7, 14), ("c", 8, 15), ("b", 9, 15)], fact)
    metric = "project string, id long, loc int"
    classes = stored(spark, tmp_path / "classes", [("a", 10, 1), ("a", 11, 1), ("b", 12, 1), ("c", 13, 1), ("a", 14, 1), ("b", 15, 1), ("b", 16, 1)], metric, ["id"])
    projects = stored(spark, tmp_path / "projects", [("a", None), ("b", "2020"), ("c", None), ("d", None)], "project string, finishedDate string", ["project"])
    untouched = files_of(labels, "b"), files_of(classes, "b")
    gone = projects.read().where("finishedDate is null").select("project")
    ids = only_pointed_to_by([labels.read(), stable.read()], "class_metrics", gone)
    assert {r.id for r in ids.collect()} == {10, 13, 14}
    delete_unfinished([labels, stable], {"class_metrics": classes}, projects)
    assert [r[1] for r in rows_of(labels)] == [3, 4] and [r[1] for r in rows_of(stable)] == [9]
    # 11 and 15 are still pointed to; 16 never was
    assert sorted(r[1] for r in rows_of(classes)) == [11, 12, 15, 16]
    assert rows_of(projects) == [("b", "2020")]
    assert (files_of(labels, "b"), files_of(classes, "b")) == untouched
    delete_projects([labels, stable], {"class_metrics": classes}, None, frame(spark, [("b",)], "project string"))
    assert rows_of(labels) == rows_of(stable) == [] and [r[1] for r in rows_of(classes)] == [16]
