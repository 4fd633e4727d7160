from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codehist.sources import tables as tb
from codehist.sources.files import read_files, write_files


def texts(spark, rows):
    return spark.createDataFrame(rows, "path string, text string").repartition(4)


def test_files_by_name(spark, tmp_path):
    folder = str(tmp_path / "archive")
    rows = [(f"i{k}/{side}/Ä b{k % 3}.java", f"{side} {k}\nü\n") for k in range(40) for side in ("before", "after")]
    write_files(texts(spark, [*rows, ("i0/none", None), (None, "x"), ("empty", "")]), folder)
    assert {tuple(r) for r in read_files(spark, folder).collect()} == set(rows)
    assert [p.read_bytes() for p in Path(folder).rglob("empty")] == [b""]  # there, though Spark reads no files without bytes
    on_disk = [p for p in Path(folder).rglob("*.java")]
    assert len(on_disk) == len(rows) and not list(Path(folder).glob("_attempts*"))
    write_files(texts(spark, [("more/x", "1")]), folder, replace=False)
    assert read_files(spark, folder).count() == len(rows) + 1
    write_files(texts(spark, [("only/x", "2")]), folder)
    assert [tuple(r) for r in read_files(spark, folder).collect()] == [("only/x", "2")]


def test_the_driver_lists_folders_only(spark, tmp_path):
    """A folder of many files is read by as many tasks as wrote it, and none of its files is in the plan."""
    folder = str(tmp_path / "archive")
    rows = [(f"i{k}/after/_{k}=x.java" if k % 2 else f"i{k}/after/{k}.java", f"text {k}") for k in range(200)]
    write_files(texts(spark, [*rows, ("i0/after/.hidden", "x"), ("_i1/after/y", "x")]), folder)
    files = read_files(spark, folder)
    # rows are dealt by number, however few bytes they have in a shuffle
    assert files.rdd.getNumPartitions() == len(list(Path(folder).glob("part-*"))) == 8
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "FileIndex" not in plan
    assert {tuple(r) for r in files.collect()} == set(rows)
    write_files(texts(spark, []), folder)
    assert read_files(spark, folder).collect() == []


@pytest.mark.parametrize("bad", ["../x", "/x", "a//b", "same"])
def test_a_failed_run_leaves_nothing(spark, tmp_path, bad):
    folder = str(tmp_path / "archive")
    write_files(texts(spark, [("same", "old")]), folder)
    with pytest.raises(Exception, match="no file of its own"):
        write_files(texts(spark, [*[(f"x{k}", "new") for k in range(20)], (bad, "1"), (bad, "2")]), folder)
    assert [tuple(r) for r in read_files(spark, folder).collect()] == [("same", "old")]
    assert not list(Path(folder).glob("_attempts*"))


def test_lines_of_files_in_several_splits(spark, tmp_path):
    for k, n in enumerate((0, 1, 700, 3000)):
        (tmp_path / f"{k}.log").write_text("".join(f"{k} line {i} {'x' * (i % 50)}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = tb.scan_log(spark, str(tmp_path / "*.log"))
        assert lines.rdd.getNumPartitions() > 4
        got = lines.collect()
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3701
    for r in got:
        k, _, i, *_ = r.line.split(" ")
        assert r.file.endswith(f"/{k}.log") and r.line_no == int(i)
    # lines stay where they are read: nothing but the offsets is exchanged
    assert "Exchange hashpartitioning" not in plan


def test_a_lookup_reads_few_rows(spark, tmp_path):
    state = spark.range(60_000).select(F.concat(F.lit("p"), F.col("id") % 2).alias("project"), F.concat(F.lit("src/"), F.sha1(F.col("id").cast("string"))).alias("path"), "id")
    tb.write_state(state, str(tmp_path / "s"))
    wanted = [r.path for r in state.filter("id in (4, 40000, 7)").collect()]
    found = tb.find_files(spark, str(tmp_path / "s"), "p0", [*wanted, "src/none"])
    assert sorted(r.id for r in found.collect()) == [4, 40000]
    assert tb.find_files(spark, str(tmp_path / "s"), "p0", []).collect() == []
    plan = found._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert 2 <= read <= 3 * 4096
