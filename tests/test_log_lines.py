"""Files of a log that grow with the table, and places in them that are counted in blocks."""

import __spark_entry__ as entry
from pathlib import Path

from codehist.session import shared_dir


def test_no_file_holds_a_fixed_share_of_the_log(spark, tmp_path):
    n = 4000
    rows = spark.range(n).selectExpr("id * 70000 as o_orderkey", "cast(id as double) as o_totalprice", "if(id % 3 = 0, null, 'F') as o_orderstatus")
    rows.filter("o_orderstatus is not null").write.parquet(str(tmp_path / "orders.parquet"))
    before = set(Path(shared_dir(spark)).glob("log-*"))
    found = entry.queries()["log_lines"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert sorted(r.key for r in got) == [k * 70000 for k in range(n) if k % 3] and {r.off for r in got} == {0}
    (folder,) = set(Path(shared_dir(spark)).glob("log-*")) - before
    lines = [len(p.read_text().splitlines()) for p in folder.glob("part-*")]
    assert max(lines) < len(got) / 4
    # a window of rows of a file lies within a block of it
    assert all("_blk" in line for line in plan.splitlines() if "Window [" in line and "_open" in line) and "_blk" in plan
