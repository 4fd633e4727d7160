"""Following files through renames.

The life of a path is cut into incarnations: one ends when the path is renamed
away (or deleted), a new one starts when a file is renamed onto it. A rename
links an incarnation of the old path to one of the new path, so every
incarnation has at most one predecessor and the origin of a file is found by
pointer jumping over the rename edges alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.operators.events import ORDER
from codehist.plans.ordered import BLOCK, running
from codehist.session import staged


def incarnation(path: Column, number: Column) -> Column:
    return F.concat(path, F.lit("#"), number.cast("string"))


def rename_marks(events: DataFrame) -> DataFrame:
    """Two marks per rename: the old path is left, the new path is entered."""
    at = ["project", *ORDER]
    moves = events.filter(F.col("old_path").isNotNull())
    left = moves.select(*at, F.col("old_path").alias("path"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    entered = moves.select(*at, "path", F.lit(0).alias("out"), F.lit(1).alias("into"))
    ended = events.filter("ends = 1").select(*at, "path", F.lit(1).alias("out"), F.lit(0).alias("into"))
    return left.unionByName(entered).unionByName(ended)


def rename_edges(marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(project, node, parent): one row per rename, both ends as incarnations."""
    numbered = running(
        marks,
        ["project", "path"],
        "walk_pos",
        ORDER,
        {"ins": F.col("into"), "outs": F.col("out")},
        block,
    )
    at = ["project", *ORDER]
    name = incarnation(F.col("path"), F.col("ins") + F.col("outs") - F.col("out"))
    ends = numbered.select(*at, "out", name.alias("node"))
    return (
        ends.groupBy(*at)
        .agg(
            F.max(F.when(F.col("out") == 0, F.col("node"))).alias("node"),
            F.max(F.when(F.col("out") == 1, F.col("node"))).alias("parent"),
        )
        .filter("node is not null")
        .select("project", "node", "parent")
    )


def _jump(hops: DataFrame) -> DataFrame:
    """Replace every root by its own root, where it has one."""
    up = hops.select("project", F.col("node").alias("root"), F.col("root").alias("_up"))
    return hops.drop("done").join(up, ["project", "root"], "left").select(
        "project", "node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNull().alias("done")
    )


def rename_roots(edges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """(project, node, root): pointer jumping, two jumps per written round.

    A round reaches four times as far as the one before. Node and parent are
    unique within a project, so no join key is skewed.
    """
    hops = staged(edges.withColumnRenamed("parent", "root").withColumn("done", F.lit(False)))
    for _ in range(max_rounds):
        if hops.filter(~F.col("done")).isEmpty():
            return hops.select("project", "node", "root")
        hops = staged(_jump(_jump(hops)))
    raise RuntimeError(f"rename chains not resolved after {max_rounds} rounds")


def rename_lineage(events: DataFrame, block: int = BLOCK, max_rounds: int = 32) -> DataFrame:
    """Add ``lineage``, the first incarnation of the file, to every event.

    Files never renamed or deleted keep their own path and take no part in the
    joins. A deletion is the last event of its lineage.
    """
    marks = rename_marks(events)
    edges = rename_edges(marks, block)
    roots = rename_roots(edges, max_rounds)
    renamed_paths = marks.select("project", "path").distinct()
    plain = events.join(renamed_paths, ["project", "path"], "left_anti").withColumn(
        "lineage", incarnation(F.col("path"), F.lit(0))
    )
    touched = events.join(renamed_paths, ["project", "path"], "left_semi")
    # the old end of a rename counts as a mark of its own, the new end is the event itself
    is_in = F.col("old_path").isNotNull()
    left = events.filter(is_in).select("project", F.col("old_path").alias("path"), *ORDER, F.lit(True).alias("_gone"))
    both = touched.unionByName(left, allowMissingColumns=True)
    numbered = running(
        both,
        ["project", "path"],
        "walk_pos",
        ORDER,
        {"_no": (is_in | F.coalesce("_gone", F.lit(False)) | (F.col("ends") == 1)).cast("int")},
        block,
    ).filter(F.col("_gone").isNull())
    named = numbered.withColumn("node", incarnation(F.col("path"), F.col("_no") - F.col("ends")))
    resolved = named.join(roots, ["project", "node"], "left").withColumn(
        "lineage", F.coalesce("root", "node")
    )
    columns = [*events.columns, "lineage"]
    return plain.select(*columns).unionByName(resolved.select(*columns))
