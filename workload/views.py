"""Commit-shaped tables over the supplied test tables.

Every table is a projection of ``events`` (one event is one commit that touches
one file of its user), of ``lineitem`` joined with ``orders`` (one order is one
commit over several files), or of ``documents``, ``pages`` and other tables.
``event_id`` follows the event time, so it serves as the position in the walk.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehist.plans.ordered import running
from codehist.schemas import CLASS_METRICS, COHESION, LABEL_TYPES, METHOD_METRICS
from codehist.session import staged

TYPES = [t for types in LABEL_TYPES.values() for t in types]

# one event: row-local columns, the same text in Spark and DuckDB
EVENT_SQL = """
  event_id, user_id, event_type, ts, value,
  concat('p', user_id % 5) as project, concat('c', event_id) as commit_id,
  event_id + 1 as walk_pos,
  event_type = 'view' and event_id % 7 = 0 as is_rename,
  event_type = 'signup' and event_id % 3 = 0 as is_label,
  case when event_id % 499 = 0 then 0
       when event_id % 23 = 0 and not (event_type = 'view' and event_id % 7 = 0) then 2
       else 1 end as n_parents,
  concat('a', event_id % 13) as author,
  concat(event_type, ' seen by user ', user_id) as message,
  concat('src/', case when user_id % 4 = 0 then 'test' else 'main' end, '/F', user_id, 'v') as stem,
  cast(floor(value) as bigint) as lines_added,
  cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as lines_deleted
"""


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


#: Numbered events by folder, for the query that runs in this thread.
_prepared: ContextVar[dict[str, DataFrame]] = ContextVar("prepared")


@contextmanager
def prepared(spark: SparkSession, sf: str):
    """Write the numbered events once for a query that needs them several times."""
    token = _prepared.set({**_prepared.get({}), sf: staged(fx(spark, sf))})
    try:
        yield
    finally:
        _prepared.reset(token)


def fx(spark: SparkSession, sf: str) -> DataFrame:
    """Events with ``ver``, the number of renames of their file so far."""
    if sf in _prepared.get({}):
        return _prepared.get({})[sf]
    # numbered as they are read: the texts that are made of them come after the shuffle
    rows = read(spark, sf, "events").withColumn("_pos", F.col("event_id") + 1)
    is_rename = "cast(event_type = 'view' and event_id % 7 = 0 as int)"
    rows = running(rows, ["user_id"], "_pos", ["_pos"], {"ver": F.expr(is_rename)})
    return rows.selectExpr(*split(EVENT_SQL), "ver")


def split(sql: str) -> list[str]:
    """Select list to expressions: commas outside brackets separate them."""
    out, depth, cur = [], 0, ""
    for ch in sql:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def commits(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").selectExpr(*split(EVENT_SQL))
    return rows.selectExpr(
        "project",
        "commit_id",
        "transform(array_repeat(0, n_parents), (x, i) -> concat(if(i = 0, 'b', 'm'), event_id)) as parents",
        "author",
        "ts as author_ts",
        "'UTC' as author_tz",
        "message",
        "walk_pos",
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """File changes with their line counts; ``fx`` numbers the file names."""
    return fx(spark, sf).selectExpr(
        "project",
        "commit_id",
        "0 as entry_pos",
        "case when is_rename then 'RENAME' else 'MODIFY' end as change_type",
        "concat(stem, ver - cast(is_rename as int), '.java') as old_path",
        "concat(stem, ver, '.java') as new_path",
        "lines_added",
        "lines_deleted",
    )


def file_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes(spark, sf).drop("lines_added", "lines_deleted")


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """Two hunks per change, together its line counts."""
    rows = read(spark, sf, "events").selectExpr(*split(EVENT_SQL))
    return rows.selectExpr(
        "project", "commit_id", "0 as entry_pos",
        "explode(array(struct(0 as edit_pos, cast(lines_deleted div 2 as int) as len_a, "
        "cast(lines_added as int) as len_b), struct(1 as edit_pos, "
        "cast(lines_deleted - lines_deleted div 2 as int) as len_a, 0 as len_b))) as e",
    ).select("project", "commit_id", "entry_pos", "e.*")


def label_type(no: str) -> str:
    return f"coalesce(get(array({', '.join(repr(t) for t in TYPES)}), cast({no} as int)), 'UNKNOWN_TYPE')"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """One or two labels on the file of a commit; some types are not studied.

    Every other rename is also seen by the detector, as a class rename.
    """
    rows = fx(spark, sf).filter("is_label or (is_rename and event_id % 2 = 0)")
    rows = rows.selectExpr(
        "*",
        "explode(sequence(0, case when is_label then cast(event_id % 2 as int) else 0 end)) as ref_pos",
    )
    rows = rows.withColumn("type_no", F.expr("(event_id + 7 * ref_pos) % 45"))
    return rows.selectExpr(
        "project",
        "commit_id",
        "ref_pos",
        f"case when is_rename then 'RENAME_CLASS' else {label_type('type_no')} end as type",
        "concat('Label ', type_no) as display_name",
        "concat('  Label ', type_no, ' on user ', user_id, ' ') as summary",
        # two classes before, so that types that take all classes differ from the rest
        "array(struct(concat(stem, ver - cast(is_rename as int), '.java') as file, "
        "concat('pkg.', case when event_id % 11 = 0 then 'f' else 'F' end, user_id) as class), "
        "struct(concat(stem, ver - cast(is_rename as int), '.java') as file, "
        "concat('pkg.F', user_id, '.Inner') as class)) as before",
        "array(struct(concat(stem, ver, '.java') as file, "
        "concat('pkg.F', user_id, case when is_rename then 'R' else '' end) as class)) as after",
        "concat('M', event_id % 3, '/2[T', user_id % 9, ',Map<String,List<X>>]') as method_full_name",
        "concat('e', event_id % 5) as element_name",
    )


def _metric_sql(names: list[str], seed: str) -> str:
    out = []
    for i, m in enumerate(names):
        if m in COHESION:
            out.append(f"cast((({seed}) * {i + 3}) % 17 as float) / cast(16 as float) as {m}")
        else:
            out.append(f"cast((({seed}) * {i + 3} + {i}) % 97 as int) as {m}")
    return ", ".join(out)


def ck_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows of the file of every event: as committed, and at the parent.

    The parent of ``c<id>`` is ``b<id>``, where a renamed file has its old path.
    """
    method = (
        "struct(concat('m', i, '/2[a.b.T', user_id % 9, ',java.util.Map<x.Y,z.List<W', i, '>>]') as name, "
        f"10 * i as start_line, {_metric_sql(METHOD_METRICS, 'event_id + i')}, "
        "map('e0', i, 'e1', i + 1, 'v', i + 2) as variables, "
        "map('e0', i, 'e3', i + 3, 'g', 1) as fields)"
    )
    # the four rows of an event have the same methods
    rows = fx(spark, sf).selectExpr("*", f"transform(filter(array(0, 1, 2), x -> x < event_id % 4), i -> {method}) as methods")
    rows = rows.selectExpr(
        "*",
        "explode(array(struct(commit_id as at, concat(stem, ver, '.java') as file), "
        "struct(concat('b', event_id) as at, concat(stem, ver - cast(is_rename as int), '.java') as file))) as s",
    )
    rows = rows.selectExpr("*", "explode(array('', '$Inner')) as inner_name")
    seed = "event_id + length(inner_name)"
    return rows.selectExpr(
        "project",
        "s.at as commit_id",
        "s.file as file",
        "concat('pkg.F', user_id, inner_name) as class",
        "case when inner_name = '' then 'class' else 'innerclass' end as type",
        *split(_metric_sql(CLASS_METRICS, seed)),
        "methods",
    )


def wide_commits(spark: SparkSession, sf: str) -> DataFrame:
    """One order is one commit in each of 20 projects it touches."""
    return read(spark, sf, "orders").selectExpr(
        "o_orderkey as walk_pos",
        "concat('c', o_orderkey) as commit_id",
        "concat('a', o_custkey % 40) as author",
        "o_orderpriority as message",
    )


def wide_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event log of the order history: one file per part, labels on returns."""
    from codehist.functions.names import is_bug_fix

    # dealt by order: one shuffle of the lines serves the sums as well as the join
    lines = (
        read(spark, sf, "lineitem")
        .selectExpr(
            "l_partkey", "l_orderkey", "l_quantity", "l_linenumber",
            "case when l_returnflag = 'R' and l_linenumber = 1 then 1 else 0 end as is_label",
        )
        .repartition("l_orderkey")
        .groupBy("l_partkey", "l_orderkey")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("added"),
            F.sum("l_linenumber").cast("bigint").alias("deleted"),
            F.max("is_label").alias("is_label"),
        )
    )
    at = wide_commits(spark, sf)
    rows = lines.join(at, lines.l_orderkey == at.walk_pos).withColumn(
        "is_bug", is_bug_fix(F.col("message")).cast("int")
    )
    return rows.selectExpr(
        "concat('p', l_partkey % 20) as project",
        "concat('src/P', l_partkey, '.java') as path",
        "cast(null as string) as old_path",
        "walk_pos",
        "explode(case when is_label = 1 then array(1, 4) else array(4) end) as phase",
        "0L as pos",
        "commit_id",
        "cast(is_label as bigint) as _label", "author as _author", "added as _added",
        "deleted as _deleted", "is_bug as _bug",
    ).selectExpr(
        "project", "path", "old_path", "walk_pos", "phase", "pos", "commit_id",
        "case when phase = 1 then _label else 0L end as resets",
        "0 as clears",
        "case when phase = 4 then _author end as author",
        "case when phase = 4 then _added else 0L end as added",
        "case when phase = 4 then _deleted else 0L end as deleted",
        "case when phase = 4 then _bug else 0 end as is_bug",
        "0 as ends",
    )


def deletion_changes(spark: SparkSession, sf: str) -> DataFrame:
    """One file per user; some commits delete it, the next one creates it anew."""
    return read(spark, sf, "events").selectExpr(
        "concat('p', user_id % 5) as project", "concat('c', event_id) as commit_id", "0 as entry_pos",
        "case when event_id % 17 = 0 then 'DELETE' else 'MODIFY' end as change_type",
        "concat('src/F', user_id, '.java') as old_path",
        "case when event_id % 17 = 0 then '/dev/null' else concat('src/F', user_id, '.java') end as new_path",
        "cast(floor(value) as bigint) as lines_added", "0L as lines_deleted",
    )


SOURCES_SQL = """
  concat('p', doc_id % 5) as project, concat('c', doc_id) as commit_id,
  concat('/w/src/', source, '/D', doc_id, case when doc_id % 5 = 0 then 'Test' else '' end,
         case when doc_id % 7 = 0 then '.md' else '.Java' end) as path,
  case when doc_id % 97 = 0 then null
       when doc_id % 3 = 0 then concat('/* head */ ', text)
       when doc_id % 3 = 1 then concat('/* open', chr(10), text, chr(10), '*/', chr(10), 'int x;')
       else concat('// c', chr(10), text) end as text
"""


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").selectExpr(*split(SOURCES_SQL))


# twenty log lines per page: the end of a run, then other work
INFO_SQL = """
  concat('info', page_id % 3) as file, page_id // 3 * 20 + k + 1 as line_no,
  case k
    when 0 then concat('w1 2024-01-01 00:00:00 INFO Runner:371 Finished mining ', url, ' in ', page_id % 50, '.', page_id % 7, ' minutes')
    when 1 then concat('Found ', page_id % 90, ' refactoring- and ', page_id % 70, ' stable instances in the project.')
    when 2 then concat('  Found ', page_id % 40, ' stable instances in the project with threshold: ', 15 + 5 * (page_id % 8))
    when 3 then concat('  Found ', page_id % 30, ' stable instances in the project with threshold: ', 60 + 10 * (page_id % 5))
    when 4 then concat('Project{commits=', page_id, ', numberOfProductionFiles=', page_id % 11, ', numberOfTestFiles=', page_id % 5, ', javaLoc=', page_id * 10, '}')
    else concat('w2 2024-01-01 00:00:00 INFO Walker:12 step ', k, ' commits=1') end as line
"""
# one line per event: the time of a commit, or an exception with its site
DEBUG_SQL = """
  concat('w', user_id % 3) as file, event_id as line_no,
  case when event_type <> 'error' then concat('w', user_id % 3, ' 2024-01-01 00:00:00 DEBUG Walker:235 Processing commit c', event_id, ' took ', cast(floor(value * 10) as bigint), ' milliseconds.')
    when event_id % 3 = 0 then concat('w', user_id % 3, ' 2024-01-01 00:00:00 ERROR Walker:', event_id % 7, ' failed at c', event_id)
    when event_id % 3 = 1 then concat('java.lang.', case when event_id % 2 = 0 then 'IllegalState' else 'Runtime' end, 'Exception: at c', event_id)
    else concat('java.lang.OutOfMemoryError: heap of c', event_id) end as line
"""


def info_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "pages").selectExpr("*", "explode(sequence(0, 19)) as k")
    return rows.selectExpr(*split(INFO_SQL.replace("//", "div")))


def debug_log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr(*split(DEBUG_SQL))
