"""Every query with its Spark plan and, where SQL can say it, its DuckDB text."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codehist.functions import names as nm
from codehist.functions.loc import source_loc as count_loc
from codehist.operators import commits as cm
from codehist.operators import instances as ins
from codehist.operators import inventory as inv
from codehist.operators import labels as lb
from codehist.operators import process as pr
from codehist.operators import quality as ql
from codehist.operators import reports as rp
from codehist.operators import stability as stb
from codehist.operators import walk
from codehist.operators.events import CHANGE, ORDER, change_events, event_log
from codehist.operators.exact import with_exact_cycles
from codehist.operators.history import closed_form_history, file_history
from codehist.operators.lineage import rename_lineage
from codehist.plans.mining import history_events, mine
from codehist.plans.ordered import BLOCK, running
from codehist.schemas import CLASS_METRICS, LEGACY_TYPES, METHOD_METRICS
from codehist.session import shared_dir, shuffles_removed, staged
from codehist.sources import stored
from codehist.sources.files import read_files, write_files
from codehist.sources.stored import StoredTable
from codehist.sources.tables import find_files as look_up
from codehist.sources.tables import project_lines, scan_log, write_rows, write_state
from codehist.streaming.tracker import results, stream_file_state
from workload import duck as dk
from workload import views as vw

Query = Callable[[SparkSession, str], DataFrame]
SPARK: dict[str, Query] = {}
DUCK: dict[str, str] = {}

CUTS = (2, 5)


def query(sql: str | None = None, name: str | None = None, prepare: bool = False):
    """Register a query; ``prepare`` writes its numbered events once, up front."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__

        @wraps(fn)
        def prepared(spark, sf):
            with vw.prepared(spark, sf):
                return fn(spark, sf)

        SPARK[key] = prepared if prepare else fn
        if sql is not None:
            DUCK[key] = sql
        return fn

    return register


# --- tables shared by the queries ---------------------------------------------


def _processed(spark, sf):
    return cm.without_merges(vw.commits(spark, sf))


def _changes(spark, sf):
    return vw.changes(spark, sf)


def _targets(spark, sf):
    return lb.label_targets(_processed(spark, sf), vw.labels(spark, sf), _changes(spark, sf))


def _events(spark, sf, block=BLOCK):
    """Event log with lineage; every target counts as a reset."""
    resets = _targets(spark, sf).select(*lb.COMMIT, "path")
    log = history_events(_processed(spark, sf), _changes(spark, sf), vw.labels(spark, sf), resets)
    return staged(rename_lineage(staged(log), block))


def _history(spark, sf, authors=False, block=BLOCK):
    return file_history(_events(spark, sf, block), CUTS, authors, block)


def _mined(spark, sf, block=BLOCK):
    return mine(vw.commits(spark, sf), _changes(spark, sf), vw.labels(spark, sf), vw.ck_classes(spark, sf), CUTS, block)


#: Block of the queries whose names end in _blocks: files and projects then lie in many blocks, even in a small table.
SMALL = 512


def _big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- commits --------------------------------------------------------------------

COMMITS_CTE = "com as (select *, row_number() over (partition by project order by walk_pos) as nr from fx0 where n_parents <= 1)"


@query(
    "select string_split(line, ',')[3] as dataset, string_split(line, ',')[2] as git_url from "
    "(select concat(page_id, ',', url, ',', 'set', page_id % 3, ',x') as line from pages)"
)
def scan_projects(spark, sf):
    lines = vw.read(spark, sf, "pages").selectExpr("concat(page_id, ',', url, ',', 'set', page_id % 3, ',x') as value")
    return project_lines(lines)


REPLAY_SQL = dk.with_fx("select project, commit_id, walk_pos, nr as commit_number from com", COMMITS_CTE)


@query(REPLAY_SQL)
def commit_replay(spark, sf):
    return cm.commit_replay(vw.commits(spark, sf)).select("project", "commit_id", "walk_pos", "commit_number")


@query(REPLAY_SQL)
def commit_replay_blocks(spark, sf):
    return cm.commit_replay(vw.commits(spark, sf), block=SMALL).select("project", "commit_id", "walk_pos", "commit_number")


@query(
    dk.with_fx(
        "select fx0.project, commit_id, row_number() over (partition by fx0.project order by walk_pos) as commit_number "
        "from fx0 join b on b.project = fx0.project where n_parents <= 1 and walk_pos between lo and hi",
        "b as (select project, min(walk_pos) as lo, max(walk_pos) as hi from fx0 where n_parents = 2 group by project)",
    )
)
def commit_range(spark, sf):
    """From the first merge of a project to its last one; both bounds are dropped as merges."""
    commits = vw.commits(spark, sf)
    bounds = commits.filter(F.size("parents") == 2).groupBy("project").agg(
        F.min_by("commit_id", "walk_pos").alias("first"), F.max_by("commit_id", "walk_pos").alias("last")
    )
    return cm.commit_replay(commits, bounds).select("project", "commit_id", "commit_number")


@query(dk.with_fx("select project, count(*) as commits, arg_max(commit_id, walk_pos) as last_commit_hash from fx0 group by project"))
def commit_totals(spark, sf):
    return cm.commit_totals(vw.commits(spark, sf))


def _projects(spark, sf):
    """One project per fifth page, by the smallest URL."""
    return (
        vw.read(spark, sf, "pages")
        .groupBy(F.expr("concat('p', page_id % 5)").alias("project"))
        .agg(F.min("url").alias("git_url"))
    )


PROJECTS_CTE = "prj as (select concat('p', page_id % 5) as project, min(url) as git_url from pages group by 1)"
URL_SQL = (
    "case when not (starts_with(git_url, 'https') or starts_with(git_url, 'git')) then concat('@local/', git_url, '/', commit_id) "
    "else concat(replace(git_url, '.git', ''), '/commit/', commit_id) end"
)


@query(
    dk.with_fx(
        f"select com.project, commit_id as \"commitId\", message as \"commitMessage\", {URL_SQL} as \"commitUrl\", "
        "ts as \"commitDate\", nr as \"commitNumber\", "
        "case when n_parents = 0 then 'Null' else concat('b', event_id) end as \"parentCommitId\" "
        "from com join prj on prj.project = com.project",
        COMMITS_CTE, PROJECTS_CTE,
    )
)
def commit_meta(spark, sf):
    commits = cm.commit_replay(vw.commits(spark, sf))
    return cm.commit_meta(commits, _projects(spark, sf)).drop("commitTimeZone")


@query(dk.with_fx("select project, commit_id, 0 as entry_pos, new_path, lines_added, lines_deleted from chg"))
def churn(spark, sf):
    rows = cm.churn(vw.file_changes(spark, sf), vw.edits(spark, sf))
    return rows.select("project", "commit_id", "entry_pos", "new_path", "lines_added", "lines_deleted")


# --- tracker --------------------------------------------------------------------

REP = [dk.events_cte("tgt"), dk.replay_cte(CUTS)]
STATE_SQL = (
    "select project, path, commit_id, n, cast(s_added as bigint) as lines_added, cast(s_deleted as bigint) as lines_deleted, "
    "cast(s_bug as bigint) as bug_fixes, refs as refactorings, counter as since_base, fired from st where phase = 4"
)


def _change_state(history):
    rows = history.filter(F.col("phase") == CHANGE)
    return rows.select(
        "project", "path", "commit_id",
        *_big("n", "lines_added", "lines_deleted", "bug_fixes", "refactorings", "since_base", "fired"),
    )


@query(dk.with_fx(STATE_SQL, *REP), prepare=True)
def file_state(spark, sf):
    return _change_state(_history(spark, sf))


@query(dk.with_fx(STATE_SQL, *REP), prepare=True)
def file_state_blocks(spark, sf):
    return _change_state(_history(spark, sf, block=SMALL))


@query(dk.with_fx(STATE_SQL, *REP), prepare=True)
def file_state_exact_blocks(spark, sf):
    events = _events(spark, sf, SMALL)
    return _change_state(with_exact_cycles(staged(closed_form_history(events, CUTS, block=SMALL)), CUTS, SMALL, chain=2))


@query(dk.with_fx(STATE_SQL, *REP), prepare=True)
def file_state_exact(spark, sf):
    """Every file by the closed form of its segments instead of that of the whole file."""
    return _change_state(with_exact_cycles(staged(closed_form_history(_events(spark, sf), CUTS)), CUTS))


def _stable_sql(cuts) -> str:
    return dk.with_fx(
        "select project, path, commit_id as stable_commit, fired, fire_base as base_commit, fire_n as base_n, "
        "fire_refs as refactorings from st where fired is not null",
        dk.events_cte("tgt"), dk.replay_cte(cuts),
    )


def _stable(cuts, block=BLOCK):
    def run(spark, sf):
        history = file_history(_events(spark, sf, block), cuts, block=block)
        return stb.stable_files(history, cuts).select(
            "project", "path", "stable_commit", *_big("fired"), "base_commit", *_big("base_n", "refactorings")
        )

    return run


query(_stable_sql((2, 5)), "stable_files", prepare=True)(_stable((2, 5)))
query(_stable_sql((3, 8)), "stable_files_3_8", prepare=True)(_stable((3, 8)))
query(_stable_sql((2, 5)), "stable_files_blocks", prepare=True)(_stable((2, 5), SMALL))

BASE_STATE = (
    "left join (select user_id, n, cast(any_value(s_added) as bigint) as a, cast(any_value(s_deleted) as bigint) as d, "
    "cast(any_value(s_bug) as bigint) as b from ev where phase = 4 group by user_id, n) x "
    "on x.user_id = st.user_id and x.n = fire_n left join aut on aut.user_id = st.user_id and aut.n = fire_n"
)


@query(
    dk.with_fx(
        "select project, path, commit_id as stable_commit, fired, fire_base as base_commit, fire_n as \"qtyOfCommits\", "
        "coalesce(a, 0) as \"linesAdded\", coalesce(d, 0) as \"linesDeleted\", coalesce(b, 0) as \"bugFixCount\", "
        "fire_refs as \"refactoringsInvolved\", coalesce(authors, 0) as \"qtyOfAuthors\", coalesce(minor, 0) as \"qtyMinorAuthors\", "
        "coalesce(major, 0) as \"qtyMajorAuthors\", coalesce(ownership, 0.0) as \"authorOwnership\" "
        f"from st {BASE_STATE} where fired is not null",
        *REP, dk.AUTHORS,
    ), prepare=True)
def stable_process_metrics(spark, sf):
    history = staged(pr.author_stats(_history(spark, sf, authors=True)))
    rows = stb.stable_process_metrics(stb.stable_files(history, CUTS))
    return _flat_metrics(rows, "project", "path", "stable_commit", F.col("fired").cast("bigint").alias("fired"), "base_commit")


def _flat_metrics(rows, *columns):
    m = F.col("processMetrics")
    longs = [c for c in pr.METRICS if c != "authorOwnership"]
    return rows.select(
        *columns,
        *[m[c].cast("bigint").alias(c) for c in longs],
        F.round(m["authorOwnership"], 6).alias("authorOwnership"),
    )


LATEST = (
    "lst as (select *, row_number() over (partition by user_id order by rn desc) as back from st)"
)


@query(
    dk.with_fx(
        "select project, path, n, cast(s_added as bigint) as lines_added, refs as refactorings from lst where back = 1",
        *REP, LATEST,
    ), prepare=True)
def latest_state(spark, sf):
    rows = pr.latest_state(_history(spark, sf))
    return rows.select("project", "path", *_big("n", "lines_added", "refactorings"))


@query(dk.with_fx("select project, path, n, since as counter from lst where back = 1 and since in (2)", *REP, LATEST), prepare=True)
def stable_now(spark, sf):
    rows = stb.stable_now(_history(spark, sf), CUTS)
    return rows.select("project", "path", *_big("n"), F.col("since_base").cast("bigint").alias("counter"))


LIVES = """with e as (select *, event_id % 17 = 0 as gone from events),
life as (select *, coalesce(sum(cast(gone as int)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as life from e),
st as (select concat('p', user_id % 5) as project, concat('src/F', user_id, '.java') as path, user_id, life, event_id, gone,
              count(*) filter (where not gone) over w as n, sum(case when gone then 0 else floor(value) end) over w as added,
              row_number() over (partition by user_id order by event_id desc) as back
       from life window w as (partition by user_id, life order by event_id))"""


def _lives(spark, sf, block=BLOCK):
    """The history of files of which some are deleted and created anew."""
    log = event_log(vw.commits(spark, sf), vw.deletion_changes(spark, sf), keep_deletes=True)
    return file_history(staged(rename_lineage(staged(log), block)), CUTS, block=block)


@query(
    f"{LIVES} select project, path, concat('c', event_id) as commit_id, n, cast(added as bigint) as lines_added, "
    "case when (n - 1) % 5 + 1 in (2, 5) then (n - 1) % 5 + 1 end as fired from st where not gone"
)
def file_state_deletes(spark, sf):
    rows = _lives(spark, sf).filter(F.col("phase") == CHANGE)
    return rows.select("project", "path", "commit_id", *_big("n", "lines_added", "fired"))


@query(f"{LIVES} select project, path, n, cast(added as bigint) as lines_added from st where back = 1 and not gone")
def latest_state_deletes(spark, sf):
    return pr.latest_state(_lives(spark, sf)).select("project", "path", *_big("n", "lines_added"))


AUTHORS_SQL = dk.with_fx(
        "select project, path, commit_id, ev.n, authors, minor, major, ownership from ev join aut "
        "on aut.user_id = ev.user_id and aut.n = ev.n where phase = 4",
        dk.events_cte("tgt"), dk.AUTHORS,
    )


def _author_stats(spark, sf, block=BLOCK):
    rows = pr.author_stats(_history(spark, sf, authors=True, block=block), block).filter(F.col("phase") == CHANGE)
    return rows.select(
        "project", "path", "commit_id", *_big("n", "authors", "minor", "major"),
        F.round("ownership", 6).alias("ownership"),
    )


@query(AUTHORS_SQL, prepare=True)
def author_stats(spark, sf):
    return _author_stats(spark, sf)


@query(AUTHORS_SQL, prepare=True)
def author_stats_blocks(spark, sf):
    return _author_stats(spark, sf, SMALL)


@query(
    dk.with_fx(
        "select project, commit_id, walk_pos, path, concat(stem, '0.java') as origin from ev join "
        "(select distinct user_id, stem from fx) s using (user_id)",
        dk.events_cte("tgt"),
    ),
    "rename_lineage", prepare=True)
def _rename_lineage(spark, sf):
    return _events(spark, sf).select(
        "project", "commit_id", "walk_pos", "path", F.substring_index("lineage", "#", 1).alias("origin")
    )


@query(dk.with_fx(
    "select project, commit_id, old_path, new_path from chg where is_rename and n_parents <= 1 and not (event_id % 2 = 0 and n_parents = 1)"), prepare=True)
def missed_renames(spark, sf):
    commits = _processed(spark, sf)
    seen = vw.labels(spark, sf).join(cm.with_detection(commits).select(*lb.COMMIT), lb.COMMIT, "left_semi")
    changes = _changes(spark, sf).join(commits.select(*lb.COMMIT), lb.COMMIT, "left_semi")
    return lb.missed_renames(changes, seen).select("project", "commit_id", "old_path", "new_path")


@query(dk.with_fx("select project, commit_id, old_path, new_path, 0 as pos from chg where is_rename"))
def diff_renames(spark, sf):
    return lb.diff_renames(_changes(spark, sf))


@query(dk.with_fx("select project, commit_id, old_path, new_path, 0 as pos from chg where is_rename and event_id % 2 = 0 "
                  "union all select project, commit_id, old_path, new_path, min(ref_pos) from lab "
                  "where not is_rename and type in ('MOVE_RENAME_CLASS', 'RENAME_CLASS', 'MOVE_CLASS') group by all"))
def detector_renames(spark, sf):
    return lb.detector_renames(vw.labels(spark, sf))


# --- labels ---------------------------------------------------------------------


@query(dk.with_fx("select project, commit_id, ref_pos, type, level from lab where level > 0"))
def studied_refactorings(spark, sf):
    return lb.studied_refactorings(vw.labels(spark, sf)).select("project", "commit_id", "ref_pos", "type", "level")


@query(dk.with_fx("select project, commit_id, ref_pos, type, level as code from lab"))
def refactoring_level(spark, sf):
    rows = vw.labels(spark, sf)
    return rows.select("project", "commit_id", "ref_pos", "type", nm.refactoring_level(F.col("type")).alias("code"))


@query(dk.with_fx("select project, commit_id, ref_pos, class_pos, old_path as file, class from cls"))
def refactored_classes(spark, sf):
    rows = lb.refactored_classes(lb.studied_refactorings(vw.labels(spark, sf)))
    return rows.select("project", "commit_id", "ref_pos", "class_pos", "file", "class")


@query(dk.with_fx("select project, commit_id, new_path, old_path from chg"))
def old_path_map(spark, sf):
    return lb.old_path_map(vw.file_changes(spark, sf))


@query(
    dk.with_fx(
        "select project, commit_id, class_after as class, arg_max(class0, ref_pos) as alias from lab "
        "where type in ('MOVE_RENAME_CLASS', 'RENAME_CLASS', 'MOVE_CLASS') group by 1, 2, 3"
    )
)
def class_aliases(spark, sf):
    return lb.class_aliases(vw.labels(spark, sf))


@query(dk.with_fx("select project, commit_id, ref_pos, class_pos, old_path as path, class, concat('b', event_id) as parent_id, level from tgt"), prepare=True)
def label_targets(spark, sf):
    rows = _targets(spark, sf)
    return rows.select("project", "commit_id", "ref_pos", "class_pos", "path", "class", "parent_id", "level")


@query(
    dk.with_fx(
        "select project, commit_id, ref_pos, class_pos, class from tgt where (event_id + ref_pos) % 5 > 2 and not exists (select 1 from lab f "
        "where f.commit_id = tgt.commit_id and f.level > 0 and f.ref_pos <= tgt.ref_pos and ((f.event_id + f.ref_pos) % 5 in (0, 2) "
        f"or ((f.event_id + f.ref_pos) % 5 = 1 and f.type not in {dk.ALL_SQL})))"
    ),
    prepare=True,
)
def targets_until_failure(spark, sf):
    """A label may fail between others of its commit; those before it count, those after it are lost."""
    no = F.expr("(cast(substring(commit_id, 2) as bigint) + ref_pos) % 5")
    nameless = F.transform("before", lambda p: F.struct(p["file"].alias("file"), F.lit(None).cast("string").alias("class")))
    labels = vw.labels(spark, sf).withColumns({
        "summary": F.when(no != 0, F.col("summary")),
        "before": F.when(no == 1, F.slice("before", 1, 0)).when(no == 2, nameless).otherwise(F.col("before")),
    })
    return lb.label_targets(_processed(spark, sf), labels, _changes(spark, sf)).select("project", "commit_id", "ref_pos", "class_pos", "class")


@query(dk.with_fx("select class, regexp_matches(class, '[.][a-z][^.]*$') as is_anonymous from cls"))
def is_anonymous_class(spark, sf):
    rows = lb.refactored_classes(lb.studied_refactorings(vw.labels(spark, sf)))
    return rows.select("class", nm.is_anonymous_class(F.col("class")).alias("is_anonymous"))


def _class_metric_sql() -> str:
    return dk.metric_columns(CLASS_METRICS, "event_id + case when class_pos = 1 then 6 else 0 end")


def _scaled(sql: str) -> str:
    """Cohesion as a whole number of 1/1024."""
    out = []
    for part in vw.split(sql):
        body, name = part.rsplit(" as ", 1)
        out.append(f"cast(trunc(({body}) * 1024) as int) as \"{name}\"" if name in ("classTCC", "classLCC")
                   else f'{body} as "{name}"')
    return ", ".join(out)


@query(
    dk.with_fx(
        "select project, commit_id, ref_pos, class_pos, old_path as \"filePath\", class as \"className\", "
        f"class_pos = 1 as \"isInnerClass\", {_scaled(_class_metric_sql())} from tgt"
    ), prepare=True)
def label_class_join(spark, sf):
    found = ins.label_class_join(_targets(spark, sf), vw.ck_classes(spark, sf))
    return found.select("project", "commit_id", "ref_pos", "class_pos", F.col("path").alias("filePath"), "className", "classMetrics.*")


def _found_methods(spark, sf):
    return ins.label_method_join(ins.label_class_join(_targets(spark, sf), vw.ck_classes(spark, sf)))


@query(
    dk.with_fx(
        "select project, commit_id, ref_pos, class_pos, level, concat('m', meth, '/2[T', user_id % 9, ',Map]') as full_name, "
        "10 * meth as start_line from inst where level in (2, 3)"
    ), prepare=True)
def label_method_join(spark, sf):
    m = ins.method_metric(F.col("method"))
    rows = _found_methods(spark, sf).filter(F.col("level").isin(2, 3))
    return rows.select(
        "project", "commit_id", "ref_pos", "class_pos", "level",
        m["fullMethodName"].alias("full_name"), m["startLine"].cast("bigint").alias("start_line"),
    )


@query(
    dk.with_fx(
        "select project, commit_id, ref_pos, class_pos, element_name, "
        "case element_name when 'e0' then meth when 'e1' then meth + 1 else -1 end as appearances from inst where level = 3"
    ), prepare=True)
def variable_appearances(spark, sf):
    rows = _found_methods(spark, sf).filter("level = 3")
    uses = ins.variable_appearances(F.col("method"), F.col("element_name"))
    return rows.select("project", "commit_id", "ref_pos", "class_pos", "element_name", uses.cast("bigint").alias("appearances"))


FIELD_SQL = (
    "case element_name when 'e0' then (event_id % 4) * ((event_id % 4) - 1) // 2 "
    "when 'e3' then (event_id % 4) * ((event_id % 4) - 1) // 2 + 3 * (event_id % 4) else 0 end"
)


@query(dk.with_fx(f"select project, commit_id, ref_pos, class_pos, element_name, {FIELD_SQL} as appearances from inst where level = 4"), prepare=True)
def field_appearances(spark, sf):
    rows = _found_methods(spark, sf).filter("level = 4")
    uses = ins.field_appearances(F.col("methods"), F.col("element_name"))
    return rows.select("project", "commit_id", "ref_pos", "class_pos", "element_name", uses.cast("bigint").alias("appearances"))


def _instances(spark, sf):
    return ins.refactoring_instances(_targets(spark, sf), vw.ck_classes(spark, sf))


INST_SQL = (
    "select project, commit_id, ref_pos, class_pos, old_path as \"filePath\", class as \"className\", user_id % 4 = 0 as \"isTest\", "
    "level, display_name as refactoring, summary as \"refactoringSummary\", "
    "case when level = 3 then case element_name when 'e0' then meth when 'e1' then meth + 1 else -1 end end as variable_appearances, "
    f"case when level = 4 then {FIELD_SQL} end as field_appearances from inst"
)


@query(dk.with_fx(INST_SQL), prepare=True)
def refactoring_instances(spark, sf):
    return _instances(spark, sf).select(
        "project", "commit_id", "ref_pos", "class_pos", "filePath", "className", "isTest", "level",
        "refactoring", "refactoringSummary",
        F.col("variableMetrics.variableAppearances").cast("bigint").alias("variable_appearances"),
        F.col("fieldMetrics.fieldAppearances").cast("bigint").alias("field_appearances"),
    )


@query(
    dk.with_fx(
        "select project, commit_id, ref_pos, class_pos, level from tgt "
        "where level in (2, 3) and event_id % 3 >= event_id % 4"
    ), prepare=True)
def labels_without_metrics(spark, sf):
    rows = ins.labels_without_metrics(_targets(spark, sf), _instances(spark, sf))
    return rows.select("project", "commit_id", "ref_pos", "class_pos", "level")


MINED = [dk.events_cte("inst"), dk.replay_cte(CUTS)]


@query(
    dk.with_fx(
        "select i.project, i.commit_id, i.ref_pos, i.class_pos, i.old_path as \"filePath\", st.n as \"qtyOfCommits\", "
        "cast(coalesce(s_added, 0) as bigint) as \"linesAdded\", cast(coalesce(s_deleted, 0) as bigint) as \"linesDeleted\", "
        "cast(coalesce(s_bug, 0) as bigint) as \"bugFixCount\", "
        "refs - k + row_number() over (partition by i.user_id, i.walk_pos order by i.ref_pos, i.class_pos) - 1 as \"refactoringsInvolved\", "
        "coalesce(authors, 0) as \"qtyOfAuthors\", coalesce(minor, 0) as \"qtyMinorAuthors\", "
        "coalesce(major, 0) as \"qtyMajorAuthors\", coalesce(ownership, 0.0) as \"authorOwnership\" "
        "from inst i join st on st.user_id = i.user_id and st.walk_pos = i.walk_pos and st.phase = 1 "
        "left join aut on aut.user_id = st.user_id and aut.n = st.n",
        *MINED, dk.AUTHORS,
    ), prepare=True)
def label_process_asof(spark, sf):
    rows = _mined(spark, sf).instances
    return _flat_metrics(rows, "project", "commit_id", "ref_pos", "class_pos", "filePath")


UNITS = """
fired as (select st.project, st.path, st.fired, st.fire_base as base_commit, st.fire_n as base_n, b.event_id as base_event, b.user_id
          from st join chg b on b.commit_id = st.fire_base where st.fired is not null and st.path = b.new_path),
ok as (select fired.*, i.inner_class, base_event % 4 as c, (base_event % 4) * ((base_event % 4) - 1) // 2 as s
       from fired join (values (0), (1)) i(inner_class) on true),
mth as (select ok.*, m.m from ok join (values (0), (1), (2)) m(m) on m.m < c),
unit as (
  select ok.*, 1 as level, null as method, null as element, null as uses from ok
  union all
  select mth.* exclude (m), 2, concat('m', m), null, null from mth
  union all
  select mth.* exclude (m), 3, concat('m', m), v.name, case v.name when 'e0' then m when 'e1' then m + 1 else m + 2 end
    from mth join (values ('e0'), ('e1'), ('v')) v(name) on true
  union all
  select ok.*, 4, null, v.name, case v.name when 'e0' then s when 'e3' then s + 3 * c else c end
    from ok join (values ('e0'), ('e3'), ('g')) v(name) on c > 0)"""
UNIT_SELECT = (
    "select project, base_commit as commit_id, path as \"filePath\", concat('pkg.F', user_id, case when inner_class = 1 then '.Inner' else '' end) "
    "as \"className\", fired as \"commitThreshold\", level, method, element, cast(uses as bigint) as uses, base_n as \"qtyOfCommits\" from unit"
)


def _units(rows, *more):
    return rows.select(
        *more, "project", "commit_id", "filePath", "className", F.col("commitThreshold").cast("bigint").alias("commitThreshold"), "level",
        F.col("methodMetrics.shortMethodName").alias("method"),
        F.coalesce("variableMetrics.variableName", "fieldMetrics.fieldName").alias("element"),
        F.coalesce("variableMetrics.variableAppearances", "fieldMetrics.fieldAppearances").cast("bigint").alias("uses"),
        F.col("processMetrics.qtyOfCommits").cast("bigint").alias("qtyOfCommits"),
    )


@query(dk.with_fx(UNIT_SELECT, *MINED, UNITS), prepare=True)
def stable_rows(spark, sf):
    return _units(_mined(spark, sf).stable)


@query(
    dk.with_fx(
        "select 'refactoring' as kind, i.project, i.commit_id, i.old_path as \"filePath\", i.class as \"className\", i.level, cast(null as bigint) as \"commitThreshold\", "
        "case when i.level in (2, 3) then concat('m', meth) end as method, case when i.level in (3, 4) then element_name end as element, uses, "
        "st.n as \"qtyOfCommits\", i.ref_pos, i.class_pos, refs - k + row_number() over (partition by i.user_id, i.walk_pos order by i.ref_pos, i.class_pos) - 1 as refs "
        "from (select *, cast(case level when 3 then case element_name when 'e0' then meth when 'e1' then meth + 1 else -1 end "
        f"when 4 then {FIELD_SQL} end as bigint) as uses from inst) i join st on st.user_id = i.user_id and st.walk_pos = i.walk_pos and st.phase = 1 "
        "union all select 'stable', project, base_commit, path, concat('pkg.F', user_id, case when inner_class = 1 then '.Inner' else '' end), level, fired, "
        "method, element, cast(uses as bigint), base_n, null, null, null from unit",
        *MINED, UNITS,
    ), prepare=True)
def training_set(spark, sf):
    rows = _mined(spark, sf).training_set()
    extra = rows.withColumn("refs", F.when(F.col("kind") == "refactoring", F.col("processMetrics.refactoringsInvolved")).cast("bigint"))
    more = ("kind", "ref_pos", "class_pos", "refs")
    return _units(extra, *more)


@query(
    dk.with_fx(
        "select st.project, st.path, st.commit_id as stable_commit, st.fire_base as base_commit from st "
        "join chg b on b.commit_id = st.fire_base where st.fired is not null and st.path <> b.new_path",
        *REP,
    ), prepare=True)
def stable_without_source(spark, sf):
    """Firings whose file had another name at the base commit: no row, only a report."""
    stable = stb.stable_files(_history(spark, sf), CUTS)
    at = vw.ck_classes(spark, sf).select("project", F.col("commit_id").alias("base_commit"), F.col("file").alias("path"))
    return stable.join(at, ["project", "base_commit", "path"], "left_anti").select(
        "project", "path", "stable_commit", "base_commit"
    )


@query(
    dk.with_fx(
        f"select project, commit_at as commit_id, file, class, inner_class = 1 as \"isInnerClass\", {_scaled(dk.metric_columns(CLASS_METRICS, 'event_id + 6 * inner_class'))} from ("
        "select chg.*, i.inner_class, concat('pkg.F', user_id, case when i.inner_class = 1 then '.Inner' else '' end) as class, "
        "case when s.side = 0 then commit_id else concat('b', event_id) end as commit_at, case when s.side = 0 then new_path else old_path end as file "
        "from chg join (values (0), (1)) i(inner_class) on true join (values (0), (1)) s(side) on true)"
    )
)
def class_metrics(spark, sf):
    return ins.class_metrics(vw.ck_classes(spark, sf)).select("project", "commit_id", "file", "class", "classMetrics.*")


@query(
    dk.with_fx(
        "select project, case when s.side = 0 then commit_id else concat('b', event_id) end as commit_id, "
        "case when s.side = 0 then new_path else old_path end as file, i.inner_class = 1 as is_inner, concat('m', m.m, '/2[T', user_id % 9, ',Map]') as \"fullMethodName\", "
        f"concat('m', m.m) as \"shortMethodName\", 10 * m.m as \"startLine\", {', '.join(p.rsplit(' as ', 1)[0] + ' as ' + chr(34) + p.rsplit(' as ', 1)[1] + chr(34) for p in vw.split(dk.metric_columns(METHOD_METRICS, 'event_id + m.m')))} "
        "from chg join (values (0), (1)) i(inner_class) on true join (values (0), (1)) s(side) on true "
        "join (values (0), (1), (2)) m(m) on m.m < event_id % 4"
    )
)
def method_metrics(spark, sf):
    rows = vw.ck_classes(spark, sf).select("project", "commit_id", "file", nm.is_inner_class(F.col("type")).alias("is_inner"), F.explode("methods").alias("m"))
    return rows.select("project", "commit_id", "file", "is_inner", ins.method_metric(F.col("m")).alias("x")).select(
        "project", "commit_id", "file", "is_inner", "x.*"
    )


# --- order history: many files per commit ---------------------------------------

WIDE_CTE = """
wl as (select l_partkey, l_orderkey, sum(l_quantity) as q, sum(l_linenumber) as ln,
       max(case when l_returnflag = 'R' and l_linenumber = 1 then 1 else 0 end) as lab from lineitem group by all),
wide as (select concat('p', l_partkey % 20) as project, concat('src/P', l_partkey, '.java') as path, l_partkey, l_orderkey,
         concat('c', l_orderkey) as commit_id, concat('a', o_custkey % 40) as author, cast(q as bigint) as added,
         cast(ln as bigint) as deleted, lab,
         case when regexp_matches(lower(o_orderpriority), 'bug|error|mistake|fault|wrong|fail|fix') then 1 else 0 end as bug
         from wl join orders on l_orderkey = o_orderkey),
seg as (select *, row_number() over w as n, sum(added) over w as sa, sum(deleted) over w as sd, sum(bug) over w as sb,
        sum(lab) over w as labs from wide window w as (partition by l_partkey order by l_orderkey)),
pos as (select *, row_number() over (partition by l_partkey, labs order by l_orderkey) as n_seg,
        first_value(commit_id) over (partition by l_partkey, labs order by l_orderkey) as seg_commit from seg)"""


def _wide_fired(cuts) -> str:
    top = max(cuts)
    return (
        f"select project, path, commit_id as stable_commit, (n_seg - 1) % {top} + 1 as fired from pos "
        f"where (n_seg - 1) % {top} + 1 in {tuple(cuts)}"
    )


def _wide_history(spark, sf, cuts, authors=False):
    from codehist.operators.lineage import incarnation

    events = vw.wide_events(spark, sf).withColumn("lineage", incarnation(F.col("path"), F.lit(0)))
    return closed_form_history(events, cuts, authors, uncut=BLOCK if authors else 0)


@query(
    f"with {WIDE_CTE} select project, path, commit_id, n, cast(sa as bigint) as lines_added, cast(sd as bigint) as lines_deleted, "
    "cast(sb as bigint) as bug_fixes from pos"
)
def wide_file_state(spark, sf):
    rows = _wide_history(spark, sf, (20, 50)).filter(F.col("phase") == CHANGE)
    return rows.select("project", "path", "commit_id", *_big("n", "lines_added", "lines_deleted", "bug_fixes"))


@query(f"with {WIDE_CTE} {_wide_fired((5, 10))}")
def wide_stable_files(spark, sf):
    rows = _wide_history(spark, sf, (5, 10)).filter("fired is not null")
    return rows.select("project", "path", F.col("commit_id").alias("stable_commit"), *_big("fired"))


@query(
    f"with {WIDE_CTE}, acnt as (select a.l_partkey, a.n, b.author, count(*) as c from seg a join seg b on a.l_partkey = b.l_partkey "
    "and b.n <= a.n group by a.l_partkey, a.n, b.author), aut as (select l_partkey, n, count(*) as authors, "
    "count(*) filter (where c < n * cast(0.05 as double)) as minor, count(*) filter (where c >= n * cast(0.05 as double)) as major, "
    "round(max(c) / cast(n as double), 6) as ownership from acnt group by l_partkey, n) "
    "select project, path, commit_id, authors, minor, major, ownership from seg join aut using (l_partkey, n)"
)
def wide_author_stats(spark, sf):
    # of the history only what the author metrics are made of is written
    history = _wide_history(spark, sf, (20, 50), authors=True).filter(F.col("phase") == CHANGE)
    with shuffles_removed(spark):
        history = staged(history.select("project", "lineage", "path", *ORDER, "commit_id", "n", "k", "authors", "top_author"))
    rows = pr.author_stats(history).filter(F.col("phase") == CHANGE)
    return rows.select("project", "path", "commit_id", *_big("authors", "minor", "major"), F.round("ownership", 6).alias("ownership"))


# --- sources --------------------------------------------------------------------


def _duck_sources(body: str, *ctes: str) -> str:
    return f"with {', '.join([dk.SOURCES, *ctes])} {body}"


# lines that are not blank; the texts hold no comment marks of their own
LINES = (
    "len(list_filter(string_split_regex(raw, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '[^\\x00-\\x20]')))"
)
LOC_CTE = (
    f"loc as (select *, case when text is null then 0 when doc_id % 3 = 1 then 1 else {LINES} end as n from src)"
)


@query(_duck_sources("select project, path, n as loc from loc", LOC_CTE))
def source_loc(spark, sf):
    rows = vw.source_files(spark, sf)
    return rows.select("project", "path", count_loc(F.col("text")).cast("bigint").alias("loc"))


@query(_duck_sources("select project, path from src where lower(path) like '%.java'"))
def java_files(spark, sf):
    return inv.java_files(vw.source_files(spark, sf)).select("project", "path")


@query(
    _duck_sources(
        "select project, count(*) filter (where not t) as \"numberOfProductionFiles\", count(*) filter (where t) as \"numberOfTestFiles\", "
        "cast(coalesce(sum(n) filter (where not t), 0) as bigint) as \"productionLoc\", cast(coalesce(sum(n) filter (where t), 0) as bigint) as \"testLoc\", "
        "cast(sum(n) as bigint) as \"javaLoc\", count(*) filter (where text is null) as \"exceptionsCount\" "
        "from (select *, lower(path) like '%test%' as t from loc where lower(path) like '%.java') group by project",
        LOC_CTE,
    )
)
def project_inventory(spark, sf):
    return inv.project_inventory(vw.source_files(spark, sf))


@query(
    _duck_sources(
        "select path, lower(path) like '%test%' and lower(path) like '%.java' as is_test, lower(path) like '%.java' as is_java, "
        "replace(string_split(path, '/')[-1], '.java', '') as class_name, string_split(path, '/')[-1] as file_name, "
        "array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') as folder, concat(path, '/') as slashed from src"
    )
)
def path_names(spark, sf):
    p = F.col("path")
    return vw.source_files(spark, sf).select(
        "path", nm.is_test_file(p).alias("is_test"), nm.is_java_file(p).alias("is_java"), nm.class_from_file(p).alias("class_name"),
        nm.file_name_only(p).alias("file_name"), nm.dirs_only(nm.unix_path(p)).alias("folder"), nm.last_slash_dir(p).alias("slashed"),
    )


def _requests(spark, sf):
    """Every rated document and one that does not exist."""
    return vw.read(spark, sf, "labels").selectExpr(
        "concat('p', doc_id % 5) as project",
        "concat('c', doc_id) as commit_id",
        "doc_id",
        "quality",
    ).join(
        vw.read(spark, sf, "documents").selectExpr("doc_id", *vw.split(vw.SOURCES_SQL)[2:3]), "doc_id"
    ).withColumn("path", F.when(F.col("quality") == 1, F.col("path")).otherwise(F.concat("path", F.lit(".gone"))))


@query(
    _duck_sources(
        "select src.project, src.commit_id, case when quality = 1 then path else concat(path, '.gone') end as path, quality = 1 as found, "
        "case when quality = 1 then length(text) end as chars from labels join src using (doc_id)"
    )
)
def source_at_commit(spark, sf):
    rows = inv.source_at_commit(_requests(spark, sf).select("project", "commit_id", "path"), vw.source_files(spark, sf))
    return rows.select("project", "commit_id", "path", "found", F.length("text").cast("bigint").alias("chars"))


def _snapshots(spark, sf):
    """A text for the file of every event, as committed and at its parent."""
    rows = vw.fx(spark, sf)
    sides = "array(struct(commit_id as at, concat(stem, ver, '.java') as path), struct(concat('b', event_id) as at, concat(stem, ver - cast(is_rename as int), '.java') as path))"
    return rows.selectExpr("project", f"explode({sides}) as s", "message").selectExpr(
        "project", "s.at as commit_id", "s.path as path", "concat(s.at, ' ', message) as text"
    )


@query(
    dk.with_fx(
        "select distinct project, commit_id, ref_pos, class_pos, 'before' as side, string_split(old_path, '/')[-1] as file_name, "
        "concat('b', event_id, ' ', message) as text from inst union all "
        "select project, commit_id, ref_pos, class_pos, 'after', string_split(new_path, '/')[-1], concat(commit_id, ' ', message) from inst"
    ), prepare=True)
def source_archive(spark, sf):
    instances = staged(_instances(spark, sf).select(*lb.LABEL, "class_pos", "match_pos", "id"))
    texts = inv.source_archive(instances, vw.labels(spark, sf), vw.commits(spark, sf), _snapshots(spark, sf))
    keys = instances.filter("match_pos = 1").select("id", "commit_id", "ref_pos", "class_pos")
    return texts.join(keys, "id").select("project", "commit_id", "ref_pos", "class_pos", "side", "file_name", "text")


@query(
    dk.with_fx(
        "select st.project, st.fire_base as commit_id, st.path, st.fired, 'not-refactored' as side, concat(b.commit_id, ' ', b.message) as text "
        "from st join chg b on b.commit_id = st.fire_base where st.fired is not null and st.path = b.new_path",
        *REP,
    ), prepare=True)
def stable_archive(spark, sf):
    stable = stb.stable_files(_history(spark, sf), CUTS)
    return inv.stable_archive(stable, _snapshots(spark, sf)).withColumn("fired", F.col("fired").cast("bigint"))


# --- names ----------------------------------------------------------------------

METHODS_SQL = (
    "concat('m', l_linenumber, '/2[a.b.T', l_suppkey % 9, ',java.util.Map<x.Y,z.List<W', l_linenumber, '>>', "
    "case when l_suppkey % 2 = 0 then '[]' else '' end, ']')"
)


@query(
    f"select distinct l_partkey, {METHODS_SQL} as method_name, concat('m', l_linenumber, '/2[T', l_suppkey % 9, ',Map', "
    "case when l_suppkey % 2 = 0 then '[]' else '' end, ']') as simple, concat('m', l_linenumber) as clean from lineitem"
)
def simplify_method_name(spark, sf):
    rows = vw.read(spark, sf, "lineitem").selectExpr("l_partkey", f"{METHODS_SQL} as method_name").distinct()
    m = F.col("method_name")
    return rows.select("l_partkey", "method_name", nm.simplify_method_name(m).alias("simple"), nm.clean_method_name(m).alias("clean"))


@query(
    "select p_partkey, concat(string_split(p_name, ' ')[1], '/2[', p_brand, case when p_size % 3 > 0 then repeat('[]', cast(p_size % 3 as bigint)) else '' end, ',', p_type, ']') as full_name, "
    "concat(string_split(p_name, ' ')[1], '/0') as empty_name from part"
)
def full_method_name(spark, sf):
    name = F.expr("split(p_name, ' ')[0]")
    dims = F.array(F.expr("p_size % 3"), F.lit(0))
    return vw.read(spark, sf, "part").select(
        "p_partkey",
        nm.full_method_name(name, F.array("p_brand", "p_type"), dims).alias("full_name"),
        nm.full_method_name(name, F.array().cast("array<string>"), F.array().cast("array<int>")).alias("empty_name"),
    )


@query(
    "select page_id, not (starts_with(url, 'https') or starts_with(url, 'git')) as is_local, "
    "replace(string_split(rtrim(url, '/'), '/')[-1], '.git', '') as project_name, "
    "case when not (starts_with(url, 'https') or starts_with(url, 'git')) then concat('@local/', url, '/c', page_id) "
    "else concat(replace(url, '.git', ''), '/commit/c', page_id) end as commit_url from pages"
)
def url_names(spark, sf):
    url = F.col("url")
    commit = F.concat(F.lit("c"), F.col("page_id").cast("string"))
    return vw.read(spark, sf, "pages").select(
        "page_id", nm.is_local_url(url).alias("is_local"), nm.project_name(url).alias("project_name"),
        nm.commit_url(url, commit).alias("commit_url"),
    )


@query(
    "select event_id, regexp_matches(lower(message), 'bug|error|mistake|fault|wrong|fail|fix') as is_bug_fix, left(message, 20) as short, "
    "message as trimmed, concat(chr(34), replace(quoted, chr(34), concat(chr(34), chr(34))), chr(34)) as escaped, "
    "concat(chr(10), '{commit: c', event_id, ' from project: p', user_id % 5) as state "
    "from (select *, concat(event_type, ' seen by user ', user_id) as message, props as quoted from events)"
)
def message_names(spark, sf):
    rows = vw.read(spark, sf, "events").selectExpr(
        "*", "concat(event_type, ' seen by user ', user_id) as message", "concat('c', event_id) as c", "concat('p', user_id % 5) as p"
    )
    m = F.col("message")
    padded = F.concat(F.lit(" \t"), m, F.lit("\n "))
    return rows.select(
        "event_id", nm.is_bug_fix(m).alias("is_bug_fix"), nm.short_summary(m).alias("short"), nm.trimmed(padded).alias("trimmed"),
        nm.csv_escape(F.col("props")).alias("escaped"), nm.error_state(F.col("c"), F.col("p")).alias("state"),
    )


@query(
    "select p_partkey, array_to_string(list_sort([p_size, p_size + 3, 20]), ',') as thresholds, p_size + 3 + "
    "case when p_size + 3 < 20 then 20 - p_size - 3 else 0 end as top, cast(trunc(cast(p_size as float) / cast(64 as float) * 1024) as int) as scaled, "
    "round(p_retailprice / 1000.0 / 60.0, 6) as minutes from part"
)
def parse_thresholds(spark, sf):
    text = F.expr("concat('[', p_size + 3, ', ', p_size, ';,20 x]')")
    cuts = nm.parse_thresholds(text)
    return vw.read(spark, sf, "part").select(
        "p_partkey", F.array_join(cuts, ",").alias("thresholds"), F.array_max(cuts).alias("top"),
        nm.scale_cohesion(F.expr("cast(p_size as float) / cast(64 as float)")).alias("scaled"),
        F.round(nm.elapsed_minutes(F.col("p_retailprice")), 6).alias("minutes"),
    )


@query(
    "select p_partkey, concat('a.b.', replace(p_name, ' ', '.'), '.X') as clean, 'X' as last from part"
)
def class_names(spark, sf):
    rows = vw.read(spark, sf, "part").selectExpr("p_partkey", "concat('a.b.', replace(p_name, ' ', '$'), '$X') as class")
    clean = nm.clean_dollar(F.col("class"))
    return rows.select("p_partkey", clean.alias("clean"), nm.class_from_full_name(clean).alias("last"))


# --- quality --------------------------------------------------------------------

LIMIT = 2


@query(
    dk.with_fx(
        "select project, commit_id, ref_pos, class_pos, class as \"className\", not exists (select 1 from (select commit_id as c, class from inst "
        f"group by all having count(*) >= {LIMIT}) x where x.c = inst.commit_id) as \"isValid\" from inst"
    ), prepare=True)
def mark_invalid(spark, sf):
    rows = ql.mark_invalid(_instances(spark, sf), LIMIT)
    return rows.select("project", "commit_id", "ref_pos", "class_pos", "className", "isValid")


@query(
    dk.with_fx(
        "select project, commit_id, ref_pos, class_pos from inst where not exists (select 1 from (select commit_id as c, class from inst "
        f"group by all having count(*) >= {LIMIT}) x where x.c = inst.commit_id) and ref_pos % 2 = 0"
    ), prepare=True)
def valid_instances(spark, sf):
    """Every other label has no mark at all."""
    rows = ql.mark_invalid(_instances(spark, sf), LIMIT)
    rows = ql.valid_instances(rows.withColumn("isValid", F.when(F.col("ref_pos") % 2 == 0, F.col("isValid"))))
    return rows.select("project", "commit_id", "ref_pos", "class_pos")


@query(
    dk.with_fx(
        "select project, cast(sum(c) as bigint) as rows, count(*) as distinct_rows, cast(sum(c) - count(*) as bigint) as duplicates from "
        "(select project, commit_id, old_path, class, level, meth, case when level in (3, 4) then element_name end as el, display_name, summary, "
        "count(*) as c from (select inst.* from inst join (values (0), (1)) twice(t) on t = 0 or event_id % 4 = 0) group by all) group by project"
    ), prepare=True)
def duplicate_instances(spark, sf):
    """The rows of every fourth commit stand in the table twice."""
    rows = staged(_instances(spark, sf))
    again = rows.filter(F.expr("cast(substring(commit_id, 2) as bigint) % 4 = 0"))
    return ql.duplicate_instances(rows.unionByName(again))


@query(
    dk.with_fx(
        "select project, user_id % 4 = 0 as \"isTest\", count(distinct class) as classes, count(distinct old_path) as files from inst group by all"
    ), prepare=True)
def distinct_names(spark, sf):
    return ql.distinct_names(_instances(spark, sf))


@query(
    dk.with_fx(
        "select project, commit_id, 'not used' as problem from com where commit_id not in (select commit_id from inst) "
        "and commit_id not in (select fire_base from st where fired is not null)",
        COMMITS_CTE, *REP,
    ), prepare=True)
def orphan_commits(spark, sf):
    stable = stb.stable_files(_history(spark, sf), CUTS).select("project", F.col("base_commit").alias("commit_id"))
    return ql.orphan_commits(_instances(spark, sf), stable, _processed(spark, sf))


def _known_projects(spark, sf):
    """Projects of the customers' nations; a third never finished."""
    return vw.read(spark, sf, "nation").selectExpr(
        "concat('p', n_nationkey) as project", "concat('https://x.org/', lower(n_name), '.git') as gitUrl",
        "case when n_nationkey % 3 > 0 then timestamp '2024-01-01 00:00:00' end as finishedDate",
        "n_nationkey % 4 as exceptionsCount",
    )


def _customer_rows(spark, sf):
    """Rows of known projects, and some that name none."""
    return vw.read(spark, sf, "customer").selectExpr(f"{CUSTOMER_PROJECT} as project", "c_custkey", "c_nationkey")


CUSTOMER_PROJECT = "case when c_custkey % 11 > 0 then concat('p', c_nationkey) end"


@query(f"select {CUSTOMER_PROJECT} as project, c_custkey from customer where c_nationkey % 3 > 0 or c_custkey % 11 = 0")
def drop_unfinished(spark, sf):
    tables = {"rows": _customer_rows(spark, sf).select("project", "c_custkey")}
    return ql.drop_unfinished(tables, _known_projects(spark, sf))["rows"]


@query(f"select {CUSTOMER_PROJECT} as project, c_custkey from customer where c_nationkey <> 7 or c_custkey % 11 = 0")
def drop_project(spark, sf):
    return ql.drop_project({"rows": _customer_rows(spark, sf).select("project", "c_custkey")}, "p7")["rows"]


@query("select concat('p', n_nationkey) as project, n_nationkey % 4 as exceptions from nation where n_nationkey % 4 > 0")
def inconsistent_projects(spark, sf):
    return ql.inconsistent_projects(_known_projects(spark, sf)).select("project", F.col("exceptionsCount").alias("exceptions"))


def _requested(spark, sf):
    """Every supplier asks for the project of its nation, or for its own."""
    rows = vw.read(spark, sf, "supplier").join(vw.read(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    return rows.selectExpr(
        "concat('https://x.org/', case when s_suppkey % 2 = 0 then lower(n_name) else concat('s', s_suppkey) end, '.git') as git_url", "s_suppkey"
    )


@query("select concat('https://x.org/s', s_suppkey, '.git') as git_url, s_suppkey from supplier where s_suppkey % 2 = 1")
def new_projects(spark, sf):
    return ql.new_projects(_requested(spark, sf), _known_projects(spark, sf))


@query(
    "select concat('https://', string_split(url, '/')[3], '.git') as git_url, count(*) as times from pages group by 1 having count(*) > 1"
)
def repeated_projects(spark, sf):
    """Pages of one host ask for the same project."""
    host = F.get(F.split("url", "/"), 2)
    rows = vw.read(spark, sf, "pages").select(F.concat(F.lit("https://"), host, F.lit(".git")).alias("git_url"))
    return ql.repeated_projects(rows)


RUN_STEPS = (
    ("1", "started", "", 0, 3), ("10", "started", "", 1, 3), ("1", "failed", "Repository not available", 2, 1), ("1", "finished", "", 2, 0), ("1", "started", "", 3, 1),
    ("10", "failed", "set1", 4, 1), ("10", "failed", "set1", 4, 2), ("2", "started", "", 5, 3), ("2", "failed", "set2", 6, 3),
)
LEDGER = (
    "select concat('https://x.org/s', s_suppkey) as git_url, concat('https://x.org/s', s_suppkey, ', set', d.dataset) as info, d.status, "
    "concat('https://x.org/s', s_suppkey, ', ', d.reason, ', x.TransportException: ', s_name) as failure, s_suppkey * 10 + d.step as pos from supplier join (values "
    + ", ".join(map(str, RUN_STEPS))
    + ") d(dataset, status, reason, step, nth) "
    "on d.nth = 3 or s_nationkey % 3 = d.nth"
)


@query(
    f"with r as ({LEDGER}), l as (select git_url, pos, case when status = 'started' then info else failure end as line from r where status <> 'finished'), "
    "n as (select info, pos from r where status <> 'started') "
    "select git_url, line from l where not exists (select 1 from n where contains(l.line, n.info) and n.pos >= l.pos)"
)
def failed_projects(spark, sf):
    """Runs that end in time order; ``s, set1`` is part of ``s, set10``, and some failures name a data set themselves."""
    steps = "array(" + ", ".join(f"named_struct('dataset', '{d}', 'status', '{s}', 'reason', '{r}', 'at', {at}, 'only', {only})" for d, s, r, at, only in RUN_STEPS) + ")"
    runs = vw.read(spark, sf, "supplier").selectExpr("s_suppkey", "s_nationkey", "s_name", f"explode({steps}) as d").filter("d.only = 3 or s_nationkey % 3 = d.only").selectExpr(
        "concat('https://x.org/s', s_suppkey) as git_url", "concat('set', d.dataset) as dataset", "d.status as status", "d.reason as reason",
        "concat('x.TransportException: ', s_name) as exception", "s_suppkey * 10 + d.at as pos",
    )
    return ql.failed_projects(runs)


@query(
    dk.with_fx(
        "select project, commit_id, coalesce(min(ref_pos) filter (event_id % 5 in (1, 2) and renames), min(ref_pos)) as ref_pos, any_value(reason) as reason from ("
        "select *, type in ('MOVE_RENAME_CLASS', 'RENAME_CLASS', 'MOVE_CLASS') as renames, "
        "case event_id % 5 when 0 then 'no summary' when 1 then 'no class before' when 2 then 'rename without class after' else 'method name not readable' end as reason "
        f"from lab where level > 0) where event_id % 5 in (0, 3) or (event_id % 5 = 1 and type not in {dk.ALL_SQL}) or (event_id % 5 = 2 and renames) group by 1, 2"
    )
)
def quarantine(spark, sf):
    """Labels broken in one of four ways, by commit: the first one stops it."""
    no = F.expr("cast(substring(commit_id, 2) as bigint) % 5")
    rows = vw.labels(spark, sf)
    rows = rows.withColumns({
        "summary": F.when(no != 0, F.col("summary")),
        "before": F.when(no != 1, F.col("before")).otherwise(F.slice("before", 1, 0)),
        "after": F.when(no != 2, F.col("after")).otherwise(F.slice("after", 1, 0)),
        "method_full_name": F.when(no != 3, F.col("method_full_name")).otherwise(F.lit("m/1[List<A]")),
    })
    return ql.quarantine(rows).select("project", "commit_id", "ref_pos", "reason")


@query(
    dk.with_fx(
        "select p.project, p.threshold, coalesce(r.c, 0) as refactorings, coalesce(t.c, 0) as stable, coalesce(s.c, 0) as stable_at_threshold from "
        "(select distinct project, threshold from fx0 join (values (2), (5), (9)) v(threshold) on true) p "
        "left join (select project, count(*) as c from inst group by 1) r on r.project = p.project "
        "left join (select project, count(*) as c from st where fired is not null group by 1) t on t.project = p.project "
        "left join (select project, fired, count(*) as c from st where fired is not null group by 1, 2) s on s.project = p.project and s.fired = p.threshold",
        *REP,
    ), prepare=True)
def project_stats(spark, sf):
    stable = stb.stable_files(_history(spark, sf), CUTS).select("project", F.col("fired").alias("commitThreshold"))
    projects = vw.commits(spark, sf).select("project").distinct().withColumn("thresholds", F.array(*[F.lit(t) for t in (2, 5, 9)]))
    return rp.project_stats(_instances(spark, sf), stable, projects)


# --- run logs -------------------------------------------------------------------


def _info(body: str) -> str:
    return f"with log as (select k, page_id, {vw.INFO_SQL} from pages join range(20) r(k) on true) {body}"


def _debug(body: str, *ctes: str) -> str:
    return f"with {', '.join([f'log as (select event_id, event_type, value, {vw.DEBUG_SQL} from events)', *ctes])} {body}"


@query(
    _info(
        "select count(*) filter (where k = 0) as projects, round(sum(case when k = 0 then cast(concat(page_id % 50, '.', page_id % 7) as double) else 0 end), 6) as minutes, "
        "cast(sum(case when k = 1 then page_id % 90 else 0 end) as bigint) as refactorings, cast(sum(case when k = 1 then page_id % 70 else 0 end) as bigint) as stable from log"
    )
)
def run_totals(spark, sf):
    return rp.run_totals(vw.info_log(spark, sf)).withColumn("minutes", F.round("minutes", 6))


@query(
    _info(
        "select t.threshold, cast(coalesce(sum(n), 0) as bigint) as stable from (select unnest([15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100]) as threshold) t "
        "left join (select 15 + 5 * (page_id % 8) as threshold, page_id % 40 as n from log where k = 2 "
        "union all select 60 + 10 * (page_id % 5), page_id % 30 from log where k = 3) x using (threshold) group by 1"
    )
)
def threshold_totals(spark, sf):
    return rp.threshold_totals(vw.info_log(spark, sf))


@query(_info("select file, line_no, line from log where k <= 15"))
def project_blocks(spark, sf):
    return rp.project_blocks(vw.info_log(spark, sf))


@query(
    _info(
        "select cast(sum(case when k = 4 then page_id when k > 4 then 1 else 0 end) as bigint) as commits, cast(sum(case when k = 4 then page_id % 11 else 0 end) as bigint) as production_files, "
        "cast(sum(case when k = 4 then page_id % 5 else 0 end) as bigint) as test_files, cast(sum(case when k = 4 then page_id * 10 else 0 end) as bigint) as java_loc, "
        "round(sum(case when k = 0 then cast(concat(page_id % 50, '.', page_id % 7) as double) else 0 end) / sum(case when k = 4 then page_id when k > 4 then 1 else 0 end) * 60000, 4) as millis_per_commit "
        "from log where k <= 15"
    )
)
def project_totals(spark, sf):
    rows = rp.project_totals(rp.project_blocks(vw.info_log(spark, sf)))
    return rows.withColumn("millis_per_commit", F.round("millis_per_commit", 4))


@query(
    _debug(
        "select case when event_id % 2 = 0 then 'java.lang.IllegalStateException' else 'java.lang.RuntimeException' end as exception, count(*) as n, 1 as distinct_names "
        "from x group by 1 union all select null, count(*), count(distinct event_id % 2) from x",
        "x as (select * from log where event_type = 'error' and event_id % 3 = 1)",
    )
)
def exception_counts(spark, sf):
    return rp.exception_counts(vw.debug_log(spark, sf))


@query(
    _debug(
        "select site, count(*) as n, 1 as distinct_names from x group by 1 union all select null, count(*), count(distinct site) from x",
        "x as (select case when event_id % 3 = 0 then concat('Walker:', event_id % 7) else 'java.lang.OutOfMemoryError' end as site "
        "from log where event_type = 'error' and event_id % 3 <> 1)",
    )
)
def error_sites(spark, sf):
    log = vw.debug_log(spark, sf)
    return rp.error_sites(log, log)


@query(
    _debug(
        "select concat('c', event_id) as commit_id, ms as millis, commits, total_millis, average_millis, e.e as \"end\" from x, "
        "(select count(*) as commits, cast(sum(ms) as bigint) as total_millis, cast(sum(ms) // count(*) as bigint) as average_millis, min(ms) as lo, max(ms) as hi from x) t, "
        "(values ('fastest'), ('slowest')) e(e) where ms = case e.e when 'fastest' then lo else hi end",
        "x as (select event_id, cast(floor(value * 10) as bigint) as ms from log where event_type <> 'error')",
    )
)
def commit_timing(spark, sf):
    return rp.commit_timing(vw.debug_log(spark, sf))


@query(
    dk.with_fx(
        "select x.project, 'set' as \"datasetName\", git_url as \"gitUrl\", replace(string_split(rtrim(git_url, '/'), '/')[-1], '.git', '') as \"projectName\", "
        "timestamp '2024-01-01 00:00:00' as \"dateOfProcessing\", cast(null as timestamp) as \"finishedDate\", commits, '[20, 50]' as \"commitCountThresholds\", "
        "f.*, cast(-1 as bigint) as \"projectSizeInBytes\", last_commit_hash as \"lastCommitHash\", "
        "not (starts_with(git_url, 'https') or starts_with(git_url, 'git')) as \"isLocal\" "
        "from (select project, count(*) as commits, arg_max(commit_id, walk_pos) as last_commit_hash from fx0 group by 1) x join prj using (project) "
        "left join lateral (select cast(coalesce(sum(n), 0) as bigint) as \"javaLoc\", count(*) filter (where not t) as \"numberOfProductionFiles\", "
        "count(*) filter (where t) as \"numberOfTestFiles\", cast(coalesce(sum(n) filter (where not t), 0) as bigint) as \"productionLoc\", "
        "cast(coalesce(sum(n) filter (where t), 0) as bigint) as \"testLoc\", count(*) filter (where text is null) as \"exceptionsCount\" "
        "from (select *, lower(path) like '%test%' as t from loc where lower(path) like '%.java' and loc.project = x.project)) f on true",
        PROJECTS_CTE, dk.SOURCES, LOC_CTE,
    )
)
def project_table(spark, sf):
    asked = _projects(spark, sf).selectExpr(
        "project", "'set' as dataset", "git_url", "timestamp '2024-01-01 00:00:00' as date_of_processing", "cast(null as bigint) as size_in_bytes"
    )
    return cm.project_table(asked, cm.commit_totals(vw.commits(spark, sf)), inv.project_inventory(vw.source_files(spark, sf)), "50, 20")


# --- sink and stream ------------------------------------------------------------

LEGACY_SQL = "(" + ", ".join(f"'{t}'" for t in LEGACY_TYPES) + ")"


@query(dk.with_fx(f"select project, commit_id, ref_pos, type, level from lab where level > 0 and type in {LEGACY_SQL}"))
def legacy_labels(spark, sf):
    rows = lb.studied_refactorings(vw.labels(spark, sf), legacy_only=True)
    return rows.select("project", "commit_id", "ref_pos", "type", "level")


@query(dk.with_fx("select project, level, commit_id, ref_pos, class_pos, class as \"className\" from inst"), prepare=True)
def write_instances(spark, sf):
    """Instances written by project, and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    write_rows(_instances(spark, sf), path)
    return spark.read.parquet(path).select("project", "level", "commit_id", "ref_pos", "class_pos", "className")


# --- the walk from parents ------------------------------------------------------

# in every ten commits of a project a side branch of two that is merged, and one commit that is not
GRAPH = (
    "case when rn = 1 then [] when rn % 10 = 5 then [rn - 3] when rn % 10 = 6 then [rn - 1, rn - 2] when rn % 10 = 9 then [rn - 2] else [rn - 1] end"
)
WALK_SQL = (
    "with recursive g as (select concat('p', user_id % 5) as project, event_id, row_number() over (partition by user_id % 5 order by event_id) as rn from events), "
    f"e as (select project, rn, unnest({GRAPH}) as parent from g), "
    "held as (select project, max(rn) as rn from g group by 1 union select e.project, e.parent from e join held h on h.project = e.project and h.rn = e.rn) "
)


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = vw.read(spark, sf, "events").selectExpr("concat('p', user_id % 5) as project", "event_id")
    rows = staged(running(rows, ["project"], "event_id", ["event_id"], {"rn": F.lit(1)}))
    parents = GRAPH.replace("[", "array(").replace("]", ")").replace("array()", "cast(array() as array<bigint>)")
    commits = rows.selectExpr(
        "project", "concat('k', rn) as commit_id", f"transform({parents}, x -> concat('k', x)) as parents", "event_id as time"
    )
    heads = rows.groupBy("project").agg(F.concat(F.lit("k"), F.max("rn")).alias("commit_id"))
    return commits, heads


@query(WALK_SQL + "select project, concat('k', rn) as commit_id from held")
def reachable_commits(spark, sf):
    """Commits that the last one of each project holds; one in ten is on no branch of it."""
    return walk.reachable_commits(*_graph(spark, sf)).select("project", "commit_id")


@query(WALK_SQL + "select project, concat('k', rn) as commit_id, row_number() over (partition by project order by rn) as walk_pos from held")
def commit_walk(spark, sf):
    return walk.commit_walk(*_graph(spark, sf)).select("project", "commit_id", "walk_pos")


# --- files ----------------------------------------------------------------------

JAVA = "case event_id % 4 when 0 then '.kt' when 1 then '.JAVA' when 2 then '.javac' else '.java' end"


@query(
    dk.with_fx(f"select project, commit_id, concat(stem, ver, {JAVA}) as path, walk_pos, lines_added as added from chg where n_parents <= 1 and event_id % 2 = 1"),
    prepare=True,
)
def java_changes(spark, sf):
    """Changes whose new path has one of four endings; the case of letters does not matter."""
    other = F.expr(f"regexp_replace(new_path, '[.]java$', {JAVA.replace('event_id', 'cast(substring(commit_id, 2) as bigint)')})")
    changes = _changes(spark, sf).withColumn("new_path", other)
    return change_events(_processed(spark, sf), changes).select("project", "commit_id", "path", "walk_pos", "added")


@query(dk.with_fx("select project, commit_id, ref_pos, class_pos from inst where commit_id = (select max(commit_id) from inst)"), prepare=True)
def commit_instances(spark, sf):
    rows = staged(_instances(spark, sf).select(*lb.LABEL, "class_pos"))
    return ins.commit_instances(rows, rows.agg(F.max("commit_id")).first()[0])


@query(
    "select concat('p', c_nationkey) as project, concat('c', c_custkey) as commit_id, c_custkey as id, "
    "row_number() over (order by concat('p', c_nationkey), case when c_custkey % 7 > 0 then 1 - c_custkey end nulls first, c_custkey) as place from customer"
)
def ordered_rows(spark, sf):
    """Rows in the order of the walk; some commits are in no walk. Their places are numbered as they come."""
    rows = vw.read(spark, sf, "customer").selectExpr("concat('p', c_nationkey) as project", "concat('c', c_custkey) as commit_id", "c_custkey as id")
    walk = rows.filter("id % 7 > 0").withColumn("walk_pos", 1 - F.col("id"))
    ordered = ql.in_order(rows, walk)
    return project_places(ordered)


def project_places(ordered: DataFrame) -> DataFrame:
    """Numbers the rows of a sorted table: rows per partition, and the place in it."""
    kept = staged(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", (before - F.col("_first") + 1).alias("_offset"))
    return kept.join(offsets, "_part").select("project", "commit_id", "id", (F.col("_row") + F.col("_offset")).alias("place"))


@query("select o_orderkey as key, cast(0 as bigint) as off from orders")
def log_lines(spark, sf):
    """Orders written as text files in the order of their keys: a line's number is the place of its key in the file."""
    path = f"{shared_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    # as many files as shuffle partitions: neither the sort of a file nor the places in it hold a fixed share of the table in one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = vw.read(spark, sf, "orders").repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey")
    orders.selectExpr("concat(o_orderkey, ',', o_totalprice, ',', o_orderstatus) as value").write.text(path)
    lines = scan_log(spark, path).selectExpr("file", "line_no", "cast(split(line, ',')[0] as bigint) as key")
    placed = running(lines, ["file"], "key", ["key", "line_no"], {"place": F.lit(1)}, slim=True)
    return placed.select("key", (F.col("line_no") - F.col("place")).cast("bigint").alias("off"))


@query(
    dk.with_fx(
        "select distinct concat(commit_id, '-', ref_pos, '-', class_pos, '/before/', string_split(old_path, '/')[-1]) as path, concat('b', event_id, ' ', message) as text from inst "
        "union all select concat(commit_id, '-', ref_pos, '-', class_pos, '/after/', string_split(new_path, '/')[-1]), concat(commit_id, ' ', message) from inst"
    ), prepare=True)
def archive_files(spark, sf):
    """The texts of the archive as files of their own, and read back."""
    folder = f"{shared_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    texts = source_archive(spark, sf)
    write_files(texts.selectExpr("concat(commit_id, '-', ref_pos, '-', class_pos, '/', side, '/', file_name) as path", "text"), folder)
    return read_files(spark, folder)


@query("select concat('p', o_custkey % 5) as project, concat('src/O', o_orderkey, '.java') as path, o_totalprice as price from orders where o_custkey % 5 = 2 and o_orderkey in (select o_orderkey from orders where o_custkey % 5 = 2 order by 1 limit 3)")
def find_files(spark, sf):
    """A state of one file for each order, and three of them looked up."""
    path = f"{shared_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    state = vw.read(spark, sf, "orders").selectExpr("concat('p', o_custkey % 5) as project", "concat('src/O', o_orderkey, '.java') as path", "o_totalprice as price", "o_orderkey")
    write_state(state.drop("o_orderkey"), path)
    keys = [r.path for r in state.filter("project = 'p2'").orderBy("o_orderkey").limit(3).collect()]
    return look_up(spark, path, "p2", [*keys, "src/none.java"]).select("project", "path", "price")


# --- tables kept up to date in place --------------------------------------------

STORED_ROWS = "concat('p', o_custkey % 7) as project, o_orderkey as id, o_totalprice as price, 'first' as origin"
STORED_UPDATES = (
    "concat('p', o_custkey % 7) as project, case when o_orderkey % 11 = 0 then -1 - o_orderkey else o_orderkey end as id, "
    "o_totalprice + 1 as price, case when o_orderkey % 11 = 0 then 'added' else 'changed' end as origin"
)
UPDATED = "o_custkey % 7 < 4 and (o_orderkey % 5 = 0 or o_orderkey % 11 = 0)"


def _stored(spark, name, rows, keys) -> StoredTable:
    table = StoredTable(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", rows.schema, keys)
    table.overwrite(rows)
    return table


@query(
    f"with r as (select {STORED_ROWS} from orders), u as (select {STORED_UPDATES} from orders where {UPDATED}) "
    "select * from u union all select r.* from r anti join u on r.project = u.project and r.id = u.id"
)
def merge_instances(spark, sf):
    """Every order stored by customer group; some are changed, some added, and whole groups stay as they are."""
    orders = vw.read(spark, sf, "orders")
    table = _stored(spark, "merged", orders.selectExpr(*vw.split(STORED_ROWS)), ["project", "id"])
    table.merge(orders.filter(UPDATED).selectExpr(*vw.split(STORED_UPDATES)))
    return table.read()


FACTS = "concat('p', o_custkey % 7) as project, l_orderkey * 8 + l_linenumber as id, l_partkey as class_metrics"


@query(
    f"with f as (select {FACTS} from lineitem join orders on l_orderkey = o_orderkey), "
    "gone as (select class_metrics from f group by 1 having bool_and(project in ('p0', 'p3', 'p6'))) "
    "select 'fact' as what, project, id from f where project not in ('p0', 'p3', 'p6') "
    "union all select 'metrics', concat('p', p_partkey % 7), p_partkey from part where p_partkey not in (select class_metrics from gone) "
    "union all select 'project', concat('p', x), x from (values (1), (2), (4), (5)) v(x)"
)
def delete_unfinished(spark, sf):
    """Lines are facts, their parts the metrics they point to; every third project never finished. Read back after the delete."""
    lines = vw.read(spark, sf, "lineitem").join(vw.read(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    facts = _stored(spark, "facts", lines.selectExpr(*vw.split(FACTS)), ["project", "id"])
    metrics = _stored(spark, "metrics", vw.read(spark, sf, "part").selectExpr("concat('p', p_partkey % 7) as project", "p_partkey as id"), ["id"])
    groups = vw.read(spark, sf, "orders").selectExpr("o_custkey % 7 as id").distinct()
    projects = _stored(spark, "projects", groups.selectExpr(
        "concat('p', id) as project", "cast(id as bigint) as id", "case when id % 3 > 0 then timestamp '2024-01-01 00:00:00' end as finishedDate"
    ), ["project"])
    stored.delete_unfinished([facts], {"class_metrics": metrics}, projects)
    tables = {"fact": facts, "metrics": metrics, "project": projects}
    rows = [t.read().select(F.lit(what).alias("what"), "project", "id") for what, t in tables.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "with ev as (select *, event_type = 'signup' and event_id % 3 = 0 as lab, concat('src/F', user_id, '.java') as path from events), "
    "seg as (select *, row_number() over w as n, sum(cast(lab as int)) over w as labs from ev window w as (partition by user_id order by event_id)), "
    "pos as (select *, row_number() over (partition by user_id, labs order by event_id) as m from seg) "
    "select path, concat('c', event_id) as stable_commit, (m - 1) % 5 + 1 as fired, n - ((m - 1) % 5 + 1) as base_n "
    "from pos where (m - 1) % 5 + 1 in (2, 5)",
    "stream_file_state",
)
def _stream_file_state(spark, sf):
    """The event table read as a stream: one project, one commit per event, no renames."""
    schema = vw.read(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    label = "event_type = 'signup' and event_id % 3 = 0"
    phases = f"explode(case when {label} then array(0, 1, 4) else array(0, 4) end) as phase"
    log = rows.selectExpr("*", phases, f"{label} as is_label").selectExpr(
        "'p' as project",
        "case when phase > 0 then concat('src/F', user_id, '.java') end as path",
        "cast(null as string) as old_path",
        "event_id + 1 as walk_pos",
        "phase",
        "0L as pos",
        "concat('c', event_id) as commit_id",
        # the marker counts the other rows of the commit
        "case phase when 0 then if(is_label, 2L, 1L) when 1 then 1L else 0L end as resets",
        "0 as clears",
        "case when phase = 4 then concat('a', event_id % 13) end as author",
        "case when phase = 4 then cast(floor(value) as bigint) else 0L end as added",
        "0L as deleted",
        "0 as is_bug",
        "0 as ends",
    )
    folder = f"{shared_dir(spark).rstrip('/')}/tracker-{uuid.uuid4().hex}"
    running = stream_file_state(log, folder, CUTS)
    running.awaitTermination()
    return results(spark, folder, "stable").select(
        "path", "stable_commit", F.col("fired").cast("bigint").alias("fired"), F.col("base_n").cast("bigint").alias("base_n")
    )
