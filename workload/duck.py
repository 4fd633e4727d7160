"""DuckDB side of the comparison: the same tables as common table expressions,
and the tracker replayed one event at a time with a recursive query."""

from __future__ import annotations

from codehist.schemas import ALL_CLASSES, LABEL_TYPES, LEVEL_CODES
from workload.views import EVENT_SQL, SOURCES_SQL, TYPES, _metric_sql

TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
LEVEL_LIST = "[" + ", ".join(str(LEVEL_CODES[n]) for n, ts in LABEL_TYPES.items() for _ in ts) + "]"
ALL_SQL = "(" + ", ".join(f"'{t}'" for t in ALL_CLASSES) + ")"

FX = f"""
fx0 as (select props, {EVENT_SQL} from events),
fx as (select *, cast(sum(cast(is_rename as int)) over (partition by user_id order by event_id) as bigint) as ver from fx0),
chg as (select *, case when is_rename then 'RENAME' else 'MODIFY' end as change_type,
        concat(stem, ver - cast(is_rename as int), '.java') as old_path, concat(stem, ver, '.java') as new_path from fx),
lab0 as (select chg.*, r.ref_pos, (event_id + 7 * r.ref_pos) % 45 as type_no
         from chg join (values (0), (1)) r(ref_pos) on r.ref_pos <= case when is_label then event_id % 2 else 0 end
         where is_label or (is_rename and event_id % 2 = 0)),
lab as (select *, case when is_rename then 'RENAME_CLASS' else coalesce(({TYPE_LIST})[type_no + 1], 'UNKNOWN_TYPE') end as type,
        case when is_rename then 1 else coalesce(({LEVEL_LIST})[type_no + 1], -1) end as level,
        concat('Label ', type_no) as display_name, concat('Label ', type_no, ' on user ', user_id) as summary,
        concat('pkg.', case when event_id % 11 = 0 then 'f' else 'F' end, user_id) as class0,
        concat('pkg.F', user_id, '.Inner') as class1,
        concat('pkg.F', user_id, case when is_rename then 'R' else '' end) as class_after,
        concat('e', event_id % 5) as element_name
        from lab0),
cls as (select *, 0 as class_pos, class0 as class from lab where level > 0
        union all select *, 1 as class_pos, class1 as class from lab where type in {ALL_SQL}),
tgt as (select * from cls where n_parents = 1 and not (class_pos = 0 and event_id % 11 = 0)),
inst as (select *, case when level in (2, 3) then event_id % 3 end as meth from tgt
         where level not in (2, 3) or event_id % 3 < event_id % 4)
"""


def with_fx(body: str, *ctes: str) -> str:
    return f"with recursive {', '.join([FX.strip(), *ctes])} {body}"


def events_cte(resets: str) -> str:
    """Event log per user (the true lineage); ``resets`` counts labels from a table."""
    return f"""
ev0 as (
  select user_id, walk_pos, 1 as phase, commit_id, any_value(project) as project, any_value(old_path) as path,
         count(*) as k, cast(null as varchar) as author, 0 as added, 0 as deleted, 0 as bug from {resets} group by user_id, walk_pos, commit_id
  union all
  select user_id, walk_pos, case when event_id % 2 = 0 and n_parents = 1 then 2 else 3 end, commit_id, project, new_path,
         case when event_id % 2 = 0 and n_parents = 1 then 0 else 1 end, null, 0, 0, 0 from chg where is_rename and n_parents <= 1
  union all
  select user_id, walk_pos, 4, commit_id, project, new_path, 0, author, lines_added, lines_deleted,
         case when message like '%error%' then 1 else 0 end from chg where n_parents <= 1),
ev as (select *, row_number() over (partition by user_id order by walk_pos, phase) as rn,
       cast(sum(case when phase = 4 then 1 else 0 end) over w as bigint) as n, cast(sum(added) over w as bigint) as s_added,
       cast(sum(deleted) over w as bigint) as s_deleted, cast(sum(bug) over w as bigint) as s_bug
       from ev0 window w as (partition by user_id order by walk_pos, phase))"""


def replay_cte(thresholds) -> str:
    cuts, top = sorted(thresholds), max(thresholds)
    fire = " ".join(f"when s1 >= {t} and {t} > l1 then {t}" for t in cuts)
    return f"""
rep as (
  select user_id, cast(0 as bigint) as rn, cast(0 as bigint) as since, cast(0 as bigint) as last, cast(0 as bigint) as refs,
         cast(null as varchar) as base_commit, cast(0 as bigint) as base_n, cast(0 as bigint) as base_refs,
         cast(null as bigint) as fired, cast(null as varchar) as fire_base, cast(0 as bigint) as fire_n,
         cast(0 as bigint) as fire_refs, cast(0 as bigint) as counter, cast(0 as bigint) as seen_refs
  from (select distinct user_id from ev)
  union all
  select user_id, rn, case when f = {top} then 0 else s1 end, case when f = {top} then 0 else coalesce(f, l1) end,
         r1 + case when f = {top} then 1 else 0 end,
         case when k > 0 or f = {top} or rn = 1 then commit_id else base_commit end,
         case when k > 0 or f = {top} then n else base_n end,
         case when k > 0 then r1 when f = {top} then r1 + 1 else base_refs end,
         f, coalesce(base_commit, commit_id), base_n, base_refs, s1, r1
  from (select *, case when phase = 4 then case {fire} end end as f from (
    select rep.*  exclude (rn, fired, fire_base, fire_n, fire_refs, counter, seen_refs), ev.rn, ev.k, ev.phase, ev.commit_id, ev.n,
           case when ev.k > 0 then 0 when ev.phase = 4 then since + 1 else since end as s1,
           case when ev.k > 0 or ev.phase = 2 then 0 else last end as l1,
           refs + ev.k as r1
    from rep join ev on ev.user_id = rep.user_id and ev.rn = rep.rn + 1) a) b),
st as (select ev.*, rep.* exclude (user_id, rn) from rep join ev using (user_id, rn))"""


# author metrics of every change: counts of all authors up to it
AUTHORS = """
ach as (select user_id, n, author from ev where phase = 4),
acnt as (select a.user_id, a.n, b.author, count(*) as c from ach a join ach b on a.user_id = b.user_id and b.n <= a.n
         group by a.user_id, a.n, b.author),
aut as (select user_id, n, cast(count(*) as bigint) as authors,
        cast(count(*) filter (where c < n * cast(0.05 as double)) as bigint) as minor,
        cast(count(*) filter (where c >= n * cast(0.05 as double)) as bigint) as major,
        round(max(c) / cast(n as double), 6) as ownership from acnt group by user_id, n)"""

SOURCES = f"src as (select doc_id, text as raw, {SOURCES_SQL} from documents)"


def metric_columns(names, seed: str) -> str:
    return _metric_sql(names, seed)
