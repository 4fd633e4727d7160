import random

import pytest
from pyspark.sql import functions as F

from codehist.operators.events import EVENT_COLUMNS
from codehist.operators.exact import with_exact_cycles
from codehist.operators.history import closed_form_history, file_history
from codehist.operators.lineage import rename_lineage
from codehist.operators.process import author_stats, latest_state
from codehist.operators.stability import stable_files, stable_now
from codehist.session import staged

from tests.replay import Step, judge, replay


def random_log(seed, commits=400, files=6, renames=True, detector=False, hot=0.4, deletes=0.0):
    rnd = random.Random(seed)
    paths = [f"F{i}.java" for i in range(files)]
    log = []

    def add(pos, phase, i, path, **kw):
        e = dict(
            project="p", path=path, old_path=None, walk_pos=pos, phase=phase, pos=i,
            commit_id=f"c{pos}", resets=0, clears=0, author=None, added=0, deleted=0, is_bug=0, ends=0,
        )
        log.append(e | kw)

    for pos in range(1, commits + 1):
        pick = lambda: paths[0] if rnd.random() < hot else rnd.choice(paths)
        for path in sorted({pick() for _ in range(rnd.choice([0, 0, 0, 0, 1, 2]))}):
            add(pos, 1, 0, path, resets=rnd.choice([1, 1, 3]))
        if renames and rnd.random() < 0.12:
            for phase in [2] if detector and rnd.random() < 0.5 else [3]:
                for i in range(rnd.choice([1, 1, 2])):
                    old, new = rnd.sample(paths + ["G.java"], 2)
                    add(pos, phase, i, new, old_path=old, resets=int(phase == 3), clears=int(phase == 2))
        who = rnd.choice(["a"] * 12 + ["b"] * 5 + [f"x{rnd.randrange(40)}"] * 3)
        for i, path in enumerate(sorted({pick() for _ in range(rnd.choice([1, 1, 2, 3]))})):
            add(pos, 4, i, path, author=who, added=rnd.randrange(9), deleted=rnd.randrange(9),
                is_bug=rnd.randrange(2))
        if rnd.random() < deletes:
            add(pos, 5, 0, pick(), ends=1)
    return log


def check(spark, log, thresholds, block):
    events = spark.createDataFrame(log, EVENT_COLUMNS)
    events = staged(rename_lineage(events, block))
    history = staged(author_stats(file_history(events, thresholds, authors=True, block=block), block))
    labels, fired, states, files = replay(log, thresholds)
    rows = history.collect()
    got = sorted((r.commit_id, r.path, r.n, r.refactorings - (r.fired == max(thresholds)))  # before the end of a cycle counts
                 for r in rows if r.phase == 4)
    assert got == sorted(states)
    got = []
    for r in rows:
        if r.phase == 1:
            for i in range(r.resets):
                got.append((r.commit_id, r.path, (
                    r.n, r.lines_added, r.lines_deleted, r.bug_fixes, r.refactorings - r.resets + i,
                    r.authors, r.minor, r.major, round(r.ownership, 9))))
    assert sorted(got) == sorted(labels)
    stable = [
        (r.stable_commit, r.path, r.fired, r.base_commit, (
            r.base_n, r.lines_added, r.lines_deleted, r.bug_fixes, r.refactorings,
            r.authors, r.minor, r.major, round(r.ownership, 9)))
        for r in stable_files(history, thresholds).collect()
    ]
    assert sorted(stable) == sorted(fired)
    live = {(r.path, r.n, r.refactorings) for r in latest_state(history).collect()}
    assert live == {(p, t.metrics[0], t.metrics[4]) for p, t in files.items()}
    return history, files


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 64), (3, 1 << 16)])
def test_windows_equal_replay_without_renames(spark, seed, block):
    check(spark, random_log(seed, renames=False), (3, 8), block)


@pytest.mark.parametrize("seed,block", [(4, 5), (5, 50), (6, 1 << 16)])
def test_windows_equal_replay_with_renames(spark, seed, block):
    history, files = check(spark, random_log(seed), (2, 5), block)
    now = {r.path for r in stable_now(history, (2, 5)).collect()}
    assert now == {p for p, t in files.items() if t.place == 2}


@pytest.mark.parametrize("seed,block", [(8, 6), (9, 40), (10, 1 << 16)])
def test_renames_that_forget_the_fired_threshold(spark, seed, block):
    log = random_log(seed, detector=True)
    for e in log:
        if e["phase"] == 1 and e["walk_pos"] % 3:
            e["resets"] = 0
    check(spark, [e for e in log if e["phase"] != 1 or e["resets"]], (2, 5, 6), block)


@pytest.mark.parametrize("seed,block", [(11, 6), (12, 40), (13, 1 << 16)])
def test_deleted_files_are_gone(spark, seed, block):
    log = random_log(seed, deletes=0.1)
    history, files = check(spark, log, (2, 5), block)
    live = [r.path for r in latest_state(history).collect()]
    assert sorted(live) == sorted(files) and len(set(live)) == len(live)
    now = {r.path for r in stable_now(history, (2, 5)).collect()}
    assert now == {p for p, t in files.items() if t.place == 2}


def test_late_cycle(spark):
    change = dict(project="p", path="B", old_path=None, phase=4, pos=0, resets=0, clears=0,
                  author="a", added=0, deleted=0, is_bug=0, ends=0)
    log = [change | dict(path="A", walk_pos=i, commit_id=f"c{i}") for i in range(1, 8)]
    log.append(change | dict(old_path="A", phase=2, clears=1, author=None, walk_pos=8, commit_id="c8"))
    log += [change | dict(walk_pos=i, commit_id=f"c{i}") for i in range(8, 14)]
    for block in (3, 100):
        history, _ = check(spark, log, (3, 8, 9), block)
        fired = [(r.n, r.fired) for r in history.orderBy("n", "phase").collect() if r.fired]
        assert fired == [(3, 3), (8, 3), (9, 8), (10, 9), (13, 3)]


def test_long_streaks_and_minor_authors(spark):
    log = random_log(7, commits=900, files=2, renames=False, hot=0.9)
    for e in log:
        if e["phase"] == 1:
            e["resets"] = 0
    log = [e for e in log if e["phase"] != 1]
    check(spark, log, (20, 50), 37)


@pytest.mark.parametrize("seed,block,chain", [(21, 6, 1), (22, 40, 3), (23, 1 << 16, 5), (24, 1 << 16, 1 << 12)])
def test_segments_equal_replay(spark, seed, block, chain):
    """Every file by segments, whose chains are cut into blocks of few commits; renames forget often, so counts run beyond the largest threshold."""
    rnd = random.Random(seed)
    log = [e for e in random_log(seed, commits=300, files=3, renames=False) if e["phase"] == 4 or rnd.random() < 0.1]
    log = [e for e in log for e in ([e] if e["phase"] == 1 or rnd.random() < 0.75 else [e | dict(phase=2, old_path=e["path"], resets=0, clears=1, author=None, added=0, deleted=0, is_bug=0), e])]
    cuts = (2, 5, 6, 9)
    events = staged(spark.createDataFrame(log, EVENT_COLUMNS).withColumn("lineage", F.col("path")))
    history = staged(closed_form_history(events, cuts, block=block))
    out = with_exact_cycles(history, cuts, block, chain=chain)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    states, steps = {}, {}
    for e in log:
        mine = steps.setdefault(e["path"], [])
        mine += [Step("reset", e["commit_id"])] * e["resets"] if e["phase"] == 1 else [Step("forget" if e["phase"] == 2 else "change", e["commit_id"])]
        now = judge(mine, cuts)
        states[e["path"], e["walk_pos"], e["phase"], e["pos"]] = (now.place, now.fired, now.refactorings + (now.fired == max(cuts)))  # the end of a cycle counts
    got = {(r.path, r.walk_pos, r.phase, r.pos): (r.since_base, r.fired, r.refactorings) for r in out.collect()}
    assert got == states and any(p > max(cuts) for p, _, _ in states.values())


def test_small_files_are_not_cut(spark, monkeypatch):
    """A file that is one block has the totals it has in many, beside files that are cut, and without a name."""
    log = random_log(31, commits=250, files=5, renames=False, hot=0.5)
    events = staged(spark.createDataFrame(log, EVENT_COLUMNS).withColumn("lineage", F.expr("nullif(path, 'F1.java')")))
    sizes = [r["count"] for r in events.groupBy("lineage").count().orderBy("count").collect()]
    assert sizes[0] < 70 < sizes[-1]
    get = lambda **how: sorted(map(repr, author_stats(staged(closed_form_history(events, (3, 8), authors=True, block=16, **how)), 16).collect()))
    whole = get()
    assert len(whole) == len(log) and get(uncut=70) == whole and get(uncut=10_000) == whole
    monkeypatch.setattr("codehist.operators.history.FEW", 2)  # too many files for names: all are cut
    assert get(uncut=1) == whole


def test_totals_of_small_files_need_one_shuffle(spark):
    """Neither sums of blocks, nor rows dealt again for the windows of authors and steps."""
    log = staged(spark.createDataFrame(random_log(32, renames=False), EVENT_COLUMNS).withColumn("lineage", F.col("path")))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
    history = closed_form_history(log, (3, 8), authors=True, uncut=1000)
    assert exchanges(history) == 1
    plan = author_stats(staged(history))._jdf.queryExecution().executedPlan().toString()
    # rows are dealt once, sums of steps (a row for each file and block) and blocks twice
    assert plan.count("Exchange hashpartitioning(") <= 4 and "s#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
