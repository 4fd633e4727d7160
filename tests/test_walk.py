import random

import pytest

from codehist.operators import walk
from codehist.session import staged, tables_made

COMMITS = "project string, commit_id string, parents array<string>, time long"


def graph(rnd, n, merges, skew):
    """Commits in the order of creation; new ones grow from recent tips, some merge two of them."""
    rows = []
    for i in range(n):
        old = rows[-12:]
        parents = [] if not old else [rnd.choice(old)[0] if rnd.random() < 0.1 else rows[-1][0]]
        if old and rnd.random() < merges:
            parents.append(rnd.choice(old)[0])
        rows.append((f"c{i:04d}", parents, 10 * i + (rnd.randrange(-200, 200) if rnd.random() < skew else 0)))
    return rows


def plain(rows, head):
    """eff and depth of all that the head holds, children first."""
    by, eff, depth = {c: (ps, t) for c, ps, t in rows}, {}, {}
    eff[head], depth[head] = by[head][1], 0
    for c, ps, _ in reversed(rows):
        if c in eff:
            for p in ps:
                if p in by and p != c:
                    eff[p] = min(eff.get(p, by[p][1]), by[p][1], eff[c])
                    depth[p] = max(depth.get(p, 0), depth[c] + 1)
    return eff, depth


@pytest.mark.parametrize("seed, merges, skew", [(1, 0.0, 0.0), (2, 0.1, 0.4)])
def test_walk_of_random_graphs(spark, seed, merges, skew):
    rnd = random.Random(seed)
    graphs = {p: graph(rnd, n, merges, skew) for p, n in (("a", 160), ("b", 70), ("c", 1))}
    heads = {"a": graphs["a"][-1][0], "b": graphs["b"][50][0], "c": "c0000"}
    rows = [(p, *r) for p, g in graphs.items() for r in g] + [("nowhere", "c1", ["c2"], 1)]
    rows = [(p, c, [*ps, "gone", c] if c.endswith("7") else ps, t) for p, c, ps, t in rows]
    commits = staged(spark.createDataFrame(rows, COMMITS).repartition(5))
    top = spark.createDataFrame(list(heads.items()), "project string, commit_id string")
    found = walk.reachable_commits(commits, top).collect()
    walked = {(r.project, r.commit_id): r.walk_pos for r in walk.commit_walk(commits, top).collect()}
    for p, g in graphs.items():
        eff, depth = plain(g, heads[p])
        assert {r.commit_id: (r.eff, r.depth) for r in found if r.project == p} == {c: (eff[c], depth[c]) for c in eff}
        order = sorted(eff, key=lambda c: (eff[c], -depth[c], c))
        assert [walked.pop((p, c)) for c in order] == list(range(1, len(order) + 1))
        at = {c: k for k, c in enumerate(order)}
        assert all(at[q] < at[c] for c, ps, _ in g if c in at for q in ps)
    assert not walked


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A run of 3,000 commits, a branch and its merge every ten of them, and an unmerged run of 500."""
    rounds = []
    monkeypatch.setattr(walk, "staged", lambda df: rounds.append(1) or staged(df))
    rows = []
    for i in range(3000):
        parents = {3: [i - 1], 4: [i - 1], 5: [i - 3], 6: [i - 1, i - 2]}.get(i % 10, [i - 1]) if i else []
        rows.append(("p", f"m{i}", [f"m{q}" for q in parents], i))
    rows += [("p", f"u{i}", [f"u{i - 1}" if i else "m100"], i) for i in range(500)]
    commits = staged(spark.createDataFrame(rows, COMMITS))
    links = walk.branch_links(commits, spark.createDataFrame([("p", "m2999")], "project string, commit_id string"))
    assert links.count() == 2999 and len(rounds) <= 24


def test_no_commits(spark):
    none = spark.createDataFrame([], COMMITS)
    assert walk.commit_walk(none, none.select("project", "commit_id")).collect() == []


def test_rounds_hold_no_texts(spark):
    """Links are numbers while they are shortened; names come back at the end."""
    n = 40
    rows = [("p", f"c{i}", [f"c{i - 1}"] if i else [], i) for i in range(n)]
    commits = spark.createDataFrame(rows, "project string, commit_id string, parents array<string>, time long")
    heads = spark.createDataFrame([("p", f"c{n - 1}")], "project string, commit_id string")
    with tables_made() as paths:
        found = walk.branch_links(commits, heads).collect()
    assert {(r.x, r.cap, r.hops) for r in found} == {(f"c{i}", i, n - 1 - i) for i in range(n - 1)}
    rounds = [s for s in (spark.read.parquet(p).schema for p in paths) if "hops" in s.names]
    assert len(rounds) > 3 and not any(f.dataType.simpleString() == "string" for s in rounds for f in s.fields)
