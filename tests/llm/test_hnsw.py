import numpy as np
import pytest

from codehist.llm import hnsw as H
from codehist.llm.queries import SPARK

SF = "/root/testdata/sf0.01"


def nearest(ids, x, q_id, q, k):
    score = x.astype(float) @ q.astype(float)
    score[ids == q_id] = -np.inf
    order = np.lexsort([ids, -score])[: min(k, int((ids != q_id).sum()))]
    return ids[order].tolist(), score[order]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    found = {}
    for r in SPARK["op5_hnsw"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q_id, got in found.items():
        got.sort()
        want, score = nearest(ids, x, q_id, x[ids == q_id][0], 20)
        assert [r for r, _, _ in got] == list(range(1, len(want) + 1))
        true = {i: s for i, s in zip(ids.tolist(), x.astype(float) @ x[ids == q_id][0].astype(float), strict=True)}
        assert all(s == pytest.approx(true[i], abs=1e-12) and i != q_id for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits, total = hits + len({i for _, i, _ in got} & set(want)), total + len(want)
    assert hits / total >= 0.9


@pytest.mark.parametrize("kind", ["random", "lengths", "clusters"])
def test_recall_of_a_shard(kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    if kind == "lengths":
        x *= rng.lognormal(0, 0.7, (3000, 1)).astype(np.float32)
    if kind == "clusters":
        x = x * 0.2 + rng.normal(size=(15, 24)).astype(np.float32)[rng.integers(0, 15, 3000)]
    ids = rng.permutation(9000)[:3000]
    shard = H.Shard.load(H.Shard.build(ids, x).dump())
    q = rng.choice(3000, 100, replace=False)
    row, found, _ = shard.nearest(ids[q], x[q], 20, H.EF_SEARCH)
    hits = sum(len(set(found[row == i].tolist()) & set(nearest(ids, x, ids[k], x[k], 20)[0])) for i, k in enumerate(q))
    assert hits / 2000 >= 0.9


def test_links_are_flat_and_reach_every_node():
    x = H.Shard.scaled(np.random.default_rng(5).normal(size=(1500, 8)).astype(np.float32))
    g = H.Graph.build(x)
    assert g.links[0].shape == (1500, 2 * H.LINKS) and all((a.max(1)[g.heights < k] == -1).all() for k, a in enumerate(g.links))
    seen, todo = {g.entry}, [g.entry]
    while todo:
        for n in g.links[0][todo.pop()].tolist():
            if n >= 0 and n not in seen:
                seen.add(n)
                todo.append(n)
    assert len(seen) > 1480


def search(spark, tmp_path, rows, k=5, **size):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim string").repartition(3)
    index = H.build_index(df, str(tmp_path / "index"), **size)
    out = {}
    for r in H.search_index(df, index, str(tmp_path / "index"), k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 5)))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_rows_that_take_no_part_ties_and_repeats(spark, tmp_path):
    inf = float("inf")
    v = lambda i, *e: (i, list(e) if e != (None,) else None, 0, "x")
    rows = [v(1, 1.0, 0.0), v(2, 1.0, 0.0), v(3, 1.0, 0.0), v(3, 1.0, 0.0), v(4, -1.0, 0.5), v(5, 0.0, 0.0), v(6, None), v(7, 1.0, None), v(8, inf, 1.0), v(9, float("nan"), 1.0)]
    rows += [v(10, 2.0, 1.0, 0.0), v(11, 1.0, 1.0, 1.0), v(12), v(None, 1.0, 0.0)]
    got = search(spark, tmp_path, rows)
    assert got == {
        1: [(2, 1.0), (3, 1.0), (4, -1.0)], 2: [(1, 1.0), (3, 1.0), (4, -1.0)], 3: [(1, 1.0), (2, 1.0), (4, -1.0)], 4: [(1, -1.0), (2, -1.0), (3, -1.0)],
        10: [(11, 3.0)], 11: [(10, 3.0)],
    }


def test_many_shards_and_many_equal_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    x[100:250] = x[0]
    rows = [(i, e.tolist(), 0, "x") for i, e in enumerate(x)]
    got = search(spark, tmp_path, rows, shard_size=60)
    ids = np.arange(400)
    for q in range(400):
        want, score = nearest(ids, x, q, x[q], 5)
        assert [i for i, _ in got[q]] == want or np.allclose([s for _, s in got[q]], score, atol=1e-4)


def test_empty_table(spark, tmp_path):
    assert search(spark, tmp_path, []) == {}
