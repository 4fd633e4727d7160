import math
import random

import pytest
from pyspark.sql import functions as F

from codehist.llm import mixing as M
from codehist.llm.queries import SPARK

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, source string, slot string, n_chars long"


def poured(sizes: dict, weights=M.WEIGHTS, share=M.MIX_SHARE, copies=M.MOST_COPIES) -> dict:
    """Targets by pouring: spread what is left by weight over sources that are not full, until nothing is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = dict.fromkeys(order, 0.0), share * sum(sizes.values())
    while left > 1e-9 and (open_ := [s for s in order if out[s] < copies * sizes[s] - 1e-9]):
        unit, left = left / sum(weight[s] for s in open_), 0.0
        for s in open_:
            out[s] += unit * weight[s]
            over = max(0.0, out[s] - copies * sizes[s])
            out[s] -= over
            left += over
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 1000, 30_000]) for i in range(rng.randint(1, 9))} | ({None: 77} if seed % 2 else {})
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in M.source_targets(rows).collect()}
    want = poured(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def test_points_mirror_the_binary_digits(spark):
    got = {r.k: r.u for r in spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 6, 2**20 + 1)], "k long").select("k", M.corput(F.col("k")).alias("u")).collect()}
    for k, u in got.items():
        assert u == sum(((k >> j) & 1) / 2 ** (j + 1) for j in range(40))


def mixed(spark, rows, **how):
    return M.mix(spark.createDataFrame(rows, COLUMNS).repartition(3), **how).collect()


def texts(n, seed=0):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 3, 40, 200, 900]), rng.choice(["hot", "hot", "hot", "b", "c", None]), "x", 1) for i in range(n)]
    return rows + [(n, None, "b", None, None), (None, "no id", "c", "y", 2), (1, "same text", "hot", "x", 1), (1, "same text", "hot", "x", 1), (n + 1, "z " * 9000, "hot", "x", 0)]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_every_slot_is_filled_once_and_in_order(spark, block, monkeypatch):
    monkeypatch.setattr(M, "RANGE", 50)
    rows = texts(120)
    got = mixed(spark, rows, block=block)
    sizes = {}
    for _, t, s, _, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = poured(sizes)
    taken, per_slot, per_row = {}, {}, {}
    for r in got:
        key = (r.no, r.bucket, r.place, r.doc_id, r.size)
        per_row.setdefault(key, 0)
        if r.slot is not None:
            assert 0 <= r["first"] and r["first"] + r.words <= r.size and r.words > 0
            taken[r.source] = taken.get(r.source, 0) + r.words
            per_slot[r.slot] = per_slot.get(r.slot, 0) + r.words
            per_row[key] += r.words
    assert len(per_row) == len(rows)
    assert all(n <= 2 * key[4] for key, n in per_row.items())
    n_slots = math.ceil(sum(want.values()) / block)
    assert set(per_slot) <= set(range(n_slots)) and all(n <= block for n in per_slot.values())
    for s, target in want.items():
        assert abs(taken.get(s, 0) - target) <= 8 * block
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows, block=block)))


def test_nothing_to_mix(spark):
    assert mixed(spark, []) == []
    got = mixed(spark, [(1, None, "a", None, None), (2, " ", None, None, None)])
    assert [(r.slot, r.size, r.target) for r in got] == [(None, 0, 0.0)] * 2


def test_documents_of_the_mix(spark):
    rows = texts(60, 5)
    docs = spark.createDataFrame(rows, COLUMNS)
    out = M.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    out = out.collect()
    taken = {}
    for r in M.mix(docs, block=8).where("slot is not null").collect():
        taken[(r.doc_id, r.size)] = taken.get((r.doc_id, r.size), 0) + r.words
    whole = {}
    for i, t, _, _, _ in rows:
        whole.setdefault(i, []).append(t or "")
    words = {}
    for r in out:
        assert any(t.startswith(r.text) for t in whole[r.doc_id]) and r.n_chars == len(r.text)
        size = next(len(t.split()) for t in whole[r.doc_id] if t.startswith(r.text))
        words[(r.doc_id, size)] = words.get((r.doc_id, size), 0) + len(r.text.split())
    assert words == taken


def test_query_comes_near_the_targets(spark):
    rows = SPARK["op3_mixing"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        target, size, taken = by.get(r.source, (r.target, 0, 0))
        by[r.source] = (target, size + r.size, taken + r.taken)
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * sum(s for _, s, _ in by.values()))
    want = poured({s: n for s, (_, n, _) in by.items()})
    for s, (target, size, taken) in by.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= 4 * M.BLOCK
