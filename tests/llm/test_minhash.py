import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codehist.llm import minhash as M
from codehist.llm.graph import components
from codehist.llm.queries import DUCK, SPARK
from codehist.session import tables_made
from tests.compare import difference, duck

WORD = re.compile("[^ \t\n\v\f\r]+")


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent=80):
    """Component of each row: the smallest doc_id that links lead to."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        component = (min(ids) if ids else None) if sets[i] else doc_id
        out.append((str(doc_id), len(sets[i]), component, doc_id == component))
    return sorted(out, key=str)


def near_copies(rng, n, base_size=60, edits=(0, 1, 2, 4, 6, 8)):
    base = [f"w{rng.randrange(500)}" for _ in range(base_size)]
    rows = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice(edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        rows.append(" ".join(words))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "SET_BLOCK", 5)
    rng = random.Random(k)
    texts = near_copies(rng, 80) + near_copies(rng, 40, 150) + near_copies(rng, 20, 12, (0, 1, 2))
    texts += [None, "", " \n", "One", "one", "ONE two", "one  two", "É é", texts[0], texts[0], "a b c d", "a b c D", "w " * 40_000, "w\t" * 39_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[90]), (None, texts[5]), (None, "nobody else has this"), (7, None)]
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, sig int, node binary").repartition(5)
    got = M.near_duplicates(docs, k=k).collect()
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows, k)

    kept = M.one_of_each(docs, k=k)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {c for _, n, c, _ in brute(rows, k) if n}
    assert len([t for _, t in kept if shingles(t, k)]) == len(groups | {None}) and len([t for _, t in kept if not shingles(t, k)]) == 4


def test_all_links_of_a_crowd_whose_members_are_just_alike(spark, monkeypatch):
    """Few pairs are similar enough, so most links are found outside the leader's component."""
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = random.Random(9)
    texts = near_copies(rng, 120, 80, (2, 3, 3, 3, 4))
    rows = list(enumerate(texts))
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    want = brute(rows, 2)
    assert 5 < len({c for _, _, c, _ in want}) < 115
    assert sorted(((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got), key=str) == want


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates_agree_and_come_near(spark):
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, np.uint64)
    for share in (0.3, 0.66, 0.8, 0.95):
        n = int(1000 * 2 * share / (1 + share))
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:n], pool[2000 : 3000 - n]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (M.packed(M.minima(s)) for s in (a, b))
        guess = M.estimates(x[None], y[None])[0, 0]
        assert abs(guess - true) < M.MARGIN
        df = spark.createDataFrame([(x.view(np.int64).tolist(), y.view(np.int64).tolist())], "x array<long>, y array<long>")
        assert df.select(M.estimate(F.col("x"), F.col("y"))).first()[0] == pytest.approx(guess)


def test_shingles_of_a_batch():
    texts = ["a b c", None, "a", "A B C", "b c", " a  b\n"]
    sets = M.shingle_sets(pa.array(texts), 2)
    assert [len(s) for s in sets] == [len(shingles(t, 2)) for t in texts]
    assert sets[0].tolist() == sets[3].tolist() and sets[4][0] in sets[0] and sets[5][0] in sets[0] and sets[2][0] not in sets[0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {n: v for n, v in label.items() if n in got} and set(label) - set(got) <= {a for a, b in edges if a == b}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("edges, rounds", [([(1, k) for k in range(2, 30)] + [(40, 41)], 0), ([(1, 2), (2, 3)], 1)])
def test_rounds_end_as_soon_as_all_components_are_stars(spark, edges, rounds):
    with tables_made() as made:
        got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 40 if n >= 40 else 1 for e in edges for n in e}
    assert len(made) == 2 + rounds  # the edges, each round, the result


def test_query_equals_sql(spark):
    assert difference(spark, duck("/root/testdata/sf0.001"), "/root/testdata/sf0.001", SPARK["op2_minhash"], DUCK["op2_minhash"]) == ""


def test_words_whose_polynomials_meet(spark):
    """Two words that share nothing, but whose polynomials modulo 2^64 agree in any odd base."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, one), (4, f"{one} {other}"), (5, f"{other} {one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in M.near_duplicates(docs, 2).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
