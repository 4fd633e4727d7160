import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codehist.llm import spelling as M
from codehist.llm.queries import SPARK

SF = "/root/testdata/sf0.001"


def plain_counts(rows, shortest=6, damaged=199):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if damaged and h % damaged == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= shortest:
                out[word] += 1
    return out


def plain_variants(counts, ratio=5):
    """Near words by putting a blank between or in place of code points."""
    by_blank = {}
    for w in counts:
        for k in range(len(w) + 1):
            by_blank.setdefault(("in", w[:k] + "\0" + w[k:]), []).append(w)
            if k < len(w):
                by_blank.setdefault(("in", w[:k] + "\0" + w[k + 1 :]), []).append(w)
    near = {w: set() for w in counts}
    for group in by_blank.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w, others in near.items():
        # a blank in both words at once is two edits unless one length or one place differs
        others = {o for o in others if one_edit(w, o)}
        near[w] = others
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def rows_of(seed, n=300):
    rng = random.Random(seed)
    stems = ["colour", "Straßen", "naïveté", "ÀÉÎÕÜß", "analyse", "programme", "theatre", "abababab", "aaaaaaa", "÷×÷×÷×÷", "mississippi"]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.choice([0, 1, 20, 100])):
            w = list(rng.choice(stems))
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "é", "z"])
            out.append("".join(w))
        rows.append((i, rng.choice([" ", ", ", "1", "Ā", "Ł", "漢"]).join(out)))
    rows += [(None, "Colour colour " * 30), (5, None), (5, ""), (5, "theatre"), (5, "theatre"), (n, "word" * 50_000), (n + 1, "word" * 50_000 + "s "), (n + 2, "x" * 70 + " " + "x" * 71)]
    return rows


@pytest.mark.parametrize("damaged", [199, 3, None])
def test_counts(spark, damaged):
    rows = rows_of(1)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = {r.word: r.n for r in M.word_counts(docs, damaged=damaged).collect()}
    assert got == plain_counts(rows, damaged=damaged)


@pytest.mark.parametrize("seed", [0, 1])
def test_variants(spark, seed):
    rng = random.Random(seed)
    words = {w for w in plain_counts(rows_of(seed, 100), damaged=3) if len(w) < 100} if seed else set()
    while len(words) < 3000:
        words.add("".join(rng.choices("abé😀" if seed else "ab", k=rng.choice([6, 7, 8, 9, 10, 11, 12, 13]))))
    counts = {w: rng.choice([5, 5, 7, 25, 30, 125, 700, 3125, 20_000, 10**6]) for w in words}
    got = M.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(counts)


def test_long_chain_and_empty_table(spark):
    word = list("aaaaaaaaaaaa")
    counts = {"".join(word): 5}
    for k in range(12):
        word[k] = "b"
        counts["".join(word)] = 5 ** (k + 2)
    rows = M.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r.root for r in rows} == {"b" * 12} and sum(r.form is None for r in rows) == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.variants(M.word_counts(none)).collect() == []


def test_very_long_words(spark):
    words = {"word" * 50_000: 5, "word" * 50_000 + "s": 50, "ward" + "word" * 49_999: 400, "x" * 70: 6}
    rows = {r.word: (r.form, r.n_near) for r in M.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    long, longer, other, x = words
    assert rows == {long: (other, 2), longer: (None, 1), other: (None, 1), x: (None, 0)}


def test_crc32():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    begins = np.sort(rng.integers(0, 4000, 500))
    ends = begins + rng.integers(0, 130, 500)
    start = np.array([zlib.crc32(str(k).encode()) for k in range(500)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(begins, ends, start)]
    assert M.crc32_of(data, begins, ends, start).tolist() == want


def test_query_on_its_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = {w: n for w, n in plain_counts(rows).items() if n >= 5}
    got = {tuple(r) for r in SPARK["op11_spelling"](spark, SF).collect()}
    assert got == plain_variants(counts) and any(f for _, f, *_ in got)


def test_pairs_of_a_large_family(spark):
    words = {f"prefixes{i:04d}".translate(str.maketrans("0123456789", "abcdefghij")): 5 for i in range(3000)}
    got = {(r.word, r.near) for r in M.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert all(one_edit(a, b) and a < b for a, b in got)
    # three digits may each become nine others, the first one two
    assert len(got) == 3000 * (3 * 9 + 2) // 2
