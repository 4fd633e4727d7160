import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codehist.llm import line_dedup as M
from codehist.llm.cuckoo import Cuckoo
from codehist.llm.queries import SPARK

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, slots string, n_lines string"


def key_of(line):
    key = line.strip(" \t\n\v\f\r")
    key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
    return key if len(key) >= 10 else None


def plain_cut(rows):
    """rows of (doc_id, text): what is left of each, lines, dropped lines."""
    held = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key_of(line), set()).add(M.NO_ID if doc_id is None else doc_id)
    held.pop(None, None)
    out = []
    for doc_id, text in rows:
        mine = M.NO_ID if doc_id is None else doc_id
        lines = (text or "").split("\n")
        stay = [x for x in lines if key_of(x) not in held or min(held[key_of(x)]) == mine]
        out.append((doc_id, "\n".join(stay) if len(stay) < len(lines) else text, len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def texts(seed, first, n):
    rng = random.Random(seed)
    shared = ["A line that many hold", "  a LINE that many hold\t", "ÀÉÎ ten code", "àéî ten code", "short one", "exactly 10", "É234567890", "É23456789", "\x1fa line that many hold", "", " \r"]
    shared += [f"passage number {i}" for i in range(40)]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"own line {seed} {i} {j} {rng.random()}" for j in range(rng.choice([0, 1, 3, 12, 60]))]
        rows.append((first + i, "\n".join(lines)))
    rows += [(first, rows[0][1]), (first, rows[0][1]), (first + 1, "a line that many hold"), (None, "passage number 3\nnull id here"), (None, "null id here"), (first + n, None), (first + n + 1, "")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], COLUMNS).repartition(3)


def cut(index, spark, rows):
    out = index.cut(frame(spark, rows)).collect()
    assert not out or out[0].asDict().keys() == {"doc_id", "text", "slots", "n_lines", "n_dropped"}
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out), key=repr)


@pytest.mark.parametrize("settings", [{}, {"per_shard": 40, "hot_least": 10**9}, {"per_shard": 7, "hot_least": 3}])
def test_added_and_deleted_documents(spark, tmp_path, settings):
    index = M.LineIndex(spark, str(tmp_path / "lines"), **settings)
    held = texts(1, 100, 60)
    index.insert(frame(spark, held))
    assert cut(index, spark, held) == plain_cut(held)
    # earlier ids than those that are there: lines move to them
    more = texts(2, 10, 40)
    index.insert(frame(spark, more))
    held += more
    assert cut(index, spark, held) == plain_cut(held)
    gone = [10, 12, 13, 15, 100, 101, 120, 4711, None]
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    held = [r for r in held if r[0] not in gone]
    assert cut(index, spark, held) == plain_cut(held)
    # as if they had never been there: the same exact counts, and a filter that holds the shared keys
    fresh = M.LineIndex(spark, str(tmp_path / "fresh"))
    fresh.insert(frame(spark, held))
    assert sorted(index.counts().collect()) == sorted(fresh.counts().collect())
    again = M.LineIndex(spark, str(tmp_path / "lines"), **settings)
    assert (again.version, again.shards) == (3, index.shards)
    back = [r for r in texts(1, 100, 60) if r[0] == 101]
    again.insert(frame(spark, back))
    assert cut(again, spark, held + back) == plain_cut(held + back)


def test_unfinished_version_does_not_count(spark, tmp_path):
    index = M.LineIndex(spark, str(tmp_path))
    rows = texts(3, 0, 20)
    index.insert(frame(spark, rows))
    index._write(index.counts().withColumn("n", F.lit(99).cast("long")), "counts", 2)
    index._write(index.refs(), "refs", 2)
    again = M.LineIndex(spark, str(tmp_path))
    assert again.version == 1 and cut(again, spark, rows) == plain_cut(rows)


def test_empty_tables(spark, tmp_path):
    index = M.LineIndex(spark, str(tmp_path))
    none = frame(spark, [])
    index.insert(none)
    assert cut(index, spark, []) == []
    index.delete(none)
    rows = texts(4, 0, 10)
    index.insert(frame(spark, rows))
    assert cut(index, spark, rows) == plain_cut(rows)


def test_hot_line_and_thousands_of_equal_rows(spark, tmp_path):
    rows = [(i, f"the line of every text\nown line of text {i}") for i in range(3000)] + [(7, "equal rows\nthe line of every text")] * 3000
    index = M.LineIndex(spark, str(tmp_path), hot_least=100)
    index.insert(frame(spark, rows))
    assert len(index.hot()) == 1 and cut(index, spark, rows) == plain_cut(rows)


def test_long_text(spark, tmp_path):
    rows = [(1, "\n".join(f"line number {i % 50_000}" for i in range(120_000))), (2, "line number 77\nx" + "y" * 3_000_000), (0, "LINE number 49999")]
    index = M.LineIndex(spark, str(tmp_path))
    index.insert(frame(spark, rows))
    assert cut(index, spark, rows) == plain_cut(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 20_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    hashes = rng.integers(0, 1 << 64, n, np.uint64)
    hashes[: n // 10] = hashes[n // 10 : 2 * (n // 10)]
    f = Cuckoo.sized(n)
    f.add(hashes[: n // 2])
    f.add(hashes[n // 2 :])
    f = Cuckoo.read(*f.written())
    assert f.has(hashes).all()
    assert f.has(rng.integers(0, 1 << 64, 20_000, np.uint64)).mean() < 0.002
    f.remove(hashes[::2])
    assert f.has(hashes[1::2]).all()
    f.remove(hashes[1::2])
    assert not f.table.any() and not len(f.stash)


def test_cuckoo_filter_that_overflows():
    hashes = np.random.default_rng(0).integers(0, 1 << 64, 300, np.uint64)
    f = Cuckoo.sized(10)
    f.add(hashes)
    assert len(f.stash) and f.has(hashes).all()
    f.remove(hashes[:150])
    assert f.has(hashes[150:]).all()
    f.remove(hashes[150:])
    assert not f.table.any() and not len(f.stash)


def test_query_on_its_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, n, d, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, n, d in plain_cut(rows)}
    assert {tuple(r) for r in SPARK["op13_line_dedup"](spark, SF).collect()} == want
