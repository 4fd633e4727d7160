import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codehist.llm import suffix_dedup as S
from codehist.llm.queries import SPARK
from codehist.llm.vectors import flat

W = S.WINDOW


def brute(texts):
    """Repeated bytes of each text, window by window."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + W] for r in raws for i in range(len(r) - W + 1))
    out = []
    for r in raws:
        marks = np.zeros(len(r), bool)
        for i in range(len(r) - W + 1):
            if seen[r[i : i + W]] > 1:
                marks[i : i + W] = True
        out.append(marks)
    return out


def digest(raw, marks):
    kept = bytes(np.frombuffer(raw, np.uint8)[~marks]) if len(raw) else b""
    n_spans = int((np.diff(np.concatenate([[0], marks.astype(int)])) == 1).sum())
    return len(raw), int(marks.sum()), n_spans, hashlib.sha256(kept).hexdigest()


def rows_like_op1(spark, tmp_path, rows, columns="doc_id long, text string, s int, spans string"):
    folder = tmp_path / "sf"
    folder.mkdir()
    spark.createDataFrame(rows, columns).repartition(4).write.parquet(str(folder / "documents.parquet"))
    got = SPARK["op1_suffix_dedup"](spark, str(folder)).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def check(spark, tmp_path, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    want = sorted((str(i), *digest((t or "").encode(), m)) for i, t, m in zip(ids, texts, brute(texts), strict=True))
    assert rows_like_op1(spark, tmp_path, [(i, t, 7, "x") for i, t in zip(ids, texts, strict=True)]) == want


def noise(rng, n, letters="abcdefgh ij\né"):
    return "".join(rng.choice(letters) for _ in range(n))


def passages(rng, n_texts):
    """Texts with shared passages of lengths around a window, some of them cut or changed in one place."""
    shared = [noise(rng, rng.choice([150, 199, 200, 201, 230, 500, 1500])) for _ in range(8)]
    texts = []
    for _ in range(n_texts):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            cut = rng.randrange(len(p))
            parts += [noise(rng, rng.randrange(300)), rng.choice([p, p, p[cut:], p[:cut], p[:cut] + "X" + p[cut + 1 :]])]
        texts.append("".join(parts) + noise(rng, rng.randrange(50)))
    return texts


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_equals_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(hot)
    texts = passages(rng, 60)
    texts += [None, "", "short", "a" * 199, "a" * 450, "ab" * 300, "a" * 450, noise(rng, 200_000), texts[3], texts[3]]
    hot_line = noise(rng, 260)
    texts += [noise(rng, 90) + hot_line + noise(rng, 90) for _ in range(30)]
    ids = [None, *range(1, len(texts))]
    ids[-1] = ids[-2] = 5
    check(spark, tmp_path, texts, ids)


def test_all_rounds_are_sorted_at_once(spark, tmp_path, monkeypatch):
    calls, real = [], S.sort_stretches
    monkeypatch.setattr(S, "HOT", 2)
    monkeypatch.setattr(S, "sort_stretches", lambda rows: calls.append(1) or real(rows))
    rng = random.Random(8)
    line = noise(rng, 260)
    check(spark, tmp_path, [noise(rng, 90) + line + noise(rng, 90) for _ in range(30)] + [line, line])
    assert len(calls) == 1


def test_filters_come_by_few_jobs(spark):
    """Not by one for each partition."""
    sc = spark.sparkContext
    h = [5, -7, 2**62, S.FILTER_BITS + 5, 123_456_789]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("filters", "filters")
    try:
        bits = S.filter_of(spark.createDataFrame([(x,) for x in h], "h long"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert S.in_filter(bits, np.array(h).view(np.uint64)).all() and np.unpackbits(bits).sum() == 4
    assert len(sc.statusTracker().getJobIdsForGroup("filters")) <= 3


def test_empty_table(spark, tmp_path):
    assert rows_like_op1(spark, tmp_path, []) == []


def test_all_texts_empty(spark, tmp_path):
    check(spark, tmp_path, [None, "", None])


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *digest((r.text or "").encode(), m)) for r, m in zip(docs, brute([r.text for r in docs]), strict=True))
    got = SPARK["op1_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_equal_windows_name_equal_anchors(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 700)
    rng = random.Random(1)
    p = noise(rng, 900, "abcdef")
    texts = [noise(rng, 333, "abcdef") + p, p + noise(rng, 100, "abcdef"), "x" * 1000]
    data, at = flat(pa.array(texts))
    named = {}
    starts = []
    for text, s, e, a, h, _ in S.anchors(data, at):
        for k in range(len(s)):
            for i in range(s[k], e[k] + 1):
                window = data[i : i + W].tobytes()
                starts.append((int(text[k]), i))
                assert named.setdefault(window, (a[k] - i, int(h[k]))) == (a[k] - i, int(h[k]))
    assert sorted(starts) == [(d, i) for d in range(3) for i in range(at[d], at[d + 1] - W + 1)]


def test_mergesort_of_suffixes():
    rng = random.Random(2)
    raws = [noise(rng, rng.randrange(220, 400), "ab").encode() for _ in range(40)] + [b"a" * 500, b"ab" * 200]
    block = S.Block(raws)
    base = np.cumsum([0, *map(len, raws)])
    places = np.concatenate([np.arange(base[k], base[k + 1] - W + 1) for k in range(len(raws))])
    rng_np = np.random.default_rng(3)
    places = rng_np.permutation(places)
    group = np.sort(rng_np.integers(0, 9, len(places)))
    order = block.sort(places, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    raw = block.data.tobytes()
    for g in range(9):
        own = order[group == g]
        assert sorted(own) == sorted(places[group == g])
        keys = [raw[p : p + W] for p in own]
        assert keys == sorted(keys)
    count = Counter((g, raw[p : p + W]) for g, p in zip(group, places, strict=True))
    assert block.repeated(places, group).tolist() == [count[g, raw[p : p + W]] > 1 for g, p in zip(group, places, strict=True)]


def test_hashes_that_meet_are_seen(monkeypatch):
    raws = [bytes([97 + k]) * W for k in range(4)] + [b"a" * W]
    block = S.Block(raws)
    monkeypatch.setattr(block, "extension", lambda i, j: np.full(len(i), W))
    places = np.arange(0, 5 * W, W)
    assert block.repeated(places, np.zeros(5, int)).tolist() == [True, False, False, False, True]


def test_cut_documents_keeps_columns_and_whole_characters(spark):
    rng = random.Random(4)
    p = "é" + noise(rng, 300) + "é"
    rows = [(1, "ñ" + p + " end", "a", None), (2, "ß" + p + "ü", None, 3), (3, None, "b", 1), (4, "clean text", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, spans long")
    got = {r.doc_id: r for r in S.cut_documents(docs).collect()}
    assert S.cut_documents(docs).columns == docs.columns
    assert got[3].text is None and got[4].text == "clean text" and got[2].spans == 3 and got[1].t == "a"
    assert got[1].text == "ñ end" and got[2].text == "ßü"
