import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codehist.llm import language_id as L
from codehist.llm import quality_model as Q
from codehist.llm.queries import SPARK
from codehist.llm.tables import fold, table
from tests.llm.test_rules_and_archives import COMPLEMENT, THUE_MORSE, plain_stats

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = SPARK["op10_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == table(spark, SF, "documents").count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang == r.lang_pred for r in held if r.lang]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de", 1.0) for i in range(40)]
    rows += [(100, None, "en", 1.0), (101, "", "de", 1.0), (102, "12 34 ?!", "en", 1.0), (None, "the dog and the cat", "en", 1.0), (103, "the dog", None, 1.0), (103, "the dog", None, 1.0), (104, "Ω" * 50, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.fit(docs, F.col("doc_id").isNull() | (F.col("doc_id") < 100))
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in L.predict(docs, model, ["doc_id"]).collect()]
    assert len(got) == len(rows)
    by = dict((g[0], g) for g in got)
    assert all(by[k][1] == "und" and by[k][2] == 0 and by[k][3] for k in (100, 101, 102))
    assert by[103][1] == "en" and by[None][1] == "en" and by[1][1] == "en" and by[0][1] == "de"
    assert by[104][1] in ("de", "en") and by[104][3]
    empty = L.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in L.predict(docs, empty, ["doc_id"]).collect()} == {"und"}
    assert L.predict(docs.limit(0), model, ["doc_id"]).collect() == []


def test_document_frequencies_count_all_rows(spark):
    docs = spark.createDataFrame([(i, "abc abc") for i in range(30)] + [(99, "xyz")], "doc_id long, text string")
    n, df = L.document_frequencies(docs.repartition(4))
    assert n == 31 and sorted(df[df > 0].tolist())[-1] == 30


def test_centroids_are_spread():
    x = np.eye(6)[[0, 0, 0, 1, 1, 2]]
    c = L.clustered(x, 3)
    assert sorted(c.argmax(1).tolist()) == [0, 1, 2]
    assert len(L.clustered(x[:2], 4)) == 2


def test_quality_of_held_out_documents(spark):
    got = SPARK["op9_quality_model"](spark, SF).join(table(spark, SF, "labels"), "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.quality is not None]
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.3)).astype(float)
    model = Q.fit_rules(x, y, list("abcd"))
    total = model.bias + sum(w * Q.holds(r, list("abcd"), x) for r, w in model.rules)
    assert ((total > 0) == (y > 0)).mean() > 0.98
    heaviest = max(model.rules, key=lambda r: abs(r[1]))[0]
    assert {name for name, _, _ in heaviest} <= {"a", "c"}
    assert len(model.rules) < len(Q.tree_rules(x, y, list("abcd"))) / 2


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.random((500, 2))
    model = Q.fit_rules(x, (x.sum(1) > 1).astype(float), ["a", "b"])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").withColumn("s", model.column())
    for r in df.collect():
        total = model.bias + sum(w * bool(Q.holds(rule, ["a", "b"], np.array([[r.a, r.b]]))[0]) for rule, w in model.rules)
        assert r.s == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (None, "some words", 2), (3, "x " * 70_000, 2), (3, "same", 2), (3, "same", 2)], "doc_id long, text string, y int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    x, y = Q.labelled_sample(docs, none, "quality")
    assert x.shape == (0, len(Q.features())) and len(y) == 0
    got = Q.score(docs, Q.fit_rules(x, y, list(Q.features()))).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    x, y = Q.labelled_sample(docs, labels, "quality")
    assert y.tolist() == [1, 1, 1, 1]
    assert Q.score(docs.limit(0), Q.fit_rules(x, y, list(Q.features()))).collect() == []


# -- plain Python over whole tables ------------------------------------------------------------------------------------------------------------------------


def plain_more_stats(text):
    text = text or ""
    words = re.findall("[^ \t\n\v\f\r]+", text)
    return [
        len(text.encode()), text.count("\n") + (text != ""), len(re.findall("[0-9]", text)), len(re.findall("[A-Z]", text)), len(re.findall("[.,;:!?]", text)),
        len(set(words)), sum(a == b for a, b in zip(words, words[1:])),
    ]


def plain_features(text):
    s = dict(zip((*Q.STATS, *Q.EXTRA), plain_stats(text) + plain_more_stats(text), strict=True))

    def share(a, b):
        return s[a] / max(s[b], 1)

    return [
        float(s["n_words"]), share("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_digits", "n_bytes"),
        share("n_upper", "n_bytes"), share("n_points", "n_bytes"), share("n_distinct", "n_words"), share("n_again", "n_words"), share("n_words", "n_lines"), share("n_bytes", "word_chars"),
    ]


def test_statistics_of_random_texts():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b", "B", " ", " ", "\n", "7", ",", "é", "\t"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += [None, "", "\n", f"{THUE_MORSE} {COMPLEMENT}", f"{THUE_MORSE} {THUE_MORSE}"]
    stats = Q.more_stats(pa.array(texts))
    for k, t in enumerate(texts):
        assert [int(stats[s][k]) for s in Q.EXTRA] == plain_more_stats(t), repr(t)


def test_quality_scores_by_plain_python(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").where(F.coalesce(fold("doc_id", 3) != 1, F.lit(True)))
    x, y = Q.labelled_sample(docs.select("doc_id", "text"), labels, "quality")
    model = Q.fit_rules(x, y, list(Q.features()))
    names = list(Q.features())
    got = {r.doc_id: r.score for r in Q.score(docs.select("doc_id", "text"), model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and len(model.rules) > 0
    for r in rows:
        at = dict(zip(names, plain_features(r.text), strict=True))
        total = model.bias + sum(w for rule, w in model.rules if all((at[f] > cut) == above for f, above, cut in rule))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def plain_trigrams(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    raw = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw) + b" "
    return Counter((((raw[i - 1] << 16 | raw[i] << 8 | raw[i + 1]) * 0x9E3779B1) & 0xFFFFFFFF) >> 20 for i in range(1, len(raw) - 1) if raw[i] != 32)


def test_nearest_centroid_by_dictionaries(spark):
    small = "/root/testdata/sf0.001"
    docs = table(spark, small, "documents").select("doc_id", "text", "lang")
    rows = docs.collect()
    model = L.fit(docs, fold("doc_id", 4) != 2)
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None]
    held = Counter(g for r in learned for g in plain_trigrams(r.text))
    idf = {g: math.log((1 + len(learned)) / (1 + held[g])) + 1 for g in range(L.DIM)}
    assert np.allclose(model.idf, [idf[g] for g in range(L.DIM)])
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4) and max(Counter(model.langs).values()) <= L.CLUSTERS
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model, ["doc_id"]).collect()}
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id] == ("und", 0)
            continue
        x = {g: (1 + math.log(k)) * idf[g] for g, k in plain_trigrams(r.text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        near = [sum(v * float(c[g]) for g, v in x.items()) / max(norm, 1e-12) for c in model.centroids]
        assert got[r.doc_id][1] == pytest.approx(max(near), abs=1e-4)
        assert max(n for n, lang in zip(near, model.langs) if lang == got[r.doc_id][0]) > max(near) - 1e-5
