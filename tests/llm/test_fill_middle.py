import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codehist.llm import fill_middle as M
from codehist.llm.queries import SPARK

SF = "/root/testdata/sf0.001"


def plain_result(doc_id, text, changed=90, spm=20):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or any(m in text for m in M.MARKERS) or h3 % 100 >= changed:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(5)
    alphabet = ["a", "\n", "\r", " ", "\u0085", "é", "é", "😀", "<", ">", "P", "S", "M", "$1", "\\", " ", "\x00", "漢"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.choice([1, 2, 3, 10, 60, 1023, 1024, 1025, 3000]))), "x") for i in range(400)]
    rows += [(400 + i, "".join(rng.choices(["<", "S", ">", "<S", "S>", "P>", "<M", "a"], k=rng.randint(1, 6))), "x") for i in range(400)]
    long = "".join(rng.choices(alphabet[:12], k=2_000_000)).replace("<", "")
    return rows + [(None, "no id", "x"), (7, None, None), (7, "", "x"), (5, "same", "x"), (5, "same", "x"), (900, long, "y"), (901, long, "y"), (-3, "negative", "z")]


def test_outputs_and_restored_texts(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, e, k) for k, (i, t, e) in enumerate(rows)], "doc_id long, text string, form string, k int").repartition(5)
    out = M.fill_in_middle(docs).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "form", "k", "n", "prefix_units", "middle_units", "output", "back"}
    forms = set()
    for r in out:
        doc_id, text, _ = rows[r.k]
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_result(doc_id, text)
        assert r.back == (text or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit, size", [(M.WORDS, lambda t: len(t.split()) + (t != t.rstrip(" \n"))), (M.LINES, lambda t: t.count("\n") + (not t.endswith("\n")))])
def test_other_units_tile_the_text(spark, unit, size):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices(["ab", " ", "\n", "c"], k=rng.randint(1, 4000)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = ("{pre}", "{suf}", "{mid}")
    with pytest.raises(ValueError, match="marker"):
        M.fill_in_middle(docs, markers=("<S>", "<S>", "<M>"))
    with pytest.raises(ValueError, match="marker"):
        M.fill_in_middle(docs, markers=("aba", "<S>", "<M>"))
    out = M.fill_in_middle(docs, unit, changed=100, suffix_first=50, markers=marks).withColumn("back", M.restored(F.col("output"), F.col("form"), marks)).collect()
    for r in out:
        text = dict(rows)[r.doc_id]
        assert r.n == size(text) and r.back == text and r.form != "plain" and sorted(r.output) == sorted(text + "".join(marks))


def test_empty_table_and_one_stage(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.fill_in_middle(none).collect() == []
    plan = SPARK["op12_fill_middle"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query_on_its_table(spark):
    want = {r.doc_id: plain_result(r.doc_id, r.text) + (r.text or "",) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in SPARK["op12_fill_middle"](spark, SF).collect():
        n, form, a, m, output, text = want.pop(r.doc_id)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (output, text)]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, m, *sha)
    assert not want
