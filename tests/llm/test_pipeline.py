"""Every stage worked out by brute force on its own input."""

import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as P
from codehist.llm import mixing
from codehist.llm.queries import DUCK
from codehist.llm.tables import staged, table
from tests.llm.test_minhash import brute as groups
from tests.llm.test_mixing import poured
from tests.llm.test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(staged(stage(spark, out[-1], SF)))
    return [(df.columns, df.collect()) for df in out]


def test_stages(steps):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "minhash", "suffix_dedup", "mixing", "piece_bpe"]
    assert all(columns == steps[0][0] for columns, _ in steps[:-1])


def test_quality_rules(steps):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = con.execute(f"select doc_id from ({DUCK['op6_quality_rules']}) where kept").fetchall()
    assert sorted(r.doc_id for r in steps[1][1]) == sorted(r[0] for r in rows)
    whole = {r.doc_id: r for r in steps[0][1]}
    assert all(r == whole[r.doc_id] for r in steps[1][1])


def test_one_of_each_group(steps):
    rows = [(r.doc_id, r.text) for r in steps[1][1]]
    assert sorted(r.doc_id for r in steps[2][1]) == sorted({c for _, n, c, _ in groups(rows, 5)})


def test_repeats_are_cut(steps):
    rows = steps[2][1]
    want = {}
    for r, marks in zip(rows, repeats([r.text for r in rows]), strict=True):
        want[r.doc_id] = bytes(np.frombuffer(r.text.encode(), np.uint8)[~marks]).decode("utf-8", "ignore")
    got = {r.doc_id: r for r in steps[3][1]}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert any(len(want[r.doc_id]) < len(r.text) for r in rows)


def test_sources_come_near_their_targets(steps):
    rows = {r.doc_id: r for r in steps[3][1]}
    sizes, taken = {}, {}
    for r in rows.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in steps[4][1]:
        assert rows[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for source, target in poured(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 4 * mixing.BLOCK
    assert max(sum(1 for r in steps[4][1] if r.doc_id == i) for i in rows) == 2


def test_pieces(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    want = sorted((r.doc_id, r.text) for r in steps[4][1])
    assert sorted((r.doc_id, r.text) for r in steps[5][1]) == want
    for r in steps[5][1]:
        assert r.ids == library.encode(r.text) and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_run_is_the_stages_in_turn(spark, steps):
    rows = P.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.ids_crc32) for r in steps[5][1])


def test_no_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = staged(stage(spark, docs, SF))
        assert docs.count() == 0
