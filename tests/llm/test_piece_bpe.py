import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from codehist.llm import piece_bpe as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    None, "", " ", "  ", "\n", "\n\n a", "a\n b  c \n", "   lead", "trail   ", "\t\ttab", "x\x00y", "你好🤗 ok", "\xa0a", "▁x ▁▁y", "<s>hi</s><0x41>",
    "é é ﬁ", "a" * 500, "ab" * 301 + " " + "the" * 200, " " * 40 + "x" + " " * 33, "word " * 2000, "\r\nline", "\U0010ffff z",
]


def encoded(texts):
    ids, counts = P.encoder(PATH).texts(pa.array(texts, pa.string()))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)], ids, counts


def check(texts):
    got, ids, counts = encoded(texts)
    assert got == [LIBRARY.encode(t or "") for t in texts]
    assert P.encoder(PATH).decode(ids, counts) == [LIBRARY.decode(g) for g in got]


def test_odd_texts_as_the_library():
    check(ODD)


def test_documents_as_the_library():
    check(pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  \n\tabcthe.ing▁é"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_any_text_as_the_library(texts):
    check(texts)


def test_a_long_unit_is_relaxed_like_short_ones(monkeypatch):
    texts = ["thethethe" * 9 + "intoand" * 5, "x" * 77]
    want, _, _ = encoded(texts)
    monkeypatch.setattr(P, "LONG", 3)
    P.encoder.cache_clear()
    assert encoded(texts)[0] == want
    P.encoder.cache_clear()


def test_suffix_array_and_occurrences():
    text = np.array(list(map(ord, "banana" * 7)), np.int64)
    order = P.suffix_array(text, 64)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    words = ["a", "ana", "nab", "x", "bananabanana", "z", "anan"]
    chars = np.full((len(words), 12), -1, np.int64)
    for k, w in enumerate(words):
        chars[k, : len(w)] = list(map(ord, w))
    lo, hi = P.occurrences(text, order, chars, np.array(list(map(len, words))))
    for k, w in enumerate(words):
        assert sorted(order[lo[k] : hi[k]]) == [i for i in range(len(text)) if "banana" * 7 and ("banana" * 7).startswith(w, i)]


def test_frames(spark):
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(None, "no id", 1), (3, "again", 2), (3, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = P.decode(P.encode(docs, PATH, ["doc_id"]), PATH, ["doc_id"]).collect()
    want = [(r[0], LIBRARY.decode(LIBRARY.encode(r[1] or "")), len(LIBRARY.encode(r[1] or ""))) for r in rows]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.text, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert P.encode(docs.limit(0), PATH, ["doc_id"]).collect() == []


def test_query_over_the_whole_table(spark):
    from codehist.llm.queries import SPARK

    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    got = SPARK["op8_piece_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(LIBRARY.encode(docs[r.doc_id]))


class Counted(dict):
    looks = 0

    def get(self, *a):
        self.looks += 1
        return super().get(*a)

    def __contains__(self, unit):
        self.looks += 1
        return super().__contains__(unit)

    def __getitem__(self, unit):
        self.looks += 1
        return super().__getitem__(unit)


def test_a_unit_is_looked_up_once_however_often_it_stands_there():
    encoder = P.Encoder(PATH)
    texts = ["the same words and the same words, " * 50, None, "the same\n" * 50]
    want = [LIBRARY.encode(t or "") for t in texts]
    for _ in range(2):
        encoder.table.number = Counted(encoder.table.number)
        ids, counts = encoder.texts(pa.array(texts))
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert encoder.table.number.looks == len(encoder.table.number) == 8


def test_only_ties_are_sorted_again(monkeypatch):
    rng = np.random.default_rng(8)
    text = rng.integers(97, 123, 20_000)
    sort, sizes = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda a, *b, **c: (sizes.append(len(a)), sort(a, *b, **c))[1])
    order = P.suffix_array(text, 16)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i : i + 64].tolist())
    assert sum(sizes) < 2 * len(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.sampled_from([1, 400, 0x43FFF]))
def test_occurrences_in_any_text(numbers, step):
    """Few and many letters: up to 63 of them go into one number, or a handful, and a piece takes several."""
    text = np.array(numbers, np.int64) * step
    full = np.append(text, np.arange(1000 if step == 400 else 0) + 5000)
    order = P.suffix_array(full, 16)
    words = [text[i : i + n].tolist() for i in range(0, len(text), 7) for n in (1, 2, 5, 9, 16)] + [[7, 7], [step * 3] * 16]
    chars = np.full((len(words), 16), -1, np.int64)
    for k, w in enumerate(words):
        chars[k, : len(w)] = w
    lo, hi = P.occurrences(full, order, chars, np.array(list(map(len, words))))
    for k, w in enumerate(words):
        assert sorted(order[lo[k] : hi[k]]) == [i for i in range(len(full)) if full[i : i + len(w)].tolist() == w]


BYTES = st.lists(st.sampled_from([b" ", b"  ", b"\n", b"a", b"the", b"\t", b"\xe2\x96\x81", "\u00e9".encode(), b"\xe2", b"\x96", b"\xff", b"\x81", b"\xf0\x9f", b"\xed\xa0\x80", b"\x00"]), max_size=12).map(b"".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(BYTES, min_size=1, max_size=5), st.booleans())
def test_units_and_broken_bytes(texts, gap):
    """A cast of binary columns gives texts of any bytes; each unit of them counts with replacement characters."""
    encoder = P.Encoder.__new__(P.Encoder)
    encoder.__dict__.update(P.encoder(PATH).__dict__)
    encoder.table = P.UnitIds(encoder.encode_units, gap)
    pattern = re.compile(rb" *[^ \n]+| +|\n" if gap else rb" *[^ ]+| +")
    want = [pattern.findall(b" " + t.replace(P.SPACE.encode(), b" ")) if t else [] for t in texts]
    column = pa.array(texts, pa.binary())
    coded, counts = encoder.table.cut(*P.flat(column))
    assert coded.to_pylist() == [u for w in want for u in w] and counts.tolist() == [len(w) for w in want]
    if gap:
        ids, n = encoder.texts(column)
        ends = np.concatenate([[0], np.cumsum(n)])
        for w, a, b in zip(want, ends[:-1], ends[1:], strict=True):
            assert ids[a:b].tolist() == LIBRARY.encode("".join(u.decode("utf-8", "replace") for u in w)[1:])
