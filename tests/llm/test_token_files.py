import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from codehist.llm import token_files as T
from codehist.llm.vectors import flat
from codehist.llm.word_bpe import WordEncoder, WordIds, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", "don't we'll <|endoftext|>x", "x\x1cy z\xa0w", "é ́e İSTANBUL ΣΣ ﬁ", "tab\tnew\nline\r\n\x0b\x0c", "你好 123 #!? " + "z" * 5000,
    "<|startoftext|>", "Don't. Élan, ÀÉÎ!? straße... ×. ÷ a.b. ÿ; Ÿ. é́. A≠ :; 's. X'S. İ. x!́", "\U0001f600 \U0001f468‍\U0001f469", "i̇ ẛ̣", "word " * 3000,
]


def test_words_give_the_ids_of_the_library():
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    ids, counts = word_ids(PATH).texts([(t or "").encode() for t in texts])
    expected = [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_any_token_and_range(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    counts = np.bincount(rng.integers(0, 7, n), minlength=7)
    f = T.TokenFile(T.pack(np.arange(7), np.ones(7), counts, ids))
    assert f.tokens(0, n).tolist() == ids.tolist()
    assert [f.token(i) for i in range(n)] == ids.tolist()
    assert np.concatenate([f.document(k) for k in range(7)]).tolist() == ids.tolist()
    for a, b in rng.integers(0, n + 1, (20, 2)):
        assert f.tokens(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()


def rows_of(spark, docs, tmp_path, **more):
    files = T.write_token_files(docs, str(tmp_path / "ids"), PATH, **more)
    files = spark.createDataFrame(files.collect(), files.schema)
    out = T.read_token_files(spark, str(tmp_path / "ids")).join(T.file_starts(files), "file")
    return sorted((r.file_start + r.begin, r.doc_id, r.n_tokens, r.ids_crc32) for r in out.collect())


@pytest.mark.parametrize("file_ids", [1, 50, 1 << 20])
def test_files_hold_all_documents_in_order(spark, tmp_path, file_ids):
    texts = [None, *ODD, "same", "same"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "same", "x"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(5)
    got = rows_of(spark, docs, tmp_path, file_ids=file_ids)
    assert len(got) == len(rows)
    assert [g[1] for g in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    library = Tokenizer.from_file(PATH)
    expected = {}
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        expected.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for start, doc_id, n, crc in got:
        assert start == at and (n, crc) in expected[doc_id]
        at += n


def test_no_documents(spark, tmp_path):
    assert T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path), PATH).collect() == []


def test_query_over_the_whole_table(spark):
    from codehist.llm.queries import SPARK

    folder = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").to_pylist()
    library, expected, at = Tokenizer.from_file(PATH), [], 0
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        expected.append((d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = SPARK["op4_token_files"](spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected


def test_units_of_random_texts():
    """Words with capitals, points, signs and letters of other scripts, against the library on whole texts."""
    rng = random.Random(12)
    letters = ["a", "B", "é", "É", "ß", "À", "×", "÷", "Þ", "þ", "ÿ", ".", ",", "!", "'s", "7", " ", "\n", "\t", "Ā", "漢", "😀", "́", "#", "Ω", "\x1c", " "]
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(2000)] + [None, "", " ", "x" * 5000, "É" * 3000 + "...", "a.b", ".a", "a.,!a"]
    ids, counts = word_ids(PATH).of(*flat(pa.array(texts)))
    library = Tokenizer.from_file(PATH)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    few, none = word_ids(PATH).of(*flat(pa.array([], pa.string())))
    assert len(few) == len(none) == 0


def test_other_kinds_of_files_are_left_to_the_library():
    other = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  words", "", None, " x\n\ny"]
    ids, counts = word_ids(other).of(*flat(pa.array(texts)))
    want = [Tokenizer.from_file(other).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_of_a_piece_are_looked_up_once():
    """New words have one look at the table and ASCII letters none at the pattern; a second piece has the same ids."""

    class Table(dict):
        looks = 0

        def get(self, *a):
            self.looks += 1
            return super().get(*a)

        def __contains__(self, word):
            self.looks += 1
            return super().__contains__(word)

        def __getitem__(self, word):
            self.looks += 1
            return super().__getitem__(word)

    library = Tokenizer.from_file(PATH)
    words = WordIds(WordEncoder(library))
    texts = pa.array(["Some words, some more words.", None, "zzqqxv Some 12 \u00c9lan #a"])
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    for _ in range(2):
        words.number = Table(words.number)
        ids, counts = words.of(*flat(texts))
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert words.number.looks == len(words.number)
