"""Spelling variants: each word's rare near-misspellings are tied to the frequent word they differ from by one code point.

Words are counted in whole texts with numpy, a few megabytes at a time, so that what leaves a task is one row per word of a piece, not per occurrence.

Near words are found by asymmetric chunks. The longer word of a pair (of equal ones the smaller) contributes two disjoint chunks, its halves; the other contributes the positional grams that can be equal to them.
One edit leaves one of the two chunks whole, and moves it by one place at most: the first half stays where it is, the second stays at the end. The same holds once more for what is beside
the chunk that stayed: of its two halves, one is whole. So a key is a chunk and one chunk of the rest, about three quarters of the word, at fixed places from begin or end. Words of a key
differ in one quarter of their letters only, which keeps the groups small; the join itself verifies each pair by edit distance, and only verified pairs leave it.

A word's form is the most frequent near word, if that is ``ratio`` times as frequent. Counts grow by ``ratio`` with each step, so chains are short, and
pointer jumping needs as many rounds as the logarithm of the longest one that the largest count allows.

Defined results: a null text has no words; a null doc_id counts as empty; rows that repeat count each; of near words with equal counts the smallest in code-point order is the form; an empty table has
no words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.llm.tables import staged, table
from codehist.llm.vectors import flat, lower_ascii, pieces, runs_of

SHORTEST, LEAST, RATIO, DAMAGED = 6, 5, 5, 199
#: Runs of more bytes have their crc32 worked out one by one; words of more code points are compared by their first difference.
LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def crc32_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from ``start`` (the crc32 of what comes before it)."""
    size = ends - begins
    out = np.empty(len(begins), np.uint32)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    n_long = int((size > LONG).sum())
    for k in order[:n_long]:
        out[k] = zlib.crc32(data[begins[k] : ends[k]].tobytes(), int(start[k]))
    order = order[n_long:]
    at, size, state = begins[order], size[order], ~start[order]
    for p in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -p))  # the spans that reach beyond p
        state[:n] = CRC[(state[:n] ^ data[at[:n] + p]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of [A-Za-z\\u00C0-\\u00FF] (the latter are all of 0xC3 and one byte more), and which of them go on with a code point."""
    low = data | 32
    lead = data == 0xC3
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = lead[:-1]
    return ((low >= 97) & (low <= 122)) | lead | goes_on, goes_on


def piece_counts(ids: list[int | None], column: pa.Array, shortest: int = SHORTEST, damaged: int | None = DAMAGED) -> tuple[pa.Array, pa.Array]:
    """Distinct words of some texts, and how often each occurs."""
    data, at = flat(column)
    inside, goes_on = letters(data)
    begins, ends, per = runs_of(inside, at)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(goes_on)])
    size = ends - begins - (before[ends] - before[begins])
    k = np.flatnonzero(size >= shortest)
    begins, ends, size, owner = begins[k], ends[k], size[k], np.repeat(np.arange(len(per)), per)[k]
    data = lower_ascii(data)
    extra: list[str] = []
    if damaged is not None and len(k):
        start = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        h = crc32_of(data, begins, ends, start[owner])
        hit = h % np.uint32(damaged) == 0
        for j in np.flatnonzero(hit & (size > shortest)):
            word, out = data[begins[j] : ends[j]].tobytes().decode(), int(h[j]) % int(size[j])
            extra.append(word[:out] + word[out + 1 :])
        begins, ends = begins[~hit], ends[~hit]
    mask = np.zeros(len(data) + 1, np.int8)
    mask[begins] += 1
    mask[ends] -= 1
    kept = data[np.cumsum(mask[:-1], dtype=np.int8).view(bool)]
    edges = np.concatenate([np.zeros(1, np.int32), np.cumsum(ends - begins, dtype=np.int32)])
    words = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(kept)])
    counted = pc.value_counts(pa.concat_arrays([words, pa.array(extra, pa.string())]))
    return counted.field("values"), counted.field("counts")


def word_counts(docs: DataFrame, shortest: int = SHORTEST, damaged: int | None = DAMAGED) -> DataFrame:
    """word, n: all words of at least ``shortest`` code points. One of ``damaged`` words of a document (chosen by crc32; None: none) loses a code point first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            words, n = piece_counts(batch.column("doc_id").to_pylist(), batch.column("text"), shortest, damaged)
            yield pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _keys(word: Column, own: Column, other: Column) -> Column:
    """Keys of a word of ``own`` code points as if it were paired with one of ``other`` code points that contributes the chunks."""
    half = (other / 2).cast("int")
    first, second = (half / 2).cast("int"), ((other - half) / 2).cast("int")

    def begin(n: Column) -> Column:
        return F.substr(word, F.lit(1), n)

    def end(n: Column) -> Column:
        return F.substr(word, own - n + 1, n)

    def key(kind: str, left: Column, right: Column) -> Column:
        return F.concat(F.lit(kind), other.cast("string"), F.lit(":"), left, right)

    none = F.lit("")
    return F.array(
        key("a", begin(half + second), none),
        key("b", begin(half), end(other - half - second)),
        key("c", begin(first), end(other - half)),
        key("d", none, end(other - first)),
    )


def _one_edit(left: Column, right: Column) -> Column:
    """Whether two unequal texts, the left one not shorter, differ by one code point: in time and memory linear in their length, unlike ``levenshtein``."""
    differ = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: ~a.eqNullSafe(b))
    at = F.array_position(differ, True).cast("int")
    same = F.length(left) == F.length(right)
    return (F.length(left) - F.length(right) <= 1) & (F.substr(left, at + 1) == F.when(same, F.substr(right, at + 1)).otherwise(F.substr(right, at)))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: pairs of words that differ by one code point, once each."""
    own = F.length("word")
    chunks = words.select("word", "n", F.explode(_keys(F.col("word"), own, own)).alias("key"))
    grams = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(F.concat(_keys(F.col("word"), own, own), _keys(F.col("word"), own, own + 1))).alias("key"))
    once = (F.length("word") != F.length("near")) | (F.col("word") < F.col("near"))
    short = chunks.where(own <= LONG).join(grams.where(F.length("near") <= LONG), "key").where(once & (F.levenshtein("word", "near", 1) == 1))
    long = chunks.where(own > LONG).join(grams.where(F.length("near") >= LONG), "key").where(once & _one_edit(F.col("word"), F.col("near")))
    return short.unionByName(long).select("word", "n", "near", "near_n").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word (column word, each once, with its count n)."""
    pairs = staged(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    table = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    table = staged(table)
    roots = _roots(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), table.agg(F.max("n")).first()[0] or 1, ratio)
    return table.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(links: DataFrame, most: int, ratio: int) -> DataFrame:
    """Where the links (word to root) of each word end; a chain of counts up to ``most`` has fewer steps than its logarithm."""
    steps = max(1, math.ceil(math.log(max(most, 2), ratio)))
    for _ in range(math.ceil(math.log2(steps)) if ratio > 1 else 0):
        on = links.select(F.col("word").alias("at"), F.col("root").alias("on"))
        links = staged(links.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("on", "root").alias("root")))
    return links


def op11_spelling(spark, sf_dir) -> DataFrame:
    words = staged(word_counts(table(spark, sf_dir, "documents")).where(F.col("n") >= LEAST))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
