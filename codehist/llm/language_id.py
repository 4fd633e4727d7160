"""Language of a text by its nearest centroid.

A text becomes a vector of byte trigrams of its letters (lower case, all else a space), hashed into ``DIM`` places: 1 + log of the count, times the inverse document
frequency, normalised. Each language has several centroids, from spherical k-means on a bounded sample of its documents; a text gets the language of the centroid
with the largest cosine. A text less similar to its centroid than nearly all of the sample was to theirs is marked as rejected.

Document frequencies count every row that may be learned from. What is collected are frequencies (``DIM`` numbers) and centroids (``CLUSTERS`` per language).

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected, as are all texts if there is nothing to learn from; a row without
language or doc_id is scored but not learned from; repeated rows count as often as they occur; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.llm.tables import fold, table
from codehist.llm.vectors import flat, lower_ascii, pieces

DIM = 4096
CLUSTERS = 4
#: Documents per language that k-means sees.
SAMPLE = 400
#: Share of the sample that is less similar to its centroid than the limit of rejection.
REJECT = 0.001
#: Rows per dense matrix.
ROWS = 512
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True


def trigram_counts(column: pa.Array) -> np.ndarray:
    """A row per text: how often each hashed trigram occurs. Trigrams whose middle is no letter, or that reach over a text's edge, don't count."""
    data, at = flat(column)
    n = len(at) - 1
    out = np.zeros((n, DIM), np.int64)
    for k in range(n):
        text = lower_ascii(data[at[k] : at[k + 1]])
        row = np.full(len(text) + 2, 32, np.uint8)
        row[1:-1] = np.where(LETTER[text], text, 32)
        if len(text):
            for a in range(0, len(text), 1 << 20):
                part = row[a : a + (1 << 20) + 2].astype(np.uint32)
                code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
                code = code[part[1:-1] != 32] * np.uint32(0x9E3779B1)
                out[k] += np.bincount(code >> np.uint32(32 - 12), minlength=DIM)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def has_letter(column: pa.Array) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in (x.as_py() for x in column)], bool)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; begins with the mean's farthest row and then the row farthest from all centres so far, so runs agree."""
    mean = x.mean(0)
    centres = x[[int(np.argmin(x @ mean))]]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[int(np.argmin((x @ centres.T).max(1)))]])
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        centres = np.vstack([x[nearest == j].mean(0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Model:
    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    limit: float


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and rows that hold each trigram; sums of a task are added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIM, np.int64)
        for batch in pieces(batches):
            for a in range(0, len(batch), ROWS):
                counts = trigram_counts(batch.column("text").slice(a, ROWS))
                n, df = n + len(counts), df + (counts > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(df, n))], names=["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in rows:
        out[r.place] = r.n
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, learn: Column, clusters: int = CLUSTERS, sample: int = SAMPLE, reject: float = REJECT) -> Model:
    """Learn from the rows of (doc_id, text, lang) for which ``learn`` holds."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    n, df = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1

    # a number per language, as in the model itself: the sample is chosen where the texts are, before any shuffle
    rows_of = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows_of:
        return Model([], np.zeros((0, DIM), np.float32), idf, 0.0)
    limits = F.create_map(*(F.lit(x) for lang, rows in sorted(rows_of.items()) for x in (lang, float(1 << 30) * 1.5 * sample / rows)))
    key = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    chosen = known.withColumn("key", key).where(F.col("key") < F.element_at(limits, F.col("lang")))

    def centres(rows):
        import pandas as pd

        rows = rows.sort_values(["key", "doc_id", "text"]).head(sample)
        x = np.vstack([vectors(trigram_counts(pa.array(rows["text"][a : a + ROWS], pa.string())), idf) for a in range(0, len(rows), ROWS)])
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "near": []})
        c = clustered(x, clusters)
        near = float(np.quantile((x @ c.T).max(1), reject))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": list(c.astype(float)), "near": near})

    found = chosen.groupBy("lang").applyInPandas(centres, "lang string, centroid array<double>, near double").collect()
    found.sort(key=lambda r: (r.lang, r.centroid))
    matrix = np.array([r.centroid for r in found], np.float32).reshape(len(found), DIM)
    return Model([r.lang for r in found], matrix, idf, min((r.near for r in found), default=0.0))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns to keep, lang_pred, score (the cosine) and rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN])
        for piece in pieces(batches):
            for a in range(0, len(piece), ROWS):
                batch = piece.slice(a, ROWS)
                near = np.zeros((len(batch), 1)) if not model.langs else vectors(trigram_counts(batch.column("text")), model.idf) @ model.centroids.T
                best = near.argmax(1)
                readable = has_letter(batch.column("text")) & bool(model.langs)
                score = np.where(readable, np.clip(near.max(1), 0, 1), 0).astype(float)
                found = names[np.where(readable, best, len(model.langs))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in keep), pa.array(found, pa.string()), pa.array(score), pa.array(~readable | (score < model.limit))],
                    names=[*keep, "lang_pred", "score", "rejected"],
                )

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["lang_pred string, score double, rejected boolean"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op10_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, fold("doc_id", 4) != 2)
    scored = predict(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
