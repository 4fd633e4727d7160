"""Token ids in files with directly addressable codes.

Each id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those ids that have more, and so on; a bitmap
per level says which go on, and a rank directory counts the set bits before every 512th place. Any token is found by one look per level, without
decoding what stands before it.

A file: a JSON line (magic, sizes and places of all arrays), then the arrays: doc_ids (i8; 0 where named, u1, is 0: a null id), begins (i8, one more than
documents) and, per level, chunks (u1), bitmap (u1) and ranks (u4). Documents stand in ascending doc_id order, within a file and over the files in order of their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codehist.llm.tables import new_folder, staged, table
from codehist.llm.vectors import flat, give_back, pieces
from codehist.llm.word_bpe import word_ids

MAGIC = "directly-addressable-ids-1"
BITS, BLOCK = 8, 512
#: Ids per file before the next one begins.
FILE_IDS = 4 << 20
END_ID = 2


def pack(doc_ids: np.ndarray, named: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file with these documents, whose ids stand in a row."""
    arrays = [("doc_ids", doc_ids.astype("<i8")), ("named", named.astype("u1")), ("begins", np.concatenate([[0], np.cumsum(counts)]).astype("<i8"))]
    rest, level = ids.astype(np.uint32), 0
    while level == 0 or len(rest):
        more = rest >> np.uint32(BITS)
        on = more > 0
        each = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        arrays.append((f"chunks{level}", (rest & np.uint32((1 << BITS) - 1)).astype(np.uint8)))
        arrays.append((f"bitmap{level}", np.packbits(on, bitorder="little")))
        arrays.append((f"ranks{level}", np.concatenate([[0], np.cumsum(each)]).astype("<u4")))
        rest, level = more[on], level + 1
    places, at = {}, 0
    for name, a in arrays:
        places[name] = [a.dtype.str, at, len(a)]
        at += (a.nbytes + 7) // 8 * 8
    head = json.dumps({"magic": MAGIC, "levels": level, "ids": len(ids), "arrays": places}).encode() + b"\n"
    return head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for _, a in arrays)


class TokenFile:
    """Random access to a packed file; arrays are views on its bytes."""

    def __init__(self, content: bytes):
        stop = content.index(b"\n") + 1
        head = json.loads(content[:stop])
        if head["magic"] != MAGIC:
            raise ValueError("not a token file")
        self.levels, self.n = head["levels"], head["ids"]
        for name, (kind, at, n) in head["arrays"].items():
            setattr(self, name, np.frombuffer(content, kind, n, stop + at))
        self.parts = [tuple(getattr(self, f"{x}{k}") for x in ("chunks", "bitmap", "ranks")) for k in range(self.levels)]

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        first = a // 8
        return np.unpackbits(self.parts[level][1][first : (b + 7) // 8], bitorder="little")[a - 8 * first : b - 8 * first].astype(bool)

    def rank(self, level: int, i: int) -> int:
        """Set bits before place i: the directory, and at most one block of the bitmap."""
        block = i // BLOCK
        return int(self.parts[level][2][block]) + int(self._bits(level, block * BLOCK, i).sum())

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids from place a up to b."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for level in range(self.levels):
            if b <= a:
                break
            out[where] |= self.parts[level][0][a:b].astype(np.uint32) << np.uint32(BITS * level)
            on = self._bits(level, a, b)
            where, a = where[on], self.rank(level, a)
            b = a + len(where)
        return out

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.begins[k]), int(self.begins[k + 1]))


def put(folder: str, name: str, content: bytes) -> None:
    """Write a file whole or not at all; a task that runs again replaces it with the same bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/.{name}.{attempt}") as out:
        out.write(content)
    store.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts below ``folder``; the table of documents in them: part, file, n_tokens.

    Texts are dealt to tasks by ranges of doc_id and sorted there; ids are never shuffled. Null texts are empty: their only id is the end. A null
    doc_id comes first; documents that share an id stand in the order of their texts' hashes. No rows, no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, k = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            doc_ids, named, counts, ids = map(np.concatenate, zip(*held, strict=True))
            put(folder, name := f"part-{part:06d}-{k:06d}.ids", pack(doc_ids, named, counts, ids))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([len(ids)], pa.int64())], names=["part", "file", "ids"])

        for batch in pieces(batches, most=1 << 21):
            ids, counts = encoder.of(*flat(batch.column("text")))
            whole = np.insert(ids, np.cumsum(counts), end_id)
            doc_ids = batch.column("doc_id")
            named = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            held.append((doc_ids.fill_null(0).to_numpy(), named, counts + 1, whole))
            if sum(len(x[3]) for x in held) >= file_ids:
                yield flush()
                k += 1
        if held:
            yield flush()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return dealt.mapInArrow(run, "part long, file string, ids long")


def file_starts(files: DataFrame) -> DataFrame:
    """file and the number of ids in all files before it; running sums within a task's files and over the tasks' totals."""
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = files.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), zero).alias("base"))
    return files.withColumn("own", F.coalesce(F.sum("ids").over(inside), zero)).join(parts, "part").select("file", (F.col("base") + F.col("own")).alias("file_start"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, doc_id, begin (in the file), n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held = TokenFile(content.as_py())
                n = len(held.doc_ids)
                ids = held.tokens(0, held.n).astype("<u4").tobytes()
                ends = [4 * int(x) for x in held.begins]
                crc = [zlib.crc32(memoryview(ids)[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                name = path.as_py().rpartition("/")[2]
                columns = [pa.array([name] * n), pa.array(held.doc_ids, mask=held.named == 0), pa.array(held.begins[:-1]), pa.array(np.diff(held.begins)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "begin", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select("path", "content")
    return files.mapInArrow(run, "file string, doc_id long, begin long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-ids")
    files = staged(write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read_token_files(spark, folder).join(file_starts(files), "file")
    return rows.select("doc_id", (F.col("file_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
