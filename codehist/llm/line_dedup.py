"""Lines that several documents hold stay in the first of them only; documents can be added and taken away again.

A line's key is its trimmed text with A-Z in lower case; keys of at least SHORTEST code points are known by a 128-bit digest (blake2b). An index keeps, in a folder:

* ``refs``: the keys of every row of documents that was added, one row each. Exact, and what everything else can be worked out from.
* ``counts``: for every key its references (rows that hold it), and the smallest and the largest doc_id among them; a key is shared if these differ. Exact. A change
  appends rows for the keys it touches; the row with the highest version holds.
* ``filters``: the shared keys as cuckoo filters, one for each shard of the keys. Adding documents inserts keys that become shared; deleting documents takes out those
  that no longer are, without touching the rest.

To cut texts, each line's key travels to its shard, whose filter turns away nearly all keys that are not shared; what passes is joined with the exact counts, so a false positive
drops nothing. Keys with very many references (more than a thousandth of all, so fewer than a thousand keys) would overload a shard and are decided where the texts are.
Counts are summed before they are shuffled. Every step reads files of a finished version and writes files of a new one; a version counts once its mark is written.

Defined results: null and empty texts are one empty line; a null doc_id counts as the largest one (2^63 - 1); rows that share a doc_id are one document; a line that repeats inside one
document stays; deleting an id that is not there does nothing; other columns are kept, and one named n_lines or n_dropped is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codehist.llm.cuckoo import Cuckoo
from codehist.llm.tables import new_folder, staged, table
from codehist.llm.vectors import pieces

SHORTEST, DIGEST = 10, 16
SPACES = b" \t\n\v\f\r"
#: References of one shard; share of all references, and least number of them, beyond which a key is hot.
PER_SHARD, HOT_SHARE, HOT_LEAST = 10_000, 1000, 1000
NO_ID = (1 << 63) - 1


def line_key(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """Digest of a line's key; None if that is too short."""
    key = line.strip(SPACES).lower()
    if len(key) < shortest or (len(key) < 4 * shortest and not key.isascii() and len(key.decode()) < shortest):
        return None
    return hashlib.blake2b(key, digest_size=DIGEST).digest()


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _keyed(docs: DataFrame) -> DataFrame:
    """Equal rows share their id and t, and all that is found out about them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(_id().alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id and the distinct keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys = [list(set(map(line_key, text.encode().split(b"\n"))) - {None}) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.list_(pa.binary()))], names=["doc_id", "keys"])

    return _keyed(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<binary>")


def _counted(refs: DataFrame) -> DataFrame:
    held = refs.select("doc_id", F.explode("keys").alias("key"))
    return held.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def _hashes(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64)[:: DIGEST // 8].copy()


FILTER = "shard int, slots binary, stash binary"


def _changed_filters(changes: DataFrame, filters: DataFrame) -> DataFrame:
    """Filters (one row per shard) after ``changes``: shard, key, add (false: take out)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        old = rows.filter(rows["slots"].is_valid())
        changes = rows.filter(rows["key"].is_valid())
        new = _hashes(changes.filter(changes["add"])["key"])
        gone = _hashes(changes.filter(pa.compute.invert(changes["add"]))["key"])
        found = Cuckoo.read(old["slots"][0].as_py(), old["stash"][0].as_py()) if len(old) else Cuckoo.sized(len(new))
        found.remove(gone)
        found.add(new)
        slots, stash = found.written()
        return pa.table({"shard": rows["shard"][:1].cast(pa.int32()), "slots": pa.array([slots], pa.binary()), "stash": pa.array([stash], pa.binary())})

    none = F.lit(None).cast("binary")
    both = changes.select("shard", "key", "add", none.alias("slots"), none.alias("stash")).unionByName(
        filters.select("shard", none.alias("key"), F.lit(None).cast("boolean").alias("add"), "slots", "stash")
    )
    return both.groupBy("shard").applyInArrow(run, FILTER)


def _passed(pairs: DataFrame, filters: DataFrame) -> DataFrame:
    """Pairs (shard, key and more) whose key the filter of their shard lets through. In each task the filter of a shard comes before its pairs."""
    names = pairs.columns
    kinds = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, found = None, None
        for batch in batches:
            shards, slots = batch.column("shard").to_numpy(), batch.column("slots")
            cuts = np.unique(np.concatenate([[0, len(batch)], np.flatnonzero(np.diff(shards)) + 1]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if slots[a].is_valid:
                    shard, found = shards[a], Cuckoo.read(slots[a].as_py(), batch.column("stash")[a].as_py())
                    part = part.slice(1)
                if not len(part) or shard != shards[a]:
                    continue  # a shard without a filter has no shared key
                yield part.filter(pa.array(found.has(_hashes(part.column("key"))))).select(names)

    none = F.lit(None).cast("binary")
    both = pairs.select("*", none.alias("slots"), none.alias("stash")).unionByName(
        filters.select("shard", *(F.lit(None).cast(kinds[c].dataType).alias(c) for c in names if c != "shard"), "slots", "stash")
    )
    return both.repartition("shard").sortWithinPartitions("shard", F.col("slots").isNull()).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in kinds]))


class LineIndex:
    """The index in ``folder``, at its last finished version (0: empty)."""

    def __init__(self, spark: SparkSession, folder: str, per_shard: int = PER_SHARD, hot_share: int = HOT_SHARE, hot_least: int = HOT_LEAST):
        self.spark, self.folder, self.per_shard, self.hot_share, self.hot_least = spark, folder.rstrip("/"), per_shard, hot_share, hot_least
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        self.version, self.shards, self.filter_version = 0, 1, 0
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            last = self._read("versions", "version int, shards int, filter_version int").select("version", "shards", "filter_version").orderBy(F.desc("version")).first()
            if last is not None:
                self.version, self.shards, self.filter_version = last

    def _read(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(kind).parquet(f"{self.folder}/{name}")

    def _of_version(self, name: str, kind: str, version: int) -> DataFrame:
        return self.spark.read.schema(kind).parquet(f"{self.folder}/{name}/v={version}")

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={version}")

    def _empty(self, kind: str) -> DataFrame:
        return self.spark.createDataFrame([], kind)

    def refs(self) -> DataFrame:
        """doc_id, keys: the rows of all documents that were added and not deleted since."""
        if not self.version:
            return self._empty("doc_id long, keys array<binary>")
        held = self._read("refs", "doc_id long, keys array<binary>, v int").where(F.col("v") <= self.version)
        gone = self._read("gone", "doc_id long, v int").where(F.col("v") <= self.version).groupBy(F.col("doc_id").alias("id")).agg(F.max("v").alias("at"))
        return held.join(gone, (F.col("doc_id") == F.col("id")) & (F.col("at") > F.col("v")), "left_anti").select("doc_id", "keys")

    def counts(self) -> DataFrame:
        """key, n, first, last of every key that is still held."""
        kind = "key binary, n long, first long, last long"
        if not self.version:
            return self._empty(kind)
        if self.version == 1:
            return self._of_version("counts", kind, 1)
        held = self._read("counts", kind + ", v int").where(F.col("v") <= self.version)
        last = held.groupBy("key").agg(F.max_by(F.struct("n", "first", "last"), "v").alias("c"))
        return last.select("key", "c.*").where("n > 0")

    def filters(self) -> DataFrame:
        """One cuckoo filter for each shard that has shared keys."""
        return self._of_version("filters", FILTER, self.filter_version) if self.filter_version else self._empty(FILTER)

    def _finish(self, refs: DataFrame, gone: DataFrame, counts: DataFrame, old: DataFrame) -> None:
        """Writes a version: new refs, ids that are gone, and counts of touched keys (``old``: what these were); then filters, then its mark."""
        v = self.version + 1
        self._write(gone, "gone", v)
        self._write(counts, "counts", v)
        new = self._of_version("counts", "key binary, n long, first long, last long", v)
        before, self.version = self.version, v
        total = self.counts().agg(F.sum("n")).first()[0] or 0
        shards, shared = -(-total // self.per_shard) or 1, F.col("first") != F.col("last")
        if before and shards <= 2 * self.shards:
            was = old.select("key", shared.alias("was"))
            changes = new.join(was, "key", "left").select(_shard(self.shards), "key", (shared & (F.col("n") > 0)).alias("add"), F.coalesce("was", F.lit(False)).alias("was")).where("add != was").drop("was")
            filters = _changed_filters(changes, self.filters())
        else:  # the first version, or twice as many keys as the shards were made for
            self.shards = shards
            filters = _changed_filters(self.counts().where(shared).select(_shard(shards), "key", F.lit(True).alias("add")), self._empty(FILTER))
        self._write(filters, "filters", v)
        self.filter_version = v
        self._write(self.spark.createDataFrame([(v, self.shards, v)], "version int, shards int, filter_version int"), "versions", v)

    def insert(self, docs: DataFrame) -> None:
        v = self.version + 1
        self._write(_keys(docs), "refs", v)
        batch = self._of_version("refs", "doc_id long, keys array<binary>", v)
        counts, gone = _counted(batch), self._empty("doc_id long")
        if not self.version:
            self._finish(batch, gone, counts, self._empty("key binary, n long, first long, last long"))
            return
        counts = staged(counts)
        old = staged(self.counts().join(counts.select("key"), "key", "left_semi"))
        both = counts.unionByName(old).groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        self._finish(batch, gone, both, old)

    def delete(self, ids: DataFrame) -> None:
        """Takes away all rows with these ids (column doc_id); what they alone kept others from showing shows again."""
        ids = ids.select(_id().alias("doc_id")).distinct()
        held = self.refs()
        touched = staged(held.join(ids, "doc_id", "left_semi").select(F.explode("keys").alias("key")).distinct())
        old = staged(self.counts().join(touched, "key", "left_semi"))
        left = held.join(ids, "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key")).join(touched, "key", "left_semi")
        left = left.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        counts = staged(touched.join(left, "key", "left").select("key", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "first", "last"))))
        self._write(self._empty("doc_id long, keys array<binary>"), "refs", self.version + 1)
        self._finish(self._empty("doc_id long, keys array<binary>"), staged(ids), counts, old)

    def hot(self) -> dict[bytes, int]:
        """First holder of each shared key with more than a ``hot_share``-th of all references: fewer keys than that, so they may go to all tasks."""
        total = self.counts().agg(F.sum("n")).first()[0] or 0
        rows = self.counts().where((F.col("n") > max(self.hot_least, total / self.hot_share)) & (F.col("first") != F.col("last")))
        return {bytes(r.key): r.first for r in rows.select("key", "first").toLocalIterator()}

    def dropped(self, docs: DataFrame, hot: dict[bytes, int]) -> DataFrame:
        """doc_id, t, drops: keys of lines that ``docs`` (added before) lose, but for hot ones."""
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                owner, keys = [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    mine = set(map(line_key, text.encode().split(b"\n"))) - {None}
                    mine -= hot.keys()
                    keys.extend(mine)
                    owner.extend([k] * len(mine))
                rows = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("t").take(rows), pa.array(keys, pa.binary())], names=["doc_id", "t", "key"])

        pairs = _keyed(docs).mapInArrow(run, "doc_id long, t long, key binary").select(_shard(shards), "*")
        maybe = _passed(pairs, self.filters()).select("doc_id", "t", "key")
        shared = self.counts().where("first != last").select("key", "first")
        lost = maybe.join(shared, "key").where("doc_id != first")
        return lost.groupBy("doc_id", "t").agg(F.collect_set("key").alias("drops"))

    def cut(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the lines that an earlier document holds, and n_lines (before), n_dropped."""
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        hot = self.hot()
        row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
        left = docs.select(row, _id().alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
        right = self.dropped(docs, hot).hint("shuffle_hash").select(F.col("doc_id").alias("with_id"), F.col("t").alias("with_t"), "drops")
        both = left.join(right, (F.col("t") == F.col("with_t")) & (F.col("id") == F.col("with_id")), "left").select("row", "id", "drops")
        kinds = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = dict(zip(names, batch.column("row").flatten(), strict=True))
                texts, ids, drops = columns["text"].to_pylist(), batch.column("id").to_pylist(), batch.column("drops")
                n_lines, n_dropped = [], []
                for k, (text, doc_id) in enumerate(zip(texts, ids, strict=True)):
                    lines = (text or "").encode().split(b"\n")
                    n_lines.append(len(lines))
                    gone = set(drops[k].as_py()) if drops[k].is_valid else ()
                    if gone or hot:
                        keys = map(line_key, lines)
                        stay = [line for line, key in zip(lines, keys, strict=True) if key not in gone and hot.get(key, doc_id) == doc_id]
                        if len(stay) < len(lines):
                            texts[k] = b"\n".join(stay).decode()
                        lines = stay
                    n_dropped.append(n_lines[-1] - len(lines))
                columns["text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

        return both.mapInArrow(run, kinds)


def op13_line_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark, new_folder(spark, "lines"))
    index.insert(docs)
    return index.cut(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, id, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, min(id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(id) < max(id)
), m AS (
  SELECT k.*, s.holder IS NOT NULL AND s.holder <> k.id AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
