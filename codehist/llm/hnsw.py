"""Nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, results of all shards merged.

Vectors are dealt to shards of bounded size by a hash of their id. A task builds a shard's graph: every node has a random height; on each layer it is linked to
near nodes such that no link points to a node that is closer to an earlier one. Nodes are inserted in batches that search the graph together, with
numpy over the whole batch. Neighbours are flat arrays, one row of fixed width per node and layer; a shard is one file in the shared folder.

Nearness is the inner product itself, while the graph is built as well as while it is searched: long vectors then become hubs, which is where the neighbours of
queries are. (A further coordinate that makes all norms equal turns inner products into distances, but measured worse by far on unequal lengths.) Equal
vectors are one node with several ids. Scores are worked out anew in double precision on the original vectors.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components takes no part, nor does one without id; vectors meet vectors of
their own length only; a row that repeats id and vector counts once, and rows that share the query's id are never its neighbours. The index holds every
other row. Recall is measured against brute force in the tests.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codehist.llm.archives import fetch
from codehist.llm.tables import new_folder, staged, table
from codehist.llm.token_files import put

#: Vectors per shard on average; queries that meet a shard in one unit of work.
SHARD, QUERIES = 16_384, 1024
LINKS, EF_BUILD, EF_SEARCH = 16, 96, 256
#: Nodes expanded at once in each beam, and searches that run together.
WIDTH, TOGETHER = 4, 256


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest nodes found for each query from its entry nodes (b, k), nearest first; -1 where there are fewer."""
    b, k = entry.shape
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, len(x) + 1), bool)
    seen[:, -1] = True
    ids = np.full((b, ef), -1, np.int64)
    near = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)
    fresh = entry
    while True:
        new = np.where(seen[rows, fresh], -1, fresh)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        seen[rows, new] = True
        score = np.einsum("bkd,bd->bk", x[new], q, optimize=False)
        score[new < 0] = -np.inf
        ids = np.concatenate([ids, new], 1)
        near = np.concatenate([near, score], 1)
        done = np.concatenate([done, new < 0], 1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :ef]
        ids, near, done = (np.take_along_axis(a, order, 1) for a in (ids, near, done))
        if done.all():
            return ids, near
        pick = np.argsort(done, axis=1, kind="stable")[:, :WIDTH]
        chosen = np.where(np.take_along_axis(done, pick, 1), -1, np.take_along_axis(ids, pick, 1))
        np.put_along_axis(done, pick, True, 1)
        fresh = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(b, -1)


def spread(x: np.ndarray, q: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (nearest first) those that are closer to q than to any chosen before, up to ``most``; (b, most), -1 where there are fewer."""
    b, c = ids.shape
    v = x[ids]
    between = np.einsum("bid,bjd->bij", v, v, optimize=True)
    out = np.full((b, most), -1, np.int64)
    n = np.zeros(b, np.int64)
    closest = np.full((b, c), -np.inf, np.float32)
    for j in range(c):
        ok = (ids[:, j] >= 0) & (near[:, j] > closest[:, j]) & (n < most)
        where = np.flatnonzero(ok)
        out[where, n[where]] = ids[where, j]
        n[where] += 1
        closest[where] = np.maximum(closest[where], between[where, j])
    return out


class Graph:
    """Layers over vectors x. On layer k the nodes of height k or more have neighbours: links[k] is (n, width), -1 where there are fewer."""

    def __init__(self, x: np.ndarray, heights: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.heights, self.links, self.entry = x, heights, links, entry

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 3) -> Graph:
        n = len(x)
        heights = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 12)
        order = np.argsort(-heights, kind="stable")
        links = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int64) for k in range(int(heights.max()) + 1)]
        g = cls(x, heights, links, int(order[0]))
        done = 1
        while done < n:
            size = min(TOGETHER, max(1, done // 4), n - done)
            g._insert(order[done : done + size])
            done += size
        return g

    def _insert(self, batch: np.ndarray) -> None:
        """Tallest nodes come first, so the entry node never changes."""
        x, q = self.x, self.x[batch]
        entry = np.full((len(batch), 1), self.entry)
        inside = q @ q.T
        np.fill_diagonal(inside, -np.inf)
        for layer in range(len(self.links) - 1, -1, -1):
            there = self.heights[batch] >= layer
            ids, near = beam(x, self.links[layer], q, entry, EF_BUILD if there.any() else 1)
            entry = ids[:, :8]
            if not there.any():
                continue
            mates = np.where(there[None, :] & there[:, None], inside, -np.inf)
            ids = np.concatenate([ids, np.where(mates > -np.inf, batch[None, :], -1)], 1)[there]
            near = np.concatenate([near, mates], 1)[there]
            top = np.argsort(-near, axis=1, kind="stable")[:, :EF_BUILD]
            ids, near = np.take_along_axis(ids, top, 1), np.take_along_axis(near, top, 1)
            chosen = spread(x, q[there], ids, near, LINKS)
            self.links[layer][batch[there], :LINKS] = chosen
            self._back(layer, batch[there], chosen)

    def _back(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Links back from chosen nodes; a node with too many keeps a spread selection."""
        links = self.links[layer]
        width = links.shape[1]
        target, source = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        at, first, count = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(at), int(count.max())) if len(at) else (0, 0), -1, np.int64)
        more[np.repeat(np.arange(len(at)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate([links[at], more], 1)
        both.sort(axis=1)
        both = both[:, ::-1]
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        full = (both >= 0).sum(1) > width
        easy = np.sort(both[~full], axis=1)[:, ::-1][:, :width]
        links[at[~full], : easy.shape[1]] = easy
        links[at[~full], easy.shape[1] :] = -1
        for a in range(0, int(full.sum()), TOGETHER):
            rows, ids = at[full][a : a + TOGETHER], both[full][a : a + TOGETHER]
            near = np.einsum("bkd,bd->bk", self.x[ids], self.x[rows])
            near[ids < 0] = -np.inf
            order = np.argsort(-near, axis=1, kind="stable")
            links[rows] = spread(self.x, self.x[rows], np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1), width)

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        entry = np.full((len(q), 1), self.entry)
        for layer in range(len(self.links) - 1, 0, -1):
            entry = beam(self.x, self.links[layer], q, entry, 8)[0]
        return beam(self.x, self.links[0], q, entry, ef)[0]


class Shard:
    """A graph over the distinct vectors of a shard, and the ids of each."""

    def __init__(self, vectors: np.ndarray, first: np.ndarray, ids: np.ndarray, graph: Graph):
        self.vectors, self.first, self.ids, self.graph = vectors, first, ids, graph

    @staticmethod
    def scaled(vectors: np.ndarray) -> np.ndarray:
        """No longer than 1, so that single precision does for the graph."""
        return (vectors / np.sqrt((vectors.astype(float) ** 2).sum(1).max())).astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Shard:
        order = np.lexsort([ids, *vectors.T[::-1]])
        ids, vectors = ids[order], vectors[order]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(1))
        same = np.append(False, ~new[1:] & (ids[1:] == ids[:-1]))
        distinct, group = vectors[new], (np.cumsum(new) - 1)[~same]
        first = np.searchsorted(group, np.arange(len(distinct) + 1))
        return cls(distinct, first, ids[~same], Graph.build(cls.scaled(distinct)))

    def dump(self) -> bytes:
        g, out = self.graph, io.BytesIO()
        layers = {f"links{k}": a.astype(np.int32) for k, a in enumerate(g.links[:1])}
        for k, a in enumerate(g.links[1:], 1):
            nodes = np.flatnonzero(g.heights >= k)
            layers |= {f"nodes{k}": nodes.astype(np.int32), f"links{k}": a[nodes].astype(np.int32)}
        np.savez(out, vectors=self.vectors, first=self.first, ids=self.ids, heights=g.heights.astype(np.int8), entry=np.array(g.entry), **layers)
        return out.getvalue()

    @classmethod
    def load(cls, content: bytes) -> Shard:
        with np.load(io.BytesIO(content)) as f:
            heights = f["heights"].astype(int)
            links = [f["links0"].astype(np.int64)]
            for k in range(1, int(heights.max()) + 1):
                links.append(np.full((len(heights), f[f"links{k}"].shape[1]), -1, np.int64))
                links[-1][f[f"nodes{k}"]] = f[f"links{k}"]
            graph = Graph(cls.scaled(f["vectors"]), heights, links, int(f["entry"]))
            return cls(f["vectors"], f["first"], f["ids"], graph)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, id and score of up to k neighbours each; larger scores, then smaller ids, come first."""
        scaled = (queries / np.linalg.norm(queries.astype(float), axis=1, keepdims=True)).astype(np.float32)
        out = []
        for a in range(0, len(queries), TOGETHER):
            found = self.graph.search(scaled[a : a + TOGETHER], max(ef, k + 1))
            for i, nodes in enumerate(found, a):
                nodes = nodes[nodes >= 0]
                score = self.vectors[nodes].astype(float) @ queries[i].astype(float)
                n = np.minimum(self.first[nodes + 1] - self.first[nodes], k + 1)
                at = np.arange(n.sum()) + np.repeat(self.first[nodes] - (np.cumsum(n) - n), n)
                ids, score = self.ids[at], np.repeat(score, n)
                other = ids != query_ids[i]
                ids, score = ids[other], score[other]
                top = np.lexsort([ids, -score])[:k]
                out.append((np.full(len(top), i), ids[top], score[top]))
        if not out:
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


@lru_cache(maxsize=1)
def loaded(folder: str, file: str) -> Shard:
    return Shard.load(fetch(folder, file))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles would be float32 already) and dim of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull())
    return rows.where(fine & F.exists(e, lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(v) for v in column])


def build_index(vectors: DataFrame, folder: str, shard_size: int = SHARD) -> DataFrame:
    """Write a file per shard below ``folder``; one row per shard: dim, shard, file."""
    rows = usable(vectors)
    counts = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_size).alias("shards"))
    dealt = rows.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(5)), "shards"))

    def run(key, part):
        import pandas as pd

        name = f"dim-{key[0]:05d}-shard-{key[1]:06d}.npz"
        put(folder, name, Shard.build(part["vec_id"].to_numpy(), matrix(part["embedding"])).dump())
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "file": [name]})

    # a task's work is the graph, however few bytes its vectors have: a set number of tasks
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "dim", "shard")
    return staged(dealt.groupBy("dim", "shard").applyInPandas(run, "dim int, shard long, file string"))


def search_index(queries: DataFrame, index: DataFrame, folder: str, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found in all shards. Queries meet each shard of their length in blocks; a task reads a shard's file once."""

    asked = usable(queries).dropDuplicates(["vec_id", "embedding"]).withColumn("q", F.xxhash64("vec_id", "embedding"))
    n = F.count("*")
    blocks = asked.groupBy("dim").agg(F.ceil(n / QUERIES).alias("blocks"))
    asked = asked.join(blocks, "dim").withColumn("block", F.pmod("q", "blocks"))
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = asked.join(index, "dim").repartition(tasks, "file", "block").sortWithinPartitions("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("file").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, files[1:] != files[:-1])).tolist() + [len(files)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                ids = part.column("vec_id").to_numpy()
                row, found, score = loaded(folder, files[a]).nearest(ids, matrix(part.column("embedding").to_numpy(zero_copy_only=False)), k, ef)
                yield pa.RecordBatch.from_arrays([pa.array(part.column("q").to_numpy()[row]), pa.array(ids[row]), pa.array(found), pa.array(score)], names=["q", "query_id", "vec_id", "score"])

    found = units.select("file", "q", "vec_id", "embedding").mapInArrow(run, "q long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_hnsw(spark, sf_dir) -> DataFrame:
    vectors, folder = table(spark, sf_dir, "embeddings"), new_folder(spark, "hnsw")
    index = build_index(vectors, folder)
    return search_index(vectors.where(F.col("vec_id") % 20 == 0), index, folder, 20)
