"""Near-duplicates by b-bit MinHash: bands of minima give candidates, packed low bits of the minima estimate their similarity, full sets confirm.

Documents with equal shingle sets are one node. Of the minima of a node, five at a time make the key of a band; nodes that share a key share a bucket. Only
four low bits of each minimum are kept beside the keys, sixteen to a long. Of a pair, the share p of equal fields gives the similarity (p - 1/16) / (15/16).

No bucket is expanded into its pairs. First each bucket's leader (the member with the most company in all its buckets) is compared with all members; links that
full sets confirm join nodes into components. Pairs that remain share a bucket, hence a leader, but not a component: of all nodes with one leader, those
outside the largest component are compared with all others, block by block inside tasks, and only confirmed links between components leave a task.
The limit for estimates lies more than five standard deviations below the similarity that is asked for; a pair at that similarity shares no band with probability 5e-9.
So links are exact but for these odds.

Defined results: a null text is empty; a document without words has an empty set, links with nothing and is kept; with fewer words than a shingle has, all its
words are its only shingle; rows that share a doc_id are judged by their texts; a null doc_id is never the smallest of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codehist.llm.graph import components
from codehist.llm.tables import staged, table
from codehist.llm.vectors import flat, lower_ascii, mixed, pieces, span_hashes, words

BANDS, ROWS, BITS = 48, 5, 4
FIELDS = 64 // BITS
#: How far below the similarity an estimate may lie.
MARGIN = 0.14
#: Nodes of a group that meet in one block, by signatures or by sets; bits of the filter that picks the texts whose sets are needed.
BLOCK, SET_BLOCK, FILTER_BITS = 512, 128, 1 << 23

_RNG = np.random.default_rng(20)
SCALE = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
M = np.uint64(0xA24BAED4963EE407)
LOW = np.uint64(0x1111111111111111)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    data, at = flat(column)
    data = lower_ascii(data)
    begins, ends, n_words = words(data, at)
    h = mixed(span_hashes(data, begins, ends))
    joined = h.copy() + np.uint64(k)
    for j in range(1, k):
        joined = mixed(joined[: max(0, len(h) - j)] * M + h[j:])
    out, first = [], 0
    for n in n_words.tolist():
        if n >= k:
            out.append(np.unique(joined[first : first + n - k + 1]))
        elif n:
            own = h[first : first + 1] + np.uint64(n)
            for j in range(1, n):
                own = mixed(own * M + h[first + j])
            out.append(own)
        else:
            out.append(np.zeros(0, np.uint64))
        first += n
    return out


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(s), 1024):
        np.minimum(out, (SCALE[:, None] * s[None, a : a + 1024] + SHIFT[:, None]).min(1), out=out)
    return out >> np.uint64(32)


def packed(low: np.ndarray) -> np.ndarray:
    """Low bits of all minima, field by field from the lowest of each long."""
    fields = (low & np.uint64((1 << BITS) - 1)).reshape(-1, FIELDS)
    return np.bitwise_or.reduce(fields << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed(key * M + rows[:, j])
    return key


def node_id(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return b"".join(int(mixed(s ^ np.uint64(c)).sum(dtype=np.uint64) + np.uint64(len(s))).to_bytes(8, "big") for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def prints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, t (a hash of the text), node (null for an empty set), n_shingles, sig (packed low bits) and bands of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, most=1 << 20):
            for a in range(0, len(piece), 2048):
                batch = piece.slice(a, 2048)
                sets = shingle_sets(batch.column("text"), k)
                low = [minima(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("t"),
                        pa.array([node_id(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([None if x is None else packed(x).view(np.int64) for x in low], pa.list_(pa.int64())),
                        pa.array([None if x is None else band_keys(x).view(np.int64) for x in low], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "t", "node", "n_shingles", "sig", "bands"],
                )

    schema = "doc_id long, t long, node binary, n_shingles long, sig array<long>, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t")).mapInArrow(run, schema)


def estimate(x: Column, y: Column) -> Column:
    """Similarity by the bits in which two signatures differ: a field counts once, however many of its bits do."""

    def differing(a: Column, b: Column) -> Column:
        v = a.bitwiseXOR(b)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        return F.bit_count(v.bitwiseAND(F.lit(int(LOW))))

    differ = F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda total, n: total + n)
    return 1 - differ / F.lit(BANDS * ROWS * (1 - 2.0**-BITS))


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for all of x against all of y."""
    v = x[:, None, :] ^ y[None, :, :]
    v |= v >> np.uint64(1)
    v |= v >> np.uint64(2)
    return 1 - np.bitwise_count(v & LOW).sum(2, dtype=np.int64) / (BANDS * ROWS * (1 - 2.0**-BITS))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and its set, for the nodes (node, rep) that are wanted.

    A filter of fixed size, one bit per hash of a wanted doc_id, lets tasks pass over most texts that are not wanted; a join takes out the others.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    marks = wanted.select(F.col("rep").alias("doc_id")).select(bit.alias("bit"))
    rows = marks.groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg((F.col("bit") % 32768).cast("int")).alias("bits")).collect()
    found = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in rows:
        found[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    found = found.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            bits = whole.column("bit").to_numpy(zero_copy_only=False)
            chosen = whole.filter(pa.array((found[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1))
            for batch in pieces(iter([chosen]), most=1 << 20):
                sets = [s for s in shingle_sets(batch.column("text"), k) if len(s)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node_id(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["node", "members"])

    near = docs.select(F.col("doc_id").cast("long"), "text").withColumn("bit", bit).mapInArrow(run, "node binary, members array<long>")
    return near.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = staged(full_sets(docs, staged(nodes.select("node", "rep").join(ends, "node", "left_semi")), k))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def blocks_of_groups(rows: DataFrame, payload: Column, block: int) -> DataFrame:
    """Units of work (us, ms) of the groups (leader) whose nodes lie in several components (comp).

    ``us`` are nodes outside the group's largest component, ``ms`` any nodes; over the units of a group, each node of the first kind meets every node of the
    group. No unit holds more than about ``block`` of each.
    """
    per_comp = rows.groupBy("leader", "comp").agg(F.count("*").alias("n"))
    several = per_comp.groupBy("leader").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).where("all > top.n")
    own = rows.join(several, "leader").withColumn("outside", F.col("comp") != F.col("top.comp"))
    row = F.struct("node", F.xxhash64("comp").alias("comp"), "outside", payload.alias("payload"))
    own = own.withColumn("row", row).withColumn("m_blocks", F.ceil(F.col("all") / block)).withColumn("u_blocks", F.ceil((F.col("all") - F.col("top.n")) / block))
    place = F.xxhash64("node")
    ms = own.groupBy("leader", F.pmod(place, "m_blocks").alias("m")).agg(F.collect_list("row").alias("ms"))
    us = own.where("outside").groupBy("leader", "m_blocks", F.pmod(place, "u_blocks").alias("u")).agg(F.collect_list("row").alias("us"))
    return us.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_blocks") - 1))).join(ms, ["leader", "m"]).select("leader", "us", "ms")


def candidates(us: pa.Array, ms: pa.Array, limit: float) -> Iterator[tuple[int, int, float]]:
    """Places of the pairs of a unit in different components whose estimate reaches the limit, each pair once."""

    def parts(rows: pa.Array):
        sig = rows.field("payload").field("sig").flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
        return rows.field("node").to_pylist(), rows.field("comp").to_numpy(), rows.field("outside").to_numpy(zero_copy_only=False), sig

    (u_node, u_comp, _, u_sig), (m_node, m_comp, m_out, m_sig) = parts(us), parts(ms)
    for a in range(0, len(u_node), 64):
        guess = estimates(u_sig[a : a + 64], m_sig)
        for i, j in zip(*np.nonzero((guess >= limit) & (u_comp[a : a + 64, None] != m_comp[None, :])), strict=True):
            if not m_out[j] or u_node[a + i] < m_node[j]:
                yield a + i, j, guess[i, j]


def rest_links(members: DataFrame, leaders: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, limit: float) -> DataFrame:
    """Links (a, b) between components among the nodes that share a leader, enough to join all components that have some.

    A first pass compares signatures and names the nodes that have a candidate in another component; only their sets are fetched. The second pass
    compares sets, best estimates first; two components that a unit has linked are not looked at again in it.
    """
    groups = members.join(leaders, "key").where("node != leader").select("leader", "node").distinct()
    groups = staged(groups.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label"))
    signed = groups.join(nodes.select("node", "sig"), "node")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[bytes, bytes]] = set()
            for leader, us, ms in zip(batch.column("leader").to_pylist(), batch.column("us"), batch.column("ms"), strict=True):
                u_node, m_node = (x.values.field("node").to_pylist() for x in (us, ms))
                for i, j, _ in candidates(us.values, ms.values, limit):
                    found |= {(leader, u_node[i]), (leader, m_node[j])}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["leader", "node"])

    named = staged(blocks_of_groups(signed, F.struct("sig"), BLOCK).mapInArrow(name, "leader binary, node binary").distinct())
    if named.isEmpty():
        return named.select(F.col("leader").alias("a"), F.col("node").alias("b"))
    wanted = staged(nodes.select("node", "rep").join(named.select("node").distinct(), "node", "left_semi"))
    sets = staged(full_sets(docs, wanted, k))
    rows = signed.join(named, ["leader", "node"]).join(sets, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 1) for a in range(len(whole))):
                us, ms = batch.column("us")[0].values, batch.column("ms")[0].values
                u_node, m_node = us.field("node").to_pylist(), ms.field("node").to_pylist()
                u_comp, m_comp = us.field("comp").to_pylist(), ms.field("comp").to_pylist()
                u_set, m_set = (x.field("payload").field("members") for x in (us, ms))
                joined, found = set(), []
                for i, j, _ in sorted(candidates(us, ms, limit), key=lambda c: -c[2]):
                    between = (min(u_comp[i], m_comp[j]), max(u_comp[i], m_comp[j]))
                    if between in joined:
                        continue
                    x, y = u_set[i].values.to_numpy(), m_set[int(j)].values.to_numpy()
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        joined.add(between)
                        found.append((u_node[i], m_node[j]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"])

    return staged(blocks_of_groups(rows, F.struct("sig", "members"), SET_BLOCK).mapInArrow(compare, "a binary, b binary"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, t, n_shingles, component_id, kept and component (null without words), one row per row of ``docs`` (doc_id, text)."""
    limit = percent / 100 - MARGIN
    rows = staged(prints(docs, k))
    nodes = staged(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))

    buckets = nodes.select("node", F.explode("bands").alias("key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(buckets.join(crowded, "key"))
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    leaders = staged(members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("top")).select("key", F.col("top.node").alias("leader")))

    star = members.join(leaders, "key").where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sigs = nodes.select("node", "sig")
    likely = star.join(sigs.withColumnsRenamed({"node": "a", "sig": "x"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "y"}), "b")
    likely = staged(likely.where(estimate(F.col("x"), F.col("y")) >= limit).select("a", "b"))
    links = staged(confirmed(likely, docs, nodes, k, percent))
    labels = components(links)

    rest = rest_links(members, leaders, labels, docs, nodes, k, percent, limit)
    if not rest.isEmpty():
        links = links.unionByName(rest)
        labels = components(links)
    least = labels.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
    known = nodes.select("node", "rep").join(labels.join(least, "label").select("node", "label", "least"), "node", "left")
    known = known.select("node", F.coalesce("label", "node").alias("component"), F.coalesce("least", "rep").alias("least"))
    out = rows.select("doc_id", "t", "node", "n_shingles").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("least", "node")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one document of each group: that of the smallest doc_id. Texts without words all stay."""
    judged = near_duplicates(docs, k, percent)
    first = judged.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("one"))
    empty = judged.where("component is null").select("doc_id", "t").distinct()
    chosen = first.select("one.doc_id", "one.t").withColumn("words", F.lit(True)).unionByName(empty.withColumn("words", F.lit(False)))
    chosen = chosen.select(F.col("doc_id").alias("with_id"), F.col("t").alias("with_t"), "words").hint("shuffle_hash")
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"))
    met = rows.join(chosen, (F.col("t") == F.col("with_t")) & F.col("id").eqNullSafe(F.col("with_id")))
    repeated = Window.partitionBy("id", "t").orderBy(F.lit(0))
    return met.withColumn("n", F.row_number().over(repeated)).where("n = 1 or not words").select("row.*")


def op2_minhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                          when len(w) = 1 then w else [] end) as x from d),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
e0 as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 80 * (na.n + nb.n - common)),
e as (select a, b from e0 union all select b, a from e0),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.least as component_id, d.doc_id = c.least as kept
from d left join n using (doc_id) join (select a as doc_id, min(b) as least from r group by a) c using (doc_id)
"""
