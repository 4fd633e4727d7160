"""Passages that occur more than once in a corpus, found by a suffix sort that compares by hashes.

A window is WINDOW bytes of a text; one that also starts anywhere else, in the same text or another, is repeated, and all its bytes are. To sort all suffixes of a
corpus in one place is out of the question, so windows that may be equal are brought together first:

1. Every window names an anchor, the place inside it whose GRAM bytes hash lowest. Equal windows name equal anchors at the same distance. Anchors whose hash
   occurs once in the corpus are done with; a counting job finds the others, and a filter of fixed size lets tasks pass over most of the rest.
2. The windows of one anchor stand in a row, a stretch. Stretches with equal bytes (by a digest of 128 bits) around equal anchors are one class; windows of a class with two
   members are repeated, and one member stands for all.
3. Stretches with the same anchor but other bytes around it may still share windows. One member of each class sends its bytes, and tasks sort the suffixes that
   begin at the stretches' windows: a bottom-up mergesort, in which two suffixes are compared by their longest common extension, found by binary search
   over polynomial prefix hashes. Neighbours that agree over a window are then compared byte by byte. If hashes of unequal bytes should meet, the block is sorted by bytes.
4. Anchors with more than HOT classes are split before that. All windows at distances lo to hi before the anchor share the bytes that the windows at both ends have in common, so
   halving the range of distances lengthens the common part, and stretches that differ in it part. A stretch goes on as its clipped bytes, those with equal bytes again as one
   class, and leaves when it is alone or in a group that a task can sort. At the last, a range is one distance and a group is one class; so every group ends, whatever is repeated.

Defined results: null texts are empty; texts shorter than a window have no window; matches never cross texts; rows that repeat a text are texts of their own, so
their windows are repeated, whatever their ids are; a null doc_id is an id like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehist.llm.tables import staged, table
from codehist.llm.vectors import BASES, CHUNK, INVERSES, POWERS, flat, mixed, pieces, powers

WINDOW, GRAM = 200, 40
PLACES = WINDOW - GRAM + 1
#: Classes of one group that a task sorts together; bytes of a sorted block; bits of the filters.
HOT, BLOCK_BYTES, FILTER_BITS = 2048, 1 << 18, 1 << 26
TAIL = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """For each stretch: text, first and last window, anchor (places in ``data``), hash of the anchor, distance of the anchor from the first window.

    Texts are taken in chunks, which end between texts where they can; a stretch that a chunk cuts counts as two.
    """
    power, inverse = _tables(window)
    places = window - gram + 1
    lasts = at[1:] - window
    begin = 0
    while begin < len(data):
        stop = at[np.searchsorted(at, begin + CHUNK, "right") - 1]
        stop = int(stop if stop > begin else min(begin + CHUNK, len(data)))
        part = data[begin : min(stop + window, len(data))]
        n = len(part)
        if n < window:
            begin = stop
            continue
        plus = part.astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(plus * power[:n])])
        grams = mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
        low = (grams & ~TAIL) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= places:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < places:
            low = np.minimum(low[: len(low) - (places - size)], low[places - size :])
        starts = begin + np.arange(min(len(low), stop - begin))
        text = np.searchsorted(at, starts, "right") - 1
        fine = starts <= lasts[text]
        chosen = (low[: len(starts)] & TAIL).astype(np.int64)
        new = fine.copy()
        new[1:] &= (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | ~fine[:-1]
        end = fine.copy()
        end[:-1] &= new[1:] | ~fine[1:]
        s, e = np.flatnonzero(new), np.flatnonzero(end)
        if len(s):
            p = chosen[s]
            yield text[s], begin + s, begin + e, begin + p, grams[p], p - s
        begin = stop


_LONGER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(window: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers as far as a chunk and a window reach."""
    if window not in _LONGER:
        n = CHUNK + window + 2
        _LONGER[window] = (powers(BASES[0], n), powers(pow(BASES[0], -1, 1 << 64), n))
    return _LONGER[window]


def class_of(raw: bytes, before: int) -> bytes:
    """What tells classes of one anchor apart: a digest of all bytes that the stretch covers, and where in them the anchor is."""
    return hashlib.blake2b(raw, digest_size=16).digest() + bytes([before])


def keyed(docs: DataFrame) -> DataFrame:
    """A text is known by its doc_id and a hash; equal rows share both, and all that is found out about them."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))


def filter_of(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes (column h), as bytes; its size is fixed (8 MB), so it may go to the driver, by one job, and to all tasks."""
    bit = F.pmod("h", F.lit(FILTER_BITS))
    rows = hashes.select(bit.alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg((F.col("bit") % 32768).cast("int")).alias("bits"))
    found = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in rows.collect():
        found[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return found.reshape(-1)


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.int64) % FILTER_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def anchor_hashes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for _, _, _, _, h, _ in anchors(*flat(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(run, "h long")


def stretches(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, t, h, c, first and last window (places in the text) of every stretch whose anchor is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, at = flat(batch.column("text"))
            for text, s, e, _, h, before in anchors(data, at):
                k = np.flatnonzero(in_filter(bits, h))
                rows, base = pa.array(text[k]), at[text[k]]
                first = int(s[k[0]]) if len(k) else 0
                raw = data[first : int(e[k[-1]]) + WINDOW].tobytes() if len(k) else b""
                c = [class_of(raw[a:b], d) for a, b, d in zip((s[k] - first).tolist(), (e[k] - first + WINDOW).tolist(), before[k].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("t").take(rows), pa.array(h[k].view(np.int64)), pa.array(c, pa.binary()), pa.array((s[k] - base).astype(np.int32)), pa.array((e[k] - base).astype(np.int32))],
                    names=["doc_id", "t", "h", "c", "s", "e"],
                )

    return keyed(docs).select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, h long, c binary, s int, e int")


def member_hash(doc_id: np.ndarray, t: np.ndarray, s: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc_id.view(np.uint64) + mixed(t.view(np.uint64))) + s.astype(np.uint64))


def bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted stretches (h, c, doc_id, t, s and more), with p (their anchor) and the bytes that their windows cover.

    Stretches are worked out anew where the texts are; a filter over their hashes passes nearly only those wanted, and a join takes out the others.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, t, s = (b.column(x).fill_null(0).to_numpy() for x in ("doc_id", "t", "s"))
            yield pa.RecordBatch.from_arrays([pa.array(member_hash(ids, t, s).view(np.int64))], names=["h"])

    bits = filter_of(wanted.select("doc_id", "t", "s").mapInArrow(hashes, "h long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, at = flat(batch.column("text"))
            ids, t = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("t").to_numpy()
            for text, s, e, p, h, before in anchors(data, at):
                k = np.flatnonzero(in_filter(bits, member_hash(ids[text], t[text], s - at[text])))
                if not len(k):
                    continue
                raw = [data[a : b + WINDOW].tobytes() for a, b in zip(s[k], e[k], strict=True)]
                rows, base = pa.array(text[k]), at[text[k]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows), batch.column("t").take(rows), pa.array(h[k].view(np.int64)),
                        pa.array(list(map(class_of, raw, before[k].tolist())), pa.binary()), pa.array((s[k] - base).astype(np.int32)), pa.array((p[k] - s[k]).astype(np.int32)), pa.array(raw, pa.binary()),
                    ],
                    names=["id", "t", "h", "c", "s", "p", "raw"],
                )

    found = keyed(docs).select("doc_id", "t", "text").mapInArrow(run, "id long, t long, h long, c binary, s int, p int, raw binary").dropDuplicates(["h", "c", "id", "t", "s"])
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    return wanted.join(found, ["h", "c", "t", "s"]).where(same).drop("id")


# -- the suffix sort ------------------------------------------------------------------------------------------------------------------------------------


class Block:
    """Bytes of some stretches in a row, their prefix hashes, and the suffixes that begin at their windows."""

    def __init__(self, raws: list[bytes], window: int = WINDOW):
        self.window = window
        self.data = np.frombuffer(b"".join(raws), np.uint8)
        n = len(self.data)
        self.power, self.inverse = _grown(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self.power[:n])])
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word[: n - k] |= self.data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.word = word

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes i and j, up to a window, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), self.window, np.int64)
        si, sj, vi, vj = self.sums[i], self.sums[j], self.inverse[i], self.inverse[j]
        for _ in range(int(self.window).bit_length()):
            mid = (lo + hi + 1) // 2
            same = (self.sums[i + mid] - si) * vi == (self.sums[j + mid] - sj) * vj
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix i comes before j, and whether they agree over a window."""
        a, b = self.word[i], self.word[j]
        out, equal = a < b, np.zeros(len(i), bool)
        k = np.flatnonzero(a == b)
        if len(k):
            x, y = i[k], j[k]
            ext = self.extension(x, y)
            equal[k] = whole = ext == self.window
            ext = np.where(whole, 0, ext)
            out[k] = ~whole & (self.data[x + ext] < self.data[y + ext])
        return out, equal

    def sort(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places sorted by their suffixes inside each group (groups begin at ``first``): a mergesort of all groups at once.

        In each round an element finds its place in the run that its own is merged with by binary search; of equals, those of the left run come first.
        """
        size = np.diff(np.append(first, len(places)))
        base = np.repeat(first, size)
        size = np.repeat(size, size)
        places, width, most = places.copy(), 1, int(size.max(initial=0))
        while width < most:
            at = np.flatnonzero(size > width)
            own = at - base[at]
            run = own // width
            left = run % 2 == 0
            lo = base[at] + np.minimum((run + np.where(left, 1, -1)) * width, size[at])
            hi = base[at] + np.minimum((run + np.where(left, 2, 0)) * width, size[at])
            other = lo.copy()
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) // 2
                mine, its = places[at[live]], places[mid]
                its_first, equal = self.less(its, mine)
                its_first |= equal & ~left[live]
                lo[live] = np.where(its_first, mid + 1, lo[live])
                hi[live] = np.where(its_first, hi[live], mid)
                live = live[lo[live] < hi[live]]
            pair = base[at] + run // 2 * 2 * width
            merged = places.copy()
            merged[pair + (own - run * width) + (lo - other)] = places[at]
            places, width = merged, 2 * width
        return places

    def repeated(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which of the places (sorted by group) begin a window that another place of their group begins as well."""
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        order = self.sort(places, first)
        near = np.flatnonzero(group[1:] == group[:-1])
        x, y = order[near], order[near + 1]
        same = self.extension(x, y) == self.window
        # hashes that agree are checked on the bytes
        rows = np.arange(self.window)
        for a in range(0, int(same.sum()), 4096):
            k = np.flatnonzero(same)[a : a + 4096]
            if (self.data[x[k][:, None] + rows] != self.data[y[k][:, None] + rows]).any():
                return self._by_bytes(places, group)
        found = np.zeros(len(self.data), bool)
        found[x[same]] = found[y[same]] = True
        return found[places]

    def _by_bytes(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        from collections import Counter

        raw = self.data.tobytes()
        keys = [(g, raw[p : p + self.window]) for g, p in zip(group.tolist(), places.tolist(), strict=True)]
        count = Counter(keys)
        return np.array([count[k] > 1 for k in keys], bool)


def _grown(n: int, held: list = [POWERS[0], INVERSES[0]]) -> list[np.ndarray]:  # noqa: B006
    """Powers for a block, kept for the next ones."""
    if len(held[0]) < n:
        from codehist.llm.vectors import powers

        held[:] = [powers(BASES[0], 2 * n), powers(pow(BASES[0], -1, 1 << 64), 2 * n)]
    return held


def runs(marks: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last place of each run of marked places that follow each other in one owner."""
    k = np.flatnonzero(marks)
    if not len(k):
        return k, k, k
    breaks = (np.diff(owner[k]) != 0) | (np.diff(place[k]) != 1)
    first, last = k[np.append(True, breaks)], k[np.append(breaks, True)]
    return owner[first], place[first], place[last]


def sorted_block(rows: pa.Table, window: int = WINDOW) -> pa.RecordBatch:
    """Repeated windows of some stretches; all classes of a group (h) must be among them."""
    raws = rows.column("raw").to_pylist()
    size = np.array(list(map(len, raws)))
    n_starts = size - window + 1
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(raws)), n_starts)
    offset = np.arange(n_starts.sum()) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    h = np.unique(rows.column("h").to_numpy(), return_inverse=True)[1]
    # equal windows have equal anchors at equal distances
    group = h[owner] * window + (rows.column("p").to_numpy()[owner] - offset)
    order = np.argsort(group, kind="stable")
    block = Block(raws, window)
    found = np.zeros(len(owner), bool)
    found[order] = block.repeated((base[owner] + offset)[order], group[order])
    single = rows.column("n").to_numpy() == 1
    who, first, last = runs(found & single[owner], owner, offset)
    s = rows.column("s").to_numpy()[who]
    columns = [rows.column(c).take(pa.array(who)).combine_chunks() for c in ("doc_id", "t")]
    return pa.RecordBatch.from_arrays([*columns, pa.array((s + first).astype(np.int32)), pa.array((s + last).astype(np.int32))], names=["doc_id", "t", "s", "e"])


def sort_stretches(rows: DataFrame) -> DataFrame:
    """doc_id, t, s, e: runs of repeated windows among stretches whose groups (h) have at most HOT classes. The classes of a group come to one task, in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for batch in (whole.slice(a, 512) for a in range(0, len(whole), 512)):
                h = batch.column("h").to_numpy()
                if held and size >= BLOCK_BYTES:
                    # the last group may go on: what is before it is complete
                    before = pa.Table.from_batches(held).combine_chunks()
                    cut = int(np.searchsorted(before.column("h").to_numpy(), h[0]))
                    if cut:
                        yield sorted_block(before.slice(0, cut).combine_chunks())
                        held = before.slice(cut).to_batches()
                        size = sum(b.nbytes for b in held)
                held.append(batch)
                size += batch.nbytes
        if held:
            yield sorted_block(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.select("h", "n", "doc_id", "t", "s", "p", "raw").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "doc_id long, t long, s int, e int")


# -- anchors with many classes --------------------------------------------------------------------------------------------------------------------------

KEPT = ("n", "doc_id", "t", "s", "p", "raw")


def halves(rows: DataFrame) -> DataFrame:
    """Each stretch in both halves of its range (lo, hi) of distances, clipped to the windows at these distances, with x, a digest of what is left of it."""
    mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = rows.withColumn("range", F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct((mid + 1).alias("lo"), "hi")))).drop("lo", "hi")
    near = F.greatest(F.col("range.lo"), F.col("p") - (F.length("raw") - WINDOW))
    far = F.least(F.col("range.hi"), F.col("p"))
    skip = F.col("p") - F.col("far")
    clipped = both.withColumns({"near": near, "far": far}).where("near <= far").select(
        "h", "range.lo", "range.hi", "n", "doc_id", "t", (F.col("s") + skip).alias("s"), F.col("far").alias("p"), F.substr("raw", skip + 1, F.col("far") - F.col("near") + WINDOW).alias("raw")
    )
    return clipped.withColumn("x", F.sha2(F.concat(F.concat_ws(":", "h", "lo", "p", F.lit("")).cast("binary"), F.col("raw")), 256))


def grouped(rows: DataFrame) -> DataFrame:
    """With g, the anchor and all bytes that the windows of the range have in common, and k, the number of classes of that group."""
    common = F.substr("raw", F.col("p") - F.col("lo") + 1, F.col("lo") - F.col("hi") + WINDOW)
    rows = staged(rows.withColumn("g", F.xxhash64("h", "lo", common)))
    return rows.join(rows.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"), "g")


def united(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def split_groups(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For groups (h) with more classes (KEPT), by rounds that halve the range of distances: runs of repeated windows found (doc_id, t, s, e), and stretches of
    groups that a task can sort (h, KEPT).

    Copies of all rounds come from one join, so that the rounds do not multiply the stages that run at once.
    """
    parts_of, shared_of, rest, level = [], [], [], rows.select("h", F.lit(0).alias("lo"), F.lit(PLACES - 1).alias("hi"), *KEPT)
    while not level.isEmpty():
        number = F.lit(len(rest)).alias("round")
        parts = staged(halves(level))
        classes = staged(parts.groupBy("x").agg(F.count("*").alias("m"), F.first(F.struct("h", "lo", "hi", *KEPT)).alias("one")))
        parts_of.append(parts.where("n = 1").select(number, "x", "doc_id", "t", "s", (F.col("s") + F.length("raw") - WINDOW).alias("e")))
        shared_of.append(classes.where("m > 1").select(number, "x"))
        # of stretches with equal bytes one goes on, whose own windows are found by now
        ones = classes.select(F.when(F.col("m") > 1, F.lit(2).cast("long")).otherwise(F.col("one.n")).alias("n"), *(f"one.{c}" for c in ("h", "lo", "hi", *KEPT[1:])))
        level = staged(grouped(ones))
        rest.append(level.where(F.col("k") <= HOT).select(F.col("g").alias("h"), *KEPT))
        level = level.where(F.col("k") > HOT).drop("g", "k")
    found = [united(parts_of).join(united(shared_of), ["round", "x"], "left_semi").drop("round", "x")] if rest else []
    return found, rest


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, t, spans: runs (s, e) of places at which a repeated window begins, for every text that has some."""
    twice = anchor_hashes(docs).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = staged(stretches(docs, filter_of(twice)))
    member = F.struct("doc_id", "t", "s")
    classes = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(member).alias("one"))
    classes = staged(classes)
    shared = classes.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("total > 1").select("h", "k")
    classes = staged(classes.join(shared, "h"))

    copied = found.join(classes.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("doc_id", "t", "s", "e")
    open_ = staged(classes.where("k > 1").select("h", "c", "n", "k", "one.doc_id", "one.t", "one.s"))
    spans = copied
    if not open_.isEmpty():
        rows = staged(bytes_of(docs, open_))
        more, rest = split_groups(rows.where(F.col("k") > HOT))
        # one sort for all: windows of a stretch lie in one group only, so groups that a hash brings together find nothing that is not equal
        spans = united([spans, *more, sort_stretches(united([rows.where(F.col("k") <= HOT).select("h", *KEPT), *rest]))])
    return staged(spans.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``spans`` (null: none) to every row; the columns of ``docs`` stay."""
    names = docs.columns
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    right = spans.hint("shuffle_hash").select(F.col("doc_id").alias("with_id"), F.col("t").alias("with_t"), "spans")
    return left.join(right, (F.col("t") == F.col("with_t")) & F.col("id").eqNullSafe(F.col("with_id")), "left").select("row", "spans")


def covered(n: int, spans: pa.Scalar, window: int = WINDOW) -> np.ndarray:
    """Begin and end (rows of two) of the maximal runs of bytes that the windows of the spans cover."""
    if not spans.is_valid or not len(spans.values):
        return np.zeros((0, 2), np.int64)
    s, e = (spans.values.field(c).to_numpy().astype(np.int64) for c in ("s", "e"))
    e = np.maximum.accumulate(e + window)
    new = np.append(True, s[1:] > e[:-1])
    return np.column_stack([s[new], np.append(e[np.flatnonzero(new)[1:] - 1], e[-1])])


def without(raw: bytes, cuts: np.ndarray) -> bytes:
    edges = [0, *cuts.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; a character that a cut leaves in part goes as well. Texts without one are as before."""
    names, kinds = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            columns = dict(zip(names, row.flatten(), strict=True))
            texts = columns["text"].to_pylist()
            for k, spans in enumerate(batch.column("spans")):
                if spans.is_valid and texts[k]:
                    raw = texts[k].encode()
                    texts[k] = without(raw, covered(len(raw), spans)).decode("utf-8", "ignore")
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return with_spans(docs, repeated_windows(docs)).mapInArrow(run, kinds)


def op1_suffix_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("row").flatten()
            out = []
            for text, spans in zip(texts.to_pylist(), batch.column("spans"), strict=True):
                raw = (text or "").encode()
                cuts = covered(len(raw), spans)
                out.append((len(raw), int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts), hashlib.sha256(without(raw, cuts)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, repeated_windows(docs)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
