"""SentencePiece encoding and decoding of whole texts, by matching all pieces against a suffix array.

A batch of text is indexed by a suffix array (prefix doubling, as deep as the longest piece, from as many characters as a number holds). Each piece is looked up by
binary search, so many characters at a time and all pieces at once, which gives the range of its occurrences. Occurrences are edges; laid out by position they tell for any span whether it is a piece and how
good. Relaxing then takes the best edge over two neighbouring spans, the leftmost of equals, again and again, as the model's merges ask for. Characters
without a piece become bytes.

No piece of a model reaches from a letter over a later space, so a text falls apart into units: spaces and what follows them. A unit is encoded once per task; the
table of units is bounded and starts anew when full. Vocabulary and scores are read with the sentencepiece library; models of type BPE with bytes for unknown
characters and no normalisation but the dummy space are meant.

Defined results: null and empty texts have no ids and decode to the empty text; the visible space U+2581 in a text is a space.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehist.llm.tables import table
from codehist.llm.vectors import flat, give_back, pieces, threads_off
from codehist.llm.word_bpe import Ids

SPACE = "▁"
#: Characters indexed at once, and units from which on a heap finds the best edge of one unit alone.
BATCH, LONG = 1 << 18, 200
GAP = 0x110000
NEVER = np.iinfo(np.int32).max


class Pieces:
    """The pieces of a model: code points, ids, and their place in the order of scores (0 merges first)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        text = {i: model.id_to_piece(i) for i in range(n)}
        plain = sorted((i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))), key=text.__getitem__)
        if any(SPACE in text[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece reaches over a space")
        self.ids = np.array(plain, np.int32)
        self.sizes = np.array([len(text[i]) for i in plain])
        self.most = int(self.sizes.max())
        self.chars = np.full((len(plain), self.most), -1, np.int64)
        for k, i in enumerate(plain):
            self.chars[k, : len(text[i])] = list(map(ord, text[i]))
        scores = np.array([model.get_score(i) for i in plain])
        self.order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        self.line_is_gap = not any("\n" in text[i] for i in plain)
        raw = [b"" if model.is_control(i) else bytes([int(text[i][3:5], 16)]) if model.is_byte(i) else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.raw_ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)


def letters(text: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Numbers from 1 of the code points in a text (0 for others), the bits of one, and how many fit into 63."""
    number = np.zeros(GAP + 1, np.int64)
    number[text] = 1
    found = np.flatnonzero(number)
    number[found] = np.arange(1, len(found) + 1)
    bits = len(found).bit_length()
    return number, bits, 63 // max(bits, 1)


def packed(text: np.ndarray, number: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The next ``width`` characters from each place as one number; the end sorts first."""
    code = np.append(number[text], np.zeros(width, np.int64))
    out = np.zeros(len(text), np.int64)
    for k in range(width):
        out <<= bits
        out |= code[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` characters or more, by as many as one number holds and then by doubling; only ties are sorted again."""
    number, bits, size = letters(text)
    key = packed(text, number, bits, size)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(text), bool)
    new[1:] = key[1:] != key[:-1]
    while size < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        rank = np.zeros(len(text) + size, np.int64)
        rank[order] = np.cumsum(new)
        places = order[tied]
        key = rank[places] * (len(text) + 1) + rank[places + size]
        by_key = np.argsort(key)
        order[tied] = places[by_key]
        key = key[by_key]
        new[tied[1:]] = key[1:] != key[:-1]
        size *= 2
    return order


def occurrences(text: np.ndarray, order: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of each piece in the suffix array. A range shrinks by one binary search for its begin and one for its end for each number of characters; empty ones rest."""
    number, bits, width = letters(text)
    inside = np.arange(chars.shape[1]) < sizes[:, None]
    code = np.where(inside, number[chars], 0)
    keys = np.append(packed(text, number, bits, width), np.zeros(chars.shape[1], np.int64))
    lo, hi = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    live = np.flatnonzero(((code > 0) == inside).all(1))
    hi[live] = len(order)
    for depth in range(0, chars.shape[1], width):
        live = live[(sizes[live] > depth) & (lo[live] < hi[live])]
        if not len(live):
            break
        least, most = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for k in range(depth, depth + width):
            within = sizes[live] > k
            want = code[live, k] if k < chars.shape[1] else 0
            least = least << bits | want
            most = most << bits | np.where(within, want, (1 << bits) - 1)
        if not depth:
            ranked = keys[order]
            lo[live], hi[live] = np.searchsorted(ranked, least), np.searchsorted(ranked, most, "right")
            continue
        bounds = []
        for after, want in ((False, least), (True, most)):
            a, b = lo[live], hi[live]
            while (open_ := a < b).any():
                mid = (a + b) // 2
                at = keys[order[np.minimum(mid, len(order) - 1)] + depth]
                right = open_ & (at <= want if after else at < want)
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            bounds.append(a)
        lo[live], hi[live] = bounds
    return lo, np.maximum(lo, hi)


class UnitIds(Ids):
    """Ids of units: spaces and what follows them. A text has a space put in front; lines end a unit if no piece reaches over them."""

    def __init__(self, encode, line_is_gap: bool):
        super().__init__(encode)
        self.line_is_gap = line_is_gap

    def cut(self, data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        raw = data.tobytes()
        if SPACE.encode() in raw:
            texts = [raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))])
        some = np.diff(at) > 0
        data = np.insert(data, at[:-1][some], 0x20)
        at = at + np.concatenate([[0], np.cumsum(some)])

        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[at[:-1][some]] = True
        if self.line_is_gap:
            line = data == 0x0A
            first |= line
            first[1:] |= line[:-1]
        begins = np.flatnonzero(first)
        edges = np.append(begins, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        return coded, np.diff(np.searchsorted(begins, at))

    def encoded(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(new)


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.table = UnitIds(self.encode_units, self.pieces.line_is_gap)

    def encode_units(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        batch = (np.cumsum(sizes) - sizes) // BATCH
        edges = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(raw)]
        out = [self._batch(raw[a:b]) for a, b in pairwise(edges)]
        ids, counts = (np.concatenate(x) for x in zip(*out, strict=True))
        return ids, counts

    def _batch(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        p = self.pieces
        raw = b"\n".join(units)
        try:
            chars = raw.decode()
        except UnicodeDecodeError:
            units = [u.decode("utf-8", "replace").encode() for u in units]
            raw = b"\n".join(units)
            chars = raw.decode()
        text = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int64)
        text[text == 0x20] = ord(SPACE)
        begins = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1)
        begins[1:] = begins[:-1]
        begins[0] = 0
        if len(text) < len(raw):
            begins = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[begins] - 1
        sizes = np.diff(np.append(begins, len(text) + 1)) - 1
        text[begins[1:] - 1] = GAP
        order = suffix_array(text, p.most)
        lo, hi = occurrences(text, order, p.chars, p.sizes)

        # edges by position: which piece, if any, spans ``size`` characters from a place
        n_each = hi - lo
        piece = np.repeat(np.arange(len(n_each), dtype=np.int32), n_each)
        at = order[np.arange(len(piece)) + np.repeat(lo - (np.cumsum(n_each) - n_each), n_each)]
        edges = np.full((len(text), p.most + 1), -1, np.int32)
        edges[at, p.sizes[piece]] = piece

        start, span = relax(begins, sizes, edges, p.order)
        return self._ids(text, begins, start, edges[start, span])

    def _ids(self, text, begins, start, piece) -> tuple[np.ndarray, np.ndarray]:
        ids = self.pieces.ids[piece].astype(np.uint32)
        ends = np.searchsorted(start, np.append(begins, len(text)))
        unknown = piece < 0
        if unknown.any():
            raw = [self.pieces.byte[list(chr(c).encode())] for c in text[start[unknown]]]
            n_ids = np.ones(len(ids), np.int64)
            n_ids[unknown] = list(map(len, raw))
            ids = np.repeat(ids, n_ids)
            ids[np.repeat(unknown, n_ids)] = np.concatenate(raw)
            ends = np.concatenate([[0], np.cumsum(n_ids)])[ends]
        return ids, np.diff(ends)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        return self.table.of(*flat(column))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids in a row; the space that encoding puts in front goes."""
        p = self.pieces
        first, size = p.raw_ends[ids], np.diff(p.raw_ends)[ids]
        ends = np.cumsum(size)
        raw = p.raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)].tobytes()
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def relax(begins: np.ndarray, sizes: np.ndarray, edges: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the spans that remain, in order of place. In each round every unit joins the two neighbours with the best edge over both."""
    most = edges.shape[1] - 1
    order = np.append(order, NEVER).astype(np.int64)  # the last is that of no piece
    spans = np.zeros(len(edges), np.int64)
    ranked = order.tolist()
    for k in np.flatnonzero(sizes > LONG):
        start, span = relax_one(int(begins[k]), int(sizes[k]), edges, ranked)
        spans[start] = span
    left = sizes[sizes <= LONG]
    ends = np.cumsum(left)
    start = np.arange(int(left.sum())) + np.repeat(begins[sizes <= LONG] - (ends - left), left)
    span = np.ones(len(start), np.int64)

    def ranks(i: np.ndarray) -> np.ndarray:
        both = span[i] + span[i + 1]
        both[both > most] = 0  # no piece has no characters
        return order[edges[start[i], both]]

    rank = np.full(len(start), NEVER, np.int64)  # of the edge over a span and the next
    inner = np.ones(len(start), bool)
    inner[ends - 1] = False
    inner = np.flatnonzero(inner)
    rank[inner] = ranks(inner)
    while len(left):
        head = np.cumsum(left) - left
        # best edge, and the leftmost of equals
        best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), head)
        more = best < NEVER << 32
        if not more.all():
            still = np.repeat(more, left)
            spans[start[~still]] = span[~still]
            start, span, rank = start[still], span[still], rank[still]
            gone = np.cumsum(np.where(more, 0, left))[more]
            best, head, left = best[more], (head[more] - gone), left[more]
            join = (best & 0xFFFFFFFF) - gone
        else:
            join = best & 0xFFFFFFFF
        span[join] += span[join + 1]
        kept = np.ones(len(start), bool)
        kept[join + 1] = False
        start, span, rank = start[kept], span[kept], rank[kept]
        before = np.arange(len(left))
        left = left - 1
        join, head = join - before, head - before
        last = join == head + left - 1
        rank[join[last]] = NEVER
        changed = np.concatenate([join[~last], join[join > head] - 1])
        rank[changed] = ranks(changed)
    start = np.flatnonzero(spans)
    return start, spans[start]


def relax_one(begin: int, size: int, edges: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long unit, with a heap of edges; an edge whose neighbours have changed since is passed over."""
    most = edges.shape[1] - 1
    span, after, before = [1] * size, list(range(1, size + 1)), list(range(-1, size - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < size:
            both = span[i] + span[after[i]]
            if both <= most and (rank := order[edges[begin + i, both]]) != NEVER:
                heapq.heappush(heap, (rank, i, both))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if span[i] and after[i] < size and span[i] + span[after[i]] == both:
            j = after[i]
            span[i], span[j], after[i] = both, 0, after[j]
            if after[i] < size:
                before[after[i]] = i
            offer(before[i])
            offer(i)
    kept = np.flatnonzero(span)
    return begin + kept, np.array(span)[kept]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    threads_off()
    return Encoder(path)


def encode(docs: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """The columns to keep and ``ids`` (array<int>) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, counts = encoder(model).texts(batch.column("text"))
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], names=[*keep, "ids"])
        encoder(model).table.clear()
        give_back()

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["ids array<int>"]))


def decode(encoded: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """The columns to keep, the decoded ``text``, and n_tokens and ids_crc32 of what was decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1024):
                batch = whole.slice(a, 1024)
                column = batch.column("ids")
                counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = column.flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                columns = [pa.array(encoder(model).decode(ids, counts), pa.string()), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], names=[*keep, "text", "n_tokens", "ids_crc32"])
        give_back()

    kinds = dict(encoded.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["text string, n_tokens long, ids_crc32 long"])
    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, schema)


def op8_piece_bpe(spark, sf_dir) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), decoded_sha256 and whether decoding gives the text back."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("of_text"))
    decoded = decode(encode(docs, model, ["doc_id", "of_text"]), model, ["doc_id", "of_text"])
    digest = F.sha2("text", 256)
    return decoded.select("doc_id", "n_tokens", "ids_crc32", digest.alias("decoded_sha256"), (digest == F.col("of_text")).alias("round_trip"))
