"""Token ids of whole texts, by the tokenizers library, with each distinct word encoded once per task.

Such a tokenizer drops white space and never lets a token reach over it, so the ids of a text are those of its words in turn. Arrow finds the distinct words of a piece of text, these are
looked up in a bounded table that outlives the task, and only new ones are encoded. All this rests on how the file normalises and splits; a file that does so in any other way than
NORMALIZER and SPLITTER is left to the library, text by text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from codehist.llm.vectors import threads_off, words

#: The two parts of a tokenizer file for which the short way holds, and what its model must not do.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Words kept per task before the table starts anew; bounds memory, not results.
MOST_WORDS, MOST_BYTES = 300_000, 16 << 20


class Ids:
    """Ids of the units that texts fall into, kept one after the other; a unit is known by its number. ``cut`` and ``encoded`` tell what units are and which ids new ones have."""

    def __init__(self, encode, most: int = MOST_WORDS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.first, self.ids, self.bytes = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has, of texts in one buffer that begin at ``at``: only distinct units become Python objects."""
        if len(self.number) > self.most or self.bytes > MOST_BYTES:
            self.clear()
        coded, counts = self.cut(data, at)
        distinct = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = np.arange(len(self.number), len(self.number) + len(new))
            self._learn([distinct[k] for k in new.tolist()])
        # places and sizes by distinct unit first: these tables are small, and so stay near while the units are gone through
        which = coded.indices.to_numpy()
        first, size = self.first[known].astype(np.int32), (self.first[known + 1] - self.first[known]).astype(np.int32)
        each = size[which]
        stops = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=stops[1:])
        if stops[-1] >= 1 << 31:
            raise ValueError("a piece of text has too many ids")
        steps = np.repeat(first[which] - stops[:-1].astype(np.int32), each)
        steps += np.arange(stops[-1], dtype=np.int32)
        return self.ids[steps], np.diff(stops[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])

    def _learn(self, new: list[bytes]) -> None:
        ids, size = self.encoded(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.bytes += sum(map(len, new))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])


class WordIds(Ids):
    """Ids of words."""

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.number) > self.most or self.bytes > MOST_BYTES:
            self.clear()
        found, counts = [], []
        for text in texts:
            parts = text.split()
            counts.append(len(parts))
            found += parts
        new = list(set(found).difference(self.number))
        if new:
            self._learn(new)
        known = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        first = self.first[known]
        size = self.first[known + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])

    def cut(self, data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        return units(data, at)

    def encoded(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.encode(new)
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size


#: Letters of Latin-1 and then only points: the library takes such a word apart between the two, and lowers letters one by one.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]*)")
LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))]


IS_POINT = np.zeros(256, bool)
IS_POINT[list(b".,;:!?")] = True


def units(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in turn, and how many units each text has. A plain word is two units, its letters in lower case and its points, if it has some."""
    begins, ends, per = words(data, at)
    low = data | 32
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    second &= (data != 0x97) & (data != 0xB7)  # no multiplication and division signs
    letter = ((low >= 97) & (low <= 122)) | second
    letter[:-1] |= second[1:]
    so_far = np.concatenate([np.zeros(1, np.int32), np.cumsum(letter, dtype=np.int32)])
    middle = begins + so_far[ends] - so_far[begins]
    plain = (middle > begins) & (so_far[middle] - so_far[begins] == middle - begins)
    so_far = np.concatenate([np.zeros(1, np.int32), np.cumsum(IS_POINT[data], dtype=np.int32)])
    plain &= so_far[ends] - so_far[middle] == ends - middle
    two = plain & (middle < ends)

    marks = np.zeros(len(data) + 1, np.int8)
    marks[begins[plain]] += 1
    marks[ends[plain]] -= 1
    lowered = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    out = data.copy()
    out[lowered & (data >= 65) & (data <= 90)] |= 32
    out[lowered & second & (data >= 0x80) & (data <= 0x9E)] += 0x20

    n = 1 + two.astype(np.int64)
    last = np.cumsum(n)
    size = np.repeat(ends - begins, n)
    size[last[two] - 2] = (middle - begins)[two]
    size[last[two] - 1] = (ends - middle)[two]
    marks[:] = 0
    marks[begins] += 1
    marks[ends] -= 1
    kept = out[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
    edges = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
    coded = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(kept)]).dictionary_encode()
    return coded, np.diff(np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(per)])])


class WordEncoder:
    """Ids of words. Letters go to the library's model, whatever else is in a word to the whole library."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.points = tokenizer, {b"": ()}
        bytes_of = ByteLevel(add_prefix_space=False, use_regex=False)
        self.lower = str.maketrans({c: bytes_of.pre_tokenize_str(c.lower())[0][0] for c in LETTERS})

    def library(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

    def __call__(self, words: list[bytes]) -> list[Sequence[int]]:
        if len(self.points) > 10_000:
            self.points = {b"": ()}
        out, other, model = [], [], self.tokenizer.model
        tokenize = model.tokenize
        for k, word in enumerate(words):
            if word.isalpha():  # of bytes: ASCII letters only, which the byte level leaves as they are
                out.append([t.id for t in tokenize(word.decode().lower())])
                continue
            parts = PLAIN.fullmatch(word)
            if parts is None:
                other.append(k)
                out.append(())
                continue
            letters, points = parts.groups()
            ids = tuple([t.id for t in model.tokenize(letters.decode().translate(self.lower))])
            if points:
                behind = self.points.get(points)
                if behind is None:
                    behind = self.points[points] = tuple(self.library([points])[0])
                ids = ids + behind
            out.append(ids)
        for k, ids in zip(other, self.library([words[k] for k in other]), strict=True):
            out[k] = tuple(ids)
        return out


class LibraryIds:
    """Ids of whole texts, by the library alone."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, ids = data.tobytes(), []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            ids.append(np.array(self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)


def splits_at_spaces(tokenizer) -> bool:
    """Whether the file is of the kind whose words can be encoded one by one."""
    file = json.loads(tokenizer.to_str())
    model, extra = file["model"], [t["content"] for t in file["added_tokens"]]
    plain = model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"] and not model.get("ignore_merges") and not model["byte_fallback"]
    return plain and file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == SPLITTER and not any(set(t) & set(" \t\n\v\f\r") for t in extra)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds | LibraryIds:
    threads_off()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return WordIds(WordEncoder(tokenizer), most=500_000) if splits_at_spaces(tokenizer) else LibraryIds(tokenizer)
