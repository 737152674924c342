"""Packing by powers of two: each document's token ids are cut into pieces of binary lengths, each piece is a sequence.

A document of L ids gives L // max_tokens pieces of max_tokens and one piece for each binary digit of the rest, longest
first. A sequence of a power of two needs no padding and no sequence crosses documents; equal lengths share a bucket, so
batches of one length can be drawn from it.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S
from spanweave.llm.words import chunks, word_hashes, word_spans

MAX_TOKENS, END_ID = 4096, 2
#: Words that a worker remembers (some 40 bytes each) over all its tasks; emptied when full. Longer words never are.
CACHED_WORDS, CACHED_LENGTH = 500_000, 48
#: Text bytes that are encoded at once; some 60 bytes of arrays each.
CHUNK = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ranks:
    """Rank of a pair of ids by an open-addressed table; `none` where the file has no merge for it."""

    def __init__(self, keys: np.ndarray):
        self.none = len(keys)
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.none, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # those whose slot is taken go on to the next
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            won = self.keys[at[left]] == keys[left]
            self.ranks[at[left[won]]] = left[won]
            left = left[~won]
            at[left] = (at[left] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], self.none)
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.last
            found = self.keys[at[more]]
            out[more] = np.where(found == keys[more], self.ranks[at[more]], self.none)
            more = more[(found != keys[more]) & (found >= 0)]
        return out


class LetterMerger:
    """Ids of many words of lower-case Latin-1 letters at once: such a word is one pre-token, joined by the file's merges.

    In each round every word joins its leftmost pair of the lowest rank, all words together.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, ending = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = _Ranks(np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64))
        self.joined = np.array([vocab[a + b] for a, b in merges], np.int64)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.inner, self.final = (np.array([vocab[symbol[b] + e] for b in range(256)], np.int64) for e in ("", ending))

    @staticmethod
    def takes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which words, of `size` bytes each in a row, are all letters a-z or small ones of two bytes that begin with C3."""
        lead = data == 0xC3
        after = np.append(False, lead[:-1])
        letter = (data >= 97) & (data <= 122) | lead | after & ((data == 0x9F) | (data >= 0xA0) & (data != 0xB7))
        return np.logical_and.reduceat(letter, np.cumsum(size) - size) & (size <= CACHED_LENGTH)

    def __call__(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has."""
        count = size.copy()
        if not len(size):
            return np.zeros(0, "<u4"), count
        none, ends = self.rank.none, np.cumsum(size) - 1
        ids = self.inner[data]
        ids[ends] = self.final[data[ends]]
        rank = np.full(len(ids), none, np.int64)
        rank[:-1] = self.rank(ids[:-1] << 32 | ids[1:])
        rank[ends] = none
        words, parts = np.arange(len(size)), []
        while len(words):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            low, hit = least >> 32, least & 0xFFFFFFFF  # the lowest rank and where it first stands
            going = low < none
            keep = np.repeat(going, size)
            parts.append((words[~going], size[~going], ids[~keep]))
            hit, low = hit[going], low[going]
            ids[hit] = self.joined[low]
            keep[hit + 1] = False
            words, size = words[going], size[going] - 1
            rank[hit] = rank[hit + 1]  # none at a word's end
            ids, rank, hit = ids[keep], rank[keep], (np.cumsum(keep) - 1)[hit]
            start = np.cumsum(size) - size
            for at in (hit[hit > start] - 1, hit[hit < start + size - 1]):
                rank[at] = self.rank(ids[at] << 32 | ids[at + 1])
        of, own, flat = (np.concatenate(x) for x in zip(*parts))
        count[of] = own
        begin = (np.cumsum(count) - count)[of]
        out = np.empty(len(flat), "<u4")
        out[np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(len(flat))] = flat
        return out, count


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] of them), start[1], .."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class _Known:
    """Ids of words by two 64-bit hashes of them, in sorted arrays; emptied when full."""

    def __init__(self):
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word would stand, whether it does, and whether another word of its hash does. Ascending hashes."""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        same, right = self.hash[at] == hashes, self.check[at] == checks
        return at, same & right, same & ~right

    def add(self, hashes: np.ndarray, checks: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        """Further words, ascending, whose ids stand in a row in pool."""
        if len(self.hash) + len(hashes) > CACHED_WORDS:
            self.__init__()
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.check = np.insert(self.hash, at, hashes), np.insert(self.check, at, checks)
        self.start = np.insert(self.start, at, len(self.pool) + np.cumsum(size) - size)
        self.size, self.pool = np.insert(self.size, at, size), np.concatenate([self.pool, pool])


class WordEncoder:
    """Ids of whole texts as little-endian uint32 (the machine's order is taken to be that).

    The tokenizer drops white space before it joins anything, and neither its normalizer nor its pre-tokenizer looks over
    white space, so a text's ids are its words' ids in a row; each distinct stem is encoded once while it is known. Two
    stems are taken as one if 128 bits of hashes agree.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = LetterMerger(path)
        self.known = _Known()
        self.points = [self.tokenizer.encode(p, add_special_tokens=False).ids[0] for p in (".", ",")]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each text has.

        Looked up by stem: a word in lower case, and without a point or comma that follows a letter, as these are tokens
        of their own. The tokenizer lowers all letters itself. A word that may hold a special token stays as it is.
        """
        joined, start, stop, count = word_spans(texts)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        raw, data = np.frombuffer(joined, np.uint8), np.frombuffer(joined.lower(), np.uint8)
        plain = np.ones(len(start), bool)
        mark = np.flatnonzero(raw == 60)  # <
        if len(mark):
            plain[np.searchsorted(start, mark, "right") - 1] = False
            data = data.copy()
            own = _ranges(start[~plain], (stop - start)[~plain])
            data[own] = raw[own]
        last, letter, lead = data[stop - 1], data[stop - 2], data[stop - 3]  # they may reach over the start: see long
        long = stop - start
        ends_letter = (long > 1) & (letter >= 97) & (letter <= 122) | (long > 2) & (lead == 0xC3) & (letter >= 128) & (letter != 0x97) & (letter != 0xB7)
        cut = ends_letter & ((last == 46) | (last == 44)) & plain
        stop = stop - cut
        hashes, checks = word_hashes(data, start, stop, 2)
        order = np.argsort(hashes)
        new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
        first, same = order[new], np.empty(len(order), np.int64)
        same[order] = np.cumsum(new) - 1
        if (checks[first][same] != checks).any():  # two words of one hash: each by itself, and none is remembered
            size, pool = self._fresh(data, start, stop)
            same = np.arange(len(start))
            begin = np.cumsum(size) - size
        else:
            begin, size, pool = self._look(data, start[first], stop[first], hashes[first], checks[first])
        own = size[same]
        end = np.cumsum(own + cut)
        flat = np.empty(end[-1], "<u4")
        flat[end[cut] - 1] = np.where(last[cut] == 46, *self.points)
        flat[_ranges(end - own - cut, own)] = pool[_ranges(begin[same], own)]
        at = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
        return flat, np.diff(at)

    def _look(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each distinct stem's ids begin, how many they are, and the pool they stand in. Ascending hashes."""
        at, there, taken = self.known.find(hashes, checks)
        miss = np.flatnonzero(~there)
        begin, size, pool = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), self.known.pool
        begin[there], size[there] = self.known.start[at[there]], self.known.size[at[there]]
        if len(miss):
            many, ids = self._fresh(data, start[miss], stop[miss])
            begin[miss], size[miss] = len(pool) + np.cumsum(many) - many, many
            pool = np.concatenate([pool, ids])
            keep = ((stop - start)[miss] <= CACHED_LENGTH) & ~taken[miss]
            self.known.add(hashes[miss][keep], checks[miss][keep], many[keep], ids[np.repeat(keep, many)])
        return begin, size, pool

    def _fresh(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each stem has, and all of them in a row."""
        size = stop - start
        own = data[_ranges(start, size)]
        simple = self.merge.takes(own, size)
        ids, many = self.merge(own[np.repeat(simple, size)], size[simple])
        rest, count = np.flatnonzero(~simple), np.zeros(len(size), np.int64)
        count[simple] = many
        others = []
        words = [data[a:b].tobytes().decode() for a, b in zip(start[rest].tolist(), stop[rest].tolist())]
        for i in range(0, len(words), 4096):
            others += [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
        count[rest] = [len(x) for x in others]
        out, begin = np.empty(int(count.sum()), "<u4"), np.cumsum(count) - count
        out[_ranges(begin[simple], many)] = ids
        out[_ranges(begin[rest], count[rest])] = [i for x in others for i in x]
        return count, out


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _log2(powers: np.ndarray) -> np.ndarray:
    return (np.frexp(powers)[1] - 1).astype(np.int32)


def cuts(lengths: np.ndarray, most: int = MAX_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The document of each piece and the piece's length, a document's longest first; most is a power of two."""
    bits = int(_log2(np.array([most]))[0])
    powers = 1 << np.arange(bits, -1, -1)
    many = np.concatenate([(lengths // most)[:, None], lengths[:, None] >> np.arange(bits - 1, -1, -1) & 1], 1)
    return np.repeat(np.arange(len(lengths)), many.sum(1)), np.repeat(np.tile(powers, len(lengths)), many.ravel())


def pack(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, and ids on request.

    A null or empty text is just end_id. Repeated rows are packed each by itself. sequence_id is unique but not dense;
    offset is 0 as each piece is a sequence. bucket is log2 of the length. One scan without a shuffle: write it with
    partitionBy("bucket") to draw batches of one length.
    """
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(key).alias("_k"), S.text_bytes(text).alias("_b"))
    kind = rows.schema["_k"].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "bucket", *["ids"] * with_ids]

    def pieces_of(documents: pa.Array, texts: list[bytes], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, count = encode(texts)
        total = count + 1
        flat = np.empty(int(total.sum()), "<u4")
        flat[np.cumsum(total) - 1] = end_id
        flat[_ranges(np.cumsum(total) - total, count)] = ids
        of, size = cuts(total, max_tokens)
        stop = np.cumsum(size)
        start = stop - size - (np.cumsum(total) - total)[of]
        view, at = memoryview(flat.view(np.uint8)), (4 * stop).tolist()
        crc = [zlib.crc32(view[i:j]) for i, j in zip([0, *at], at)]
        arrays = [documents.take(pa.array(of)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(total[of]), pa.array(_log2(size))]
        offsets = pa.array(np.append(0, stop), pa.int32())
        return pa.RecordBatch.from_arrays([*arrays, *[pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int32)))] * with_ids], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = S.byte_values(batch.column(1))
            for a, b in chunks(texts, CHUNK):
                yield pieces_of(batch.column(0).slice(a, b - a), texts[a:b], coder.encode)
        S.trim()

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids
    pieces = rows.mapInArrow(cut, schema)
    return pieces.select(
        key, "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *["ids"] * with_ids
    )
