"""Media columns: what a binary cell really holds, by signature.

An Aho-Corasick automaton locates all magic bytes of a cell in one pass; for each hit the format's validator walks the
structure and gives its length, or refuses. What starts at byte 0 is the cell's type, which corrects a declared one;
valid media further inside are carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S

BLOCK, RATE = 64, 8000
UNKNOWN = "application/octet-stream"


def _png(d: bytes, at: int) -> int:
    i = at + 8
    while i + 12 <= len(d):
        n, kind = int.from_bytes(d[i : i + 4], "big"), d[i + 4 : i + 8]
        if i + 12 + n > len(d) or (i == at + 8) != (kind == b"IHDR") or kind == b"IHDR" and n != 13 or zlib.crc32(d[i + 4 : i + 8 + n]) != int.from_bytes(d[i + 8 + n : i + 12 + n], "big"):
            return 0
        i += 12 + n
        if kind == b"IEND":
            return i - at
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    i = at + 13 + (3 * (2 << (d[at + 10] & 7)) if d[at + 10] & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < len(d) and d[i]:
            i += 1 + d[i]
        return i + 1 if i < len(d) else len(d) + 1

    while i < len(d):
        if d[i] == 0x3B:
            return i + 1 - at
        if d[i] == 0x21:
            i = blocks(i + 2)
        elif d[i] == 0x2C and i + 10 <= len(d):
            i = blocks(i + 11 + (3 * (2 << (d[i + 9] & 7)) if d[i + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(d: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(d) and d[i] == 0xFF:
        kind = d[i + 1]
        n = int.from_bytes(d[i + 2 : i + 4], "big")
        if kind in (0xD8, 0xD9) or n < 2 or i + 2 + n > len(d):
            return 0
        i += 2 + n
        if kind == 0xDA:  # coded data ends at a marker that is no stuffing or restart
            while (i := d.find(b"\xff", i)) >= 0 and i + 1 < len(d) and (d[i + 1] == 0 or 0xD0 <= d[i + 1] <= 0xD7):
                i += 2
            if i < 0 or i + 1 >= len(d):
                return 0
            if d[i + 1] == 0xD9:
                return i + 2 - at
    return 0


def _riff(d: bytes, at: int) -> int:
    end = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    if d[at + 8 : at + 16] != b"WAVEfmt " or end > len(d):
        return 0
    i, seen = at + 12, []
    while i + 8 <= end:
        n = int.from_bytes(d[i + 4 : i + 8], "little")
        seen.append(d[i : i + 4])
        i += 8 + n + (n & 1)
    return end - at if i == end and seen[:1] == [b"fmt "] and b"data" in seen else 0


def _bmp(d: bytes, at: int) -> int:
    if at + 54 > len(d):
        return 0
    size, spare, start, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", d, at + 2)
    if spare or at + size > len(d) or not 40 <= head <= 124 or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    return size if start + (width * depth + 31) // 32 * 4 * abs(height) <= size and start >= 54 else 0


def _gzip(d: bytes, at: int) -> int:
    if d[at + 3 : at + 4] > b"\x1f":
        return 0
    decoder = zlib.decompressobj(31)
    try:
        i, step = at, 256
        while i < len(d) and not decoder.eof:  # in growing steps: bytes that are no gzip file cost little, the plain ones are not kept
            decoder.decompress(d[i : i + step])
            i, step = i + step, min(2 * step, 65536)
    except zlib.error:
        return 0
    return min(i, len(d)) - len(decoder.unused_data) - at if decoder.eof else 0


@lru_cache(maxsize=1)
def _zip_ends(d: bytes) -> dict[int, int]:
    """Where each archive in d starts, by its end record, and its length: found once for a cell, whatever its entries."""
    found: dict[int, int] = {}
    end = d.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(d):
        n, start = struct.unpack_from("<II", d, end + 12)
        if d[end - n : end - n + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end - n - start >= 0:
            found.setdefault(end - n - start, n + start + 22 + int.from_bytes(d[end + 20 : end + 22], "little"))
        end = d.find(b"PK\x05\x06", end + 4)
    return found


def _zip(d: bytes, at: int) -> int:
    return _zip_ends(d).get(at, 0)


_PDF_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
_PDF_TABLE = re.compile(rb"\s*(?:xref\b|\d+\s+\d+\s+obj\b)")


def _pdf(d: bytes, at: int) -> int:
    """To the last %%EOF before the next header whose startxref leads to a table; 0 is a linearised first page's."""
    stop = d.find(b"%PDF-", at + 5)
    length = 0
    for m in _PDF_END.finditer(d, at, stop if stop >= 0 else len(d)):
        table = int(m[1])
        if table < m.start() - at and _PDF_TABLE.match(d, at + table) or table == 0 and b"/Linearized" in d[at : at + 1024]:
            length = m.end() - at
    return length


#: Magic bytes, type, validator: (bytes, first byte) -> length, 0 if the structure isn't whole.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), (i, len(magic)))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """Valid media in data: (offset, length, type). One at 0 holds the cell; the others are embedded in what it stores.

    Embedded media do not overlap each other: the earlier one wins. Bytes inside an embedded one are its own.
    """
    out: list[tuple[int, int, str]] = []
    free = 0
    for last, (i, n) in _automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        if at < free or (at == 0 and out):
            continue
        length = FORMATS[i][2](data, at)
        if length:
            out.append((at, length, FORMATS[i][1]))
            free = at + length if at else 1
    return out


def detected(spans: list[tuple[int, int, str]]) -> str:
    return spans[0][2] if spans and spans[0][0] == 0 else UNKNOWN


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM whose samples are the payload's bytes."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(data: bytes) -> bytes:
    """The samples of a WAV file that sniff() accepts."""
    i = 12
    while data[i : i + 4] != b"data":
        n = int.from_bytes(data[i + 4 : i + 8], "little")
        i += 8 + n + (n & 1)
    return data[i + 8 : i + 8 + int.from_bytes(data[i + 4 : i + 8], "little")]


def store_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media, declared: each text's UTF-8, filled with zero bytes to a positive multiple of 64, as a WAV file.

    A null text is empty (64 zero samples); repeated rows and null keys stay; no rows give none.
    """
    rows = docs.select(F.col(key).alias("_k"), S.text_bytes(text).alias("_b"))
    kind = rows.schema["_k"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches):
            texts = S.byte_values(batch.column(1))
            media = [to_wav(t + b"\0" * (max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return rows.mapInArrow(store, f"`{key}` {kind}, n_bytes long, media binary").withColumn("declared", F.lit("audio/wav"))


def correct_types(cells: DataFrame, *, media: str = "media", declared: str = "declared") -> DataFrame:
    """cells with detected (type at byte 0, octet-stream if none), type_ok and embedded array<struct<offset, length, type>>.

    A null cell has a null detected type and type_ok, and nothing embedded. A null declared type is not ok unless the
    detected one is unknown. Columns named like the three new ones are replaced.
    """
    new = ("detected", "embedded", "type_ok")
    kept = cells.drop(*new)
    place = kept.columns.index(media)
    span = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches):
            found = [None if d is None else sniff(d) for d in S.byte_values(batch.column(place))]
            types = [None if f is None else detected(f) for f in found]
            inner = [[{"offset": a, "length": n, "type": t} for a, n, t in f or () if a] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(inner, span)], [*batch.schema.names, "detected", "embedded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    got = kept.mapInArrow(look, f"{schema}, detected string, embedded array<struct<offset:long,length:long,type:string>>")
    return got.withColumn("type_ok", F.when(F.col("detected").isNotNull(), F.coalesce(F.col(declared), F.lit(UNKNOWN)) == F.col("detected")))


def carve(media: bytes, embedded: list[dict]) -> list[bytes]:
    return [media[e["offset"] : e["offset"] + e["length"]] for e in embedded]


def read_digests(stored: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Corrects the types of stored cells, reads them back as WAV and carves what is embedded: payload and stored digests
    and a feature of the samples.

    A cell that is no WAV file fails. carved in the feature is the crc32 of all embedded media, one after the other.
    """
    rows = correct_types(stored.select(key, "n_bytes", "media", "declared")).select(key, "n_bytes", "media", "detected", "embedded", "type_ok")
    kind = rows.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches):
            out = []
            for data, found, embedded, ok in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if found != "audio/wav":
                    raise ValueError(f"a stored cell is {found}, not audio/wav")
                payload, inner = from_wav(data), carve(data, embedded)
                samples = np.frombuffer(payload, np.uint8)
                high = samples >= 128
                turns = int((high[1:] != high[:-1]).sum())
                feature = f"{found};{RATE};8;samples={len(samples)};sum={int(samples.sum(dtype=np.int64))};turns={turns};declared={'ok' if ok else 'corrected'};embedded={len(inner)};carved={zlib.crc32(b''.join(inner))}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], [key, "n_bytes", *names])

    return rows.mapInArrow(read, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
