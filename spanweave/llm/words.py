"""Words of whole texts as numpy arrays: spans and 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from spanweave.llm import _support as S

_U = np.uint64
#: Odd multipliers of the two independent polynomial hashes.
BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[list(S.SPACES.encode())] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(32))


_powers = [np.ones(1, np.uint64) for _ in BASES]


def _powers_of(which: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64, grown on demand to the longest word."""
    if len(_powers[which]) < n:
        _powers[which] = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, BASES[which], np.uint64)]))
    return _powers[which]


def chunks(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `size` bytes; a longer text is a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by a space, each word's start and end in it, and the number of words of each text."""
    joined = b" ".join(texts)
    inside = ~_SPACE[np.frombuffer(joined, np.uint8)]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return joined, start, stop, np.diff(np.append(np.searchsorted(start, begin), len(start)))


def word_hashes(joined: bytes | np.ndarray, start: np.ndarray, stop: np.ndarray, many: int) -> list[np.ndarray]:
    """The first `many` (1 or 2) hashes of each word: polynomials over its bytes, and its length, mixed."""
    if not len(start):
        return [np.zeros(0, np.uint64)] * many
    data = (joined if isinstance(joined, np.ndarray) else np.frombuffer(joined, np.uint8))[start[0] :]
    begin, size = start - start[0], stop - start
    gap = np.diff(np.append(begin, len(data)))
    place = np.arange(len(data)) - np.repeat(begin, gap)
    value = np.where(place < np.repeat(size, gap), data.astype(np.uint64) + _U(1), _U(0))
    place = np.minimum(place, size.max() - 1)
    return [mix(np.add.reduceat(value * _powers_of(i, int(size.max()))[place], begin) + size.astype(np.uint64)) for i in range(many)]


def over(hashes: np.ndarray, width: int, by: np.uint64) -> np.ndarray:
    """Hash of each `width` consecutive words, by doubling: the parts' sizes are width's binary digits."""
    out, done, part, size = None, 0, hashes, 1
    while True:
        if width & size:
            n = len(hashes) - width + 1
            out = part[done : done + n] if out is None else mix(out * by + part[done : done + n])
            done += size
        if size * 2 > width:
            return out
        part = mix(part[:-size] * by + part[size:])
        size *= 2
