"""Words of many texts as 64-bit hashes, computed on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Texts are joined up to this many bytes, so that the arrays stay small; a longer text goes alone.
CHUNK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * P1
    return x ^ x >> np.uint64(29)


def byte_values(word_bytes: bytes) -> np.ndarray:
    """A random odd value for each byte that belongs to words (A-Z count as a-z), 0 for others;
    byte 10 separates texts and never belongs to a word."""
    out = np.zeros(256, "u8")
    own = np.frombuffer(word_bytes, "u1")
    out[own] = mixed(own.astype("u8") + np.uint64(0x1234567)) | np.uint64(1)
    out[65:91] = out[97:123]
    out[10] = 0
    return out


_POWERS = mixed(np.arange(1, 65, dtype="u8") * P2) | np.uint64(1)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = mixed(np.arange(1, 2 * n + 1, dtype="u8") * P2) | np.uint64(1)
    return _POWERS


def joined_words(raw: list[bytes], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the offsets at which each text begins (and ends)."""
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", "u1")
    v = values[data]
    inside = v != 0
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    begins = np.cumsum([0] + [len(x) + 1 for x in raw])
    offsets = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, "u8"), offsets
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    parts = v[inside] * powers(int(sizes.max()))[place]
    return mixed(np.add.reduceat(parts, first) + sizes.astype("u8") * P2) | np.uint64(1), offsets


def chunks(raw: list[bytes], values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes, offsets) of the texts, some at a time."""
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK):
            size += len(raw[end])
            end += 1
        yield at, *joined_words(raw[at:end], values)
        at = end
