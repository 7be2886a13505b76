"""Texts as arrays of characters, and hashes of their parts made for all of them side by side."""

from __future__ import annotations

import numpy as np

#: Characters that are hashed at once.
HASH_CHARS = 1 << 18
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASES = (0xD1342543DE82EF95, 0xDA942042E4DD58B5)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C
    return x ^ (x >> np.uint64(29))


def table(characters: str) -> np.ndarray:
    """Which of the first 2**16 code points are among the characters."""
    out = np.zeros(1 << 16, bool)
    out[[ord(c) for c in characters]] = True
    return out


BLANK = table("".join(chr(k) for k in range(1 << 16) if chr(k).isspace()))


def _characters(codes: np.ndarray, lane: int) -> np.ndarray:
    return mix((codes.astype(np.uint64) + np.uint64(1)) * (A, B)[lane])


_EVERY = [_characters(np.arange(1 << 16), lane) for lane in (0, 1)]
_INK = [np.where(BLANK, np.uint64(0), every) for every in _EVERY]
_POWERS = [np.cumprod(np.r_[np.uint64(1), np.full(HASH_CHARS - 1, base, np.uint64)]) for base in _BASES]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


#: The same for bytes: without those that stand for blanks of ASCII, and in lower case as far as ASCII goes.
BYTE_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
BYTES = [np.where(BYTE_BLANK, np.uint64(0), every[np.frombuffer(bytes(range(256)).lower(), np.uint8)]) for every in _EVERY]


def part_hashes(codes: np.ndarray, starts: np.ndarray, blanks: bool = False, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Two 64-bit hashes of each part (from its start to the next one's), without its blanks unless ``blanks``.

    They are sums over characters, so that a long part is summed up piece by piece. ``tables`` are what each code adds;
    given one alone, there is one hash.
    """
    tables = tables or (_EVERY if blanks else _INK)
    out = np.zeros((len(starts), len(tables)), np.uint64)
    for low in range(0, len(codes), HASH_CHARS):
        part = codes[low : low + HASH_CHARS]
        first, end = np.searchsorted(starts, [low, low + len(part)])
        own = starts[first:end] - low
        goes_on = first > 0 and (first == end or own[0] > 0)
        if goes_on:
            own = np.r_[0, own]
        if not len(own):
            continue
        part = part[own[0] :]
        own = own - own[0]
        turn = np.arange(len(part)) - np.repeat(own, np.diff(np.r_[own, len(part)]))
        place = part if part.dtype == np.uint8 else np.minimum(part, 0xFFFF)
        rare = np.flatnonzero(part > 0xFFFF) if part.dtype != np.uint8 else place[:0]
        for lane in range(len(tables)):
            value = tables[lane][place]
            if len(rare):
                value[rare] = _characters(part[rare], lane)
            sums = np.add.reduceat(value * _POWERS[lane][turn], own)
            if goes_on:
                out[first - 1, lane : lane + 1] += sums[:1] * np.uint64(pow(_BASES[lane], int(low - starts[first - 1]), 1 << 64))
                sums = sums[1:]
            out[first:end, lane] = sums
    return mix(out)
