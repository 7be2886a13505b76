"""Simple-8b word-aligned coding of token ids, vectorised over blocks.

A 64-bit word has a selector in its top 4 bits and 60 bits of payload. Blocks of 1024 ids start on a word of their
own, so encoding and decoding run over all blocks side by side. Selector 1 is the escape: the next word is one id in
full, for ids of over 60 bits. A block's last word may stand for more ids than are left; the reader knows the count
and leaves the others out.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Ids in a word and bits of each, by selector; 0 bits: all ids are zero. Selector 1 is the escape.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 1
MOST = 240


_SHORT = np.array([int(k).bit_length() for k in range(1 << 8)], np.uint8)
_SHORT = np.concatenate([_SHORT, np.repeat(np.arange(9, 17, dtype=np.uint8), 1 << np.arange(8, 16))])


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or int(ids.max()) < 1 << 16:
        return _SHORT[ids]
    out = _SHORT[ids & np.uint64(0xFFFF)]
    for shift in (16, 32, 48):
        part = (ids >> np.uint64(shift)) & np.uint64(0xFFFF)
        np.copyto(out, _SHORT[part] + np.uint8(shift), where=part > 0)
    return out


def _selectors(lengths: np.ndarray) -> np.ndarray:
    """For each place the selector that holds most ids from there; lengths is padded by MOST zeros.

    If a selector fits, so does each one of fewer ids, so those that fit are counted down from the last.
    """
    n = len(lengths) - MOST
    best = np.full(n, 15, np.uint8)
    widest, span = lengths, 1
    for selector in range(14, 1, -1):
        count = int(COUNTS[selector])
        while span < count:
            step = min(span, count - span)
            widest = np.maximum(widest[: len(widest) - step], widest[step:])
            span += step
        best -= (widest[:n] <= BITS[selector]).view(np.uint8)
    while span < MOST:
        step = min(span, MOST - span)
        widest = np.maximum(widest[: len(widest) - step], widest[step:])
        span += step
    best[widest[:n] == 0] = 0
    best[lengths[:n] > 60] = ESCAPE
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, offsets uint32): offsets has the first word of each block, and the number of words at its end."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    flat = np.zeros(n + MOST, np.uint64)
    flat[:n] = ids
    best = _selectors(bit_lengths(flat))
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    starts = []
    while len(at):
        starts.append(at)
        at = at + COUNTS[best[at]]
        going = at < end
        at, end = at[going], end[going]
    start = np.sort(np.concatenate(starts))
    selector = best[start]
    slots = 1 + (selector == ESCAPE)
    first = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        code = np.full(len(own), np.uint64(s) << np.uint64(60))
        if s == ESCAPE:
            words[first[own] + 1] = flat[start[own]]
        elif BITS[s]:
            for k in range(COUNTS[s]):
                code |= flat[start[own] + k] << np.uint64(k * BITS[s])
        words[first[own]] = code
    per_block = np.bincount(start // BLOCK, slots, blocks)
    return words, np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids, from the words and block offsets."""
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros((len(offsets) - 1) * (BLOCK + MOST), np.uint64)
    raw = _raw_words(words, offsets)
    heads = np.flatnonzero(~raw)
    selector = (words[heads] >> np.uint64(60)).astype(np.int64)
    block = np.searchsorted(offsets[1:-1], heads, side="right")
    filled = np.concatenate([[0], np.cumsum(COUNTS[selector])])
    base = filled[np.searchsorted(heads, offsets[:-1])]
    start = filled[:-1] - base[block] + block * (BLOCK + MOST)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[start[own]] = words[heads[own] + 1]
        elif BITS[s]:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            place, code = start[own], words[heads[own]]
            for k in range(COUNTS[s]):
                out[place + k] = (code >> np.uint64(k * BITS[s])) & mask
    return out.reshape(-1, BLOCK + MOST)[:, :BLOCK].ravel()[:n]


def _raw_words(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words follow an escape. Where raw ids may look like escapes, the runs are walked in order."""
    escapes = (words >> np.uint64(60)) == ESCAPE
    raw = np.zeros(len(words), bool)
    last = -2
    for k in np.flatnonzero(escapes):
        if k != last + 1:
            raw[k + 1] = True
            last = k
    return raw
