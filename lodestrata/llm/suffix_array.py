"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, and merging by binary search."""

from __future__ import annotations

import numpy as np

PAD = 72


def padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(PAD), np.uint8)


def words_at(text: np.ndarray, at: np.ndarray | None = None, big: bool = True) -> np.ndarray:
    """The eight bytes from each place as one number; big-endian numbers order as the bytes do."""
    view = np.ndarray((len(text) - 7,), ">u8" if big else "<u8", text, strides=(1,))
    return (view if at is None else view[at]).astype(np.uint64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of text (padded) in order of the suffixes that start there.

    The first order is by eight bytes. Each round sorts only the groups that are still tied, by the rank of the place
    as far on as is sorted already, which doubles the sorted depth. Kasai's walk needs the order in full, so rounds go on until nothing is tied.
    """
    n = len(text) - PAD
    key = words_at(text)[:n]
    order = np.argsort(key)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    firsts = np.flatnonzero(head)
    rank = np.zeros(n + PAD, np.int64)
    rank[order] = firsts[np.cumsum(head) - 1] + 1
    sorted_to = 8
    while True:
        sizes = np.diff(np.append(np.flatnonzero(head), n))
        tied = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        places = order[at]
        on = places + sorted_to
        further = np.where(on < n, rank[np.minimum(on, n)] + sorted_to, n - places)  # of suffixes that end, the shorter is less
        pair = (rank[places].astype(np.uint64) << np.uint64(32)) | further.astype(np.uint64)
        by = np.argsort(pair)
        pair = pair[by]
        order[at] = places[by]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        head[at] = new
        starts = np.flatnonzero(new)
        rank[order[at]] = at[starts[np.cumsum(new) - 1]] + 1
        sorted_to *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """How many bytes, ``most`` at most, each suffix shares with the one before it in order.

    Kasai's walk in text order: a place shares at least one byte less than the place before it did. The text is cut
    into lanes that walk side by side; within a lane only bytes not known to be shared are compared, eight at a time.
    """
    n = len(order)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = words_at(text, big=False)
    step = -(-n // lanes)
    at = np.arange(0, n, step)
    stop = np.minimum(at + step, n)
    shared = np.zeros(len(at), np.int64)
    plcp = np.zeros(n, np.int32)
    while len(at):
        other = before[at]
        shared = np.maximum(shared - 1, 0)
        shared[other < 0] = 0
        going = np.flatnonzero((other >= 0) & (shared < most))
        while len(going):
            a, b = at[going] + shared[going], other[going] + shared[going]
            differ = words[a] ^ words[b]
            low = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
            room = n - np.maximum(at[going], other[going])
            shared[going] = np.minimum(np.minimum(shared[going] + equal, room), most)
            going = going[(equal == 8) & (shared[going] < most) & (shared[going] < room)]
        plcp[at] = shared
        at = at + 1
        on = at < stop
        at, stop, shared = at[on], stop[on], shared[on]
    out[:] = plcp[order]
    return out


def lower_bound(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """By binary search: for each row of wanted the first row of keys that isn't smaller; rows are compared as words."""
    first = np.ascontiguousarray(keys[:, 0])  # sorted as well, which narrows the search to the rows that share it
    low, high = (np.searchsorted(first, wanted[:, 0], side) for side in ("left", "right"))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        less = np.zeros(len(open_), bool)
        same = np.ones(len(open_), bool)
        for c in range(keys.shape[1]):
            a, b = keys[middle, c], wanted[open_, c]
            less |= same & (a < b)
            same &= a == b
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


class Shard:
    """Sorted classes of equal windows of one shard: their bytes as words, their least owner, and who is in them."""

    def __init__(self, segments: list[bytes], owners: np.ndarray, width: int):
        lengths = np.array([len(s) for s in segments], np.int64)
        data = b"".join(segments)
        text = padded(data)
        ends = np.cumsum(lengths)
        segment = np.repeat(np.arange(len(segments)), lengths)
        order = suffix_array(text)
        lcp = common_prefixes(text, order, width)
        whole = np.arange(len(data)) + width <= ends[segment] if len(data) else np.zeros(0, bool)
        group = np.cumsum(lcp < width)
        chosen = whole[order]
        self.places = order[chosen]
        group = group[chosen]
        head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        firsts = np.flatnonzero(head)
        self.class_of = np.cumsum(head) - 1
        self.segment = segment[self.places]
        self.offset = self.places - (ends - lengths)[self.segment]
        owner = owners[self.segment]
        self.least = np.minimum.reduceat(owner, firsts) if len(firsts) else np.zeros(0, np.int64)
        self.keys = np.stack([words_at(text, self.places[firsts] + min(8 * c, width - 8)) for c in range(-(-width // 8))], axis=1)


def merged_least(shards: list[Shard]) -> list[np.ndarray]:
    """For each shard's classes the least owner over all shards; each shard is searched in the sorted union so far."""
    keys, least = shards[0].keys, shards[0].least
    if len(shards) == 1:
        return [least]
    for shard in shards[1:]:
        at = lower_bound(keys, shard.keys)
        inside = np.minimum(at, max(len(keys) - 1, 0))
        known = (at < len(keys)) & (keys[inside] == shard.keys).all(axis=1) if len(keys) else np.zeros(len(at), bool)
        least = least.copy()
        np.minimum.at(least, at[known], shard.least[known])
        keys = np.insert(keys, at[~known], shard.keys[~known], axis=0)
        least = np.insert(least, at[~known], shard.least[~known])
    return [least[lower_bound(keys, s.keys)] for s in shards]
