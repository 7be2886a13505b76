"""Only windows that are there twice get into suffix arrays."""

import random

import numpy as np
import pytest

from lodestrata.llm import suffix_dedup


def test_windows_left_out_are_there_once(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 90)
    for most in (10**6, 0):
        monkeypatch.setattr(suffix_dedup, "COUNTED_BYTES", most)
        for _ in range(60):
            pieces = [bytes(rng.choice(b"ab") for _ in range(rng.choice([10, 11, 30, 80]))) for _ in range(rng.randrange(1, 9))]
            windows = [(p[k : k + 10], n, k) for n, p in enumerate(pieces) for k in range(len(p) - 9)]
            times = {}
            for w, _, _ in windows:
                times[w] = times.get(w, 0) + 1
            runs, piece, start = suffix_dedup._repeated(pieces, 10)
            assert all(pieces[n][k : k + len(r)] == r for r, n, k in zip(runs, piece.tolist(), start.tolist()))
            left = {(n, k + j) for r, n, k in zip(runs, piece.tolist(), start.tolist()) for j in range(len(r) - 9)}
            wanted = {(n, k) for w, n, k in windows if times[w] > 1}
            assert left == wanted if most else left >= wanted


@pytest.mark.parametrize("array_bytes", [3 << 20, 600])
def test_bytes_sorted_are_those_of_repeats(monkeypatch, array_bytes):
    """Texts that share strings of 20 bytes, and two of them one of 80: the sorted bytes are some 80 for each of the two."""
    rng = random.Random(9)
    made = lambda n: bytes(rng.choice(b"abcdefghijklmnop") for _ in range(n))
    shared, passage = made(20), made(80)
    segments = [made(40) + shared + made(40) for _ in range(30)]
    segments[3], segments[17] = segments[3] + passage + made(9), made(7) + passage + segments[17]
    sorted_bytes = []
    whole = suffix_dedup.Shard
    monkeypatch.setattr(suffix_dedup, "Shard", lambda pieces, owners, width: sorted_bytes.append(sum(map(len, pieces))) or whole(pieces, owners, width))
    import zlib

    import pyarrow as pa

    place = np.stack([np.arange(30), np.zeros(30)], axis=1).astype("<i4").tobytes()
    owners = np.arange(30).astype("<i8").tobytes() + place + np.full(30, 5, "<u4").tobytes()
    row = [[1], [0], [None], [owners], [np.array([len(s) for s in segments], "<i4").tobytes()], [zlib.compress(b"".join(segments))]]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["route", "shard", "cuts", "owners", "lengths", "bytes"])
    cuts = [np.frombuffer(x, "<i4").reshape(-1, 3).tolist() for b in suffix_dedup._cut_classes(50, array_bytes)(iter([batch])) for x in b.column(1).to_pylist()]
    assert cuts == [[[17, 7, 80]]]
    assert sum(sorted_bytes) == 160
