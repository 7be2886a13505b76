"""Token ids in binary files: byte-level BPE ids, packed by Simple-8b, with per-block offsets.

A file is a row of segments. Segment: the 8 bytes of MAGIC, a header of four unsigned 64-bit numbers (documents, ids,
blocks, words), then doc ids (signed 64-bit), a byte for each saying whether the doc id is null, ids by document
(unsigned 64-bit), block offsets (unsigned 32-bit, one more than blocks), words (unsigned 64-bit), and the crc32 of
all before it; everything little-endian. A line feed follows each segment. Files go out through Spark's committed
text writer, one segment a record, so they reach any store Spark can write and a lost task leaves nothing behind.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.characters import BLANK, codes_of, part_hashes
from lodestrata.llm.common import new_path, slices, stored
from lodestrata.llm.simple8b import decode, encode

MAGIC = b"LSTOK8B1"
#: Ids after which a segment ends (a longer document is a segment of its own), and segments after which a file ends.
SEGMENT_IDS = 1 << 20
FILE_SEGMENTS = 32
#: Rows of one doc_id beyond which they are dealt to several tasks by how their texts begin.
MOST_REPEATS = 100_000
#: Known pieces are dropped when there are so many, which bounds a worker's memory; longer pieces aren't remembered.
CACHE_PIECES = 800_000
LONGEST_KNOWN = 64
#: Characters of texts that are encoded side by side; a longer text goes alone.
BATCH_CHARS = 1 << 19
_CLOSING = ".,!?;:"


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE tokenizer, remembering the pieces between single blanks.

    The pre-tokenizer always cuts before a blank that a non-blank follows, and no merge crosses a cut, so a text's ids
    are its pieces' ids one after another. It also cuts between a letter and a closing mark that ends a piece, so a
    piece with such a mark is put together from two. Pieces are found in all texts of a batch side by side and known by
    two 64-bit hashes, in a table of open addresses; their ids lie in one array. Pieces not seen yet go to the
    tokenizers library many at once, as one text, since each call costs far more than a piece; byte counts tell whose
    the ids are.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        #: Bytes of each token, if tokens are spelled byte by byte; then ids can be told apart by counting bytes.
        self.sizes = None
        if (json.loads(spec).get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, k in self.tokenizer.get_vocab().items():
                self.sizes[k] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.count = self.filled = 0
        self.slots = np.full(1 << (2 * CACHE_PIECES).bit_length(), -1, np.int32)
        self.one, self.two = np.zeros((2, 1 << 16), np.uint64)  # the pieces' hashes
        self.first = np.zeros((1 << 16) + 1, np.int64)  # where a piece's ids begin, and behind the last where they end
        self.ids = np.zeros(1 << 18, np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; -1 for those not known."""
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        slot = (hashes[:, 0] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        one, two = np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1])
        while len(rest):
            there = self.slots[slot]
            same = (self.one[there] == one) & (self.two[there] == two) & (there >= 0)
            out[rest[same]] = there[same]
            going = np.flatnonzero(~same & (there >= 0))
            rest, one, two, slot = rest[going], one[going], two[going], (slot[going] + 1) & (len(self.slots) - 1)
        return out

    def _add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Remember pieces that aren't known yet, each once; ids are theirs one after another."""
        low, high = self.count, self.count + len(hashes)
        if high > len(self.one):
            grown = max(high, 2 * len(self.one))
            self.one, self.two = (np.concatenate([x, np.zeros(grown - len(x), np.uint64)]) for x in (self.one, self.two))
            self.first = np.concatenate([self.first, np.zeros(grown + 1 - len(self.first), np.int64)])
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        self.one[low:high], self.two[low:high] = hashes[:, 0], hashes[:, 1]
        self.first[low : high + 1] = self.filled + np.concatenate([[0], np.cumsum(lengths)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.count, self.filled = high, self.filled + len(ids)
        rest = np.arange(low, high)
        slot = (hashes[:, 0] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(rest):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = rest[free]  # of several for one slot the last has it
            going = self.slots[slot] != rest
            rest, slot = rest[going], (slot[going] + 1) & (len(self.slots) - 1)

    def _taken(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of each) of known pieces."""
        first = self.first[numbers]
        lengths = self.first[numbers + 1] - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        return self.ids[at], lengths

    def _plain(self, pieces: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, how many ids each, the ids) of pieces from the tokenizers library; order says which piece comes when."""
        joined = [k for k, p in enumerate(pieces) if p[:1] == " " and not p[1:2].isspace() and len(p) > 1] if self.sizes is not None else []
        alone = sorted(set(range(len(pieces))).difference(joined)) if len(joined) < len(pieces) else []
        counts, ids = [], []
        for k in range(0, len(joined), 1024):
            part = [pieces[j] for j in joined[k : k + 1024]]
            found = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.sizes[found])
            wanted = np.cumsum([len(p.encode()) for p in part])
            cuts = np.searchsorted(ends, wanted) + 1
            if (ends[cuts - 1] != wanted).any():
                raise ValueError("a token crosses two pieces")
            counts.append(np.diff(cuts, prepend=0))
            ids.append(found)
        rest = self.tokenizer.encode_batch_fast([pieces[k] for k in alone], add_special_tokens=False)
        counts.append(np.array([len(x.ids) for x in rest], np.int64))
        ids.append(np.array([i for x in rest for i in x.ids], np.uint32))
        return joined + alone, np.concatenate(counts), np.concatenate(ids)

    def _learn(self, pieces: list[str], hashes: np.ndarray) -> None:
        """Remember pieces that aren't known yet, each once. Those with a closing mark come from their stem and the mark."""
        marked = np.array([len(p) > 2 and p[-1] in _CLOSING and p[-2].isalpha() for p in pieces], bool)
        new, codes = [p for p, m in zip(pieces, marked.tolist()) if not m], hashes[~marked]
        ends = [p for p, m in zip(pieces, marked.tolist()) if m]
        if ends:
            parts = list({q for p in ends for q in (p[:-1], p[-1])})
            own = _hashes_of(parts)
            fresh = np.flatnonzero((self._find(own) < 0) & ~np.isin(own[:, 0], codes[:, 0]))
            new += [parts[k] for k in fresh.tolist()]
            codes = np.concatenate([codes, own[fresh]])
        if new:
            order, counts, ids = self._plain(new)
            self._add(codes[order], counts, ids)
        if ends:
            stems, marks = self._find(_hashes_of([p[:-1] for p in ends])), self._find(_hashes_of([p[-1] for p in ends]))
            sound = (stems >= 0) & (marks >= 0)  # else another piece has the first hash of one of them
            ids, lengths = self._taken(np.stack([stems[sound], marks[sound]], axis=1).ravel())
            self._add(hashes[marked][sound], lengths.reshape(-1, 2).sum(axis=1), ids)

    def arrays(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many of each), with the end id behind each text if there is one."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(lengths) - lengths
        codes = codes_of(joined)
        begins = np.zeros(len(codes) + 1, bool)
        begins[base] = True
        blank = BLANK[np.minimum(codes, 0xFFFF)]
        cut = (codes[:-1] == 32) & ~blank[1:] & ~begins[1:-1] if len(codes) else codes.astype(bool)
        begins[: max(len(codes) - 1, 0)] |= cut
        starts = np.flatnonzero(begins[:-1])
        stops = np.append(starts[1:], len(codes))[: len(starts)]
        hashes = part_hashes(codes, starts, blanks=True)
        numbers = self._find(hashes)
        short = stops - starts <= LONGEST_KNOWN
        missing = np.flatnonzero((numbers < 0) & short)
        if len(missing):
            if self.count + len(missing) > CACHE_PIECES and self.count:
                self._forget()
                missing = np.flatnonzero(short)
            _, once = np.unique(hashes[missing, 0], return_index=True)
            step = max(1, CACHE_PIECES // 8)
            for low in range(0, len(once), step):
                if self.count >= CACHE_PIECES:  # a text of so many unlike pieces: the others are encoded where they stand
                    break
                chosen = missing[once[low : low + step]]
                self._learn([joined[a:b] for a, b in zip(starts[chosen].tolist(), stops[chosen].tolist())], hashes[chosen])
            numbers = self._find(hashes)
        long = np.flatnonzero(numbers < 0)
        if len(long):  # pieces too long to be remembered, or whose first hash another piece has
            ids, counts = self._mixed(numbers, long, [joined[a:b] for a, b in zip(starts[long].tolist(), stops[long].tolist())])
        else:
            ids, counts = self._taken(numbers)
        upto = np.concatenate([[0], np.cumsum(counts)])
        piece = np.searchsorted(starts, np.append(base, len(codes)))
        per = np.diff(upto[piece])
        if end_id is None:
            return ids, per
        return np.insert(ids, np.cumsum(per), end_id), per + 1

    def _mixed(self, numbers: np.ndarray, long: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts of pieces of which some aren't known; those are given."""
        sizes, ids = [], []
        for low in range(0, len(pieces), 4096):
            found = self.tokenizer.encode_batch_fast(pieces[low : low + 4096], add_special_tokens=False)
            sizes.append(np.array([len(x.ids) for x in found], np.int64))
            ids.append(np.array([i for x in found for i in x.ids], np.uint32))
        known = np.maximum(numbers, 0)
        counts = self.first[known + 1] - self.first[known]
        counts[long] = np.concatenate(sizes)
        mask = np.repeat(numbers < 0, counts)
        out = np.empty(len(mask), np.uint32)
        out[~mask] = self._taken(numbers[numbers >= 0])[0]
        out[mask] = np.concatenate(ids)
        return out, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.arrays(texts)
        data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
        return [data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]


def _hashes_of(pieces: list[str]) -> np.ndarray:
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return part_hashes(codes_of("".join(pieces)), np.cumsum(lengths) - lengths, blanks=True)


_encoders: dict[int, PieceEncoder] = {}


def _encoder(spec: str) -> PieceEncoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(spec)
    return _encoders[key]


def segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = encode(ids)
    body = b"".join(
        [
            MAGIC,
            struct.pack("<4Q", len(doc_ids), len(ids), len(offsets) - 1, len(words)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            counts.astype("<u8").tobytes(),
            offsets.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def segments(content: bytes | pa.Buffer) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, ids by document, all ids) of each segment of a file; raises if a segment is damaged."""
    at, content = 0, memoryview(content)
    while at < len(content):
        if bytes(content[at : at + 8]) != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        docs, n, blocks, n_words = struct.unpack_from("<4Q", content, at + 8)
        end, parts = at + 40, []
        for kind, size in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks + 1), ("<u8", n_words)):
            parts.append(np.frombuffer(content, kind, size, end))
            end += parts[-1].nbytes
        if zlib.crc32(content[at:end]) != struct.unpack_from("<I", content, end)[0]:
            raise ValueError(f"damaged segment at byte {at}")
        names = [None if gone else int(d) for d, gone in zip(parts[0], parts[1])]
        yield names, parts[2].astype(np.int64), decode(parts[4], parts[3], n)
        at = end + 5


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, path: str | None = None, segment_ids: int = SEGMENT_IDS) -> str:
    """Encode every text and write the files, in ascending doc_id order over all files; gives their folder.

    Null texts count as empty, so they hold the end id alone. Rows without doc_id come first; of rows with one doc_id
    the order is that of the texts, and such rows may go to several tasks. A file ends after FILE_SEGMENTS segments, so
    its size is bounded, but for longer documents. Extra columns are not read. An empty table gives a folder without
    segments.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # ids of documents, how many token ids each has, these
        size = 0

        def flush() -> pa.RecordBatch:
            names, counts, ids = zip(*held)
            data = segment(pa.concat_arrays(names).to_pylist(), np.concatenate(counts), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for batch in batches:
            for part in slices(batch, 1, BATCH_CHARS):
                ids, counts = encoder.arrays([t or "" for t in part.column(1).to_pylist()], end_id)
                ends = np.cumsum(counts)
                low = at = 0
                while low < len(counts):  # as many documents as fill the segment
                    high = min(len(counts), int(np.searchsorted(ends, at + segment_ids - size)) + 1)
                    held.append((part.column(0).slice(low, high - low), counts[low:high], ids[at : ends[high - 1]]))
                    size += int(ends[high - 1]) - at
                    low, at = high, int(ends[high - 1])
                    if size >= segment_ids:
                        yield flush()
                        held.clear()
                        size = 0
        if held:
            yield flush()

    path = path or new_path(spark, "tokens")
    first = F.col("doc_id").asc_nulls_first()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if named.groupBy("doc_id").count().where(F.col("count") > MOST_REPEATS).head(1):
        ranged = named.withColumn("head", F.substring("text", 1, 32)).repartitionByRange(first, "head").drop("head")
    else:  # then the ranges can be told from the ids alone, without reading texts for it
        ranged = named.repartitionByRange(first)
    ordered = ranged.sortWithinPartitions(first, "text")
    lines = ordered.mapInArrow(run, "value binary").select(F.expr("cast(value as string)").alias("value"))
    lines.write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, local, n_tokens, ids_crc32) of each document, all from the files; local counts the file's ids before it.

    file puts the files in the order of their documents. A task holds one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = 0
                for names, counts, ids in segments(content.as_buffer()):
                    ends = np.cumsum(counts)
                    data = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends, counts)]
                    columns = [pa.array([file] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array(at + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "local", "n_tokens", "ids_crc32"])
                    at += int(ends[-1]) if len(ends) else 0

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    files = files.select((number(r"part-(\d+)[^/]*$") * (1 << 24) + number(r"-c(\d+)[^/]*$")).alias("file"), "content")
    return files.mapInArrow(run, "file long, doc_id long, local long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, path: str | None = None) -> DataFrame:
    """Write the files and give (doc_id, start, n_tokens, ids_crc32) as read back; start counts the ids of all documents before."""
    spark = docs.sparkSession
    rows, _ = stored(read(spark, write(docs, tokenizer_path, end_id, path)), "token-index")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row for each file
    return rows.join(sums, "file").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
