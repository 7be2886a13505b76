"""Substring dedup by sliding sentence spans.

A text is cut into sentences; every run of three consecutive ones is hashed, the hashes meet across the corpus, and
each run's first place (smallest doc_id, then first in the text) is kept. A sentence that any other occurrence of a
repeated run covers is removed. Long sentences are cut into pieces of 4 to 12 words where their own words say, so that
cuts fall alike in a repeated passage whatever stands before it in its sentence, and one of over 50 words nearly always holds a whole run.

Texts go through in batches, as arrays of characters: words, ends of sentences, cuts and hashes are found for all
texts of a batch side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.characters import BLANK, A, B, codes_of, mix, part_hashes, table
from lodestrata.llm.common import slices, stored

#: Full stops that no blank has to follow; with quotes and brackets after them they end a word as well.
_STOPS = "。…"
_INNER = re.compile(r"[。…]+[\"'”’)\]]*(?=\S)")
_MARKS = ".!?" + _STOPS
_QUOTES = "\"'”’)]"
#: Words of the shortest piece of a long sentence, and of the longest.
LEAST_WORDS = 4
MOST_WORDS = 12
#: Characters that go through together; a longer text goes alone.
BATCH_CHARS = 1 << 19


_QUOTE, _MARK = table(_QUOTES), table(_MARKS)


def _lower(text: str) -> str:
    """The text in lower case, but for the few letters that would become two."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _places(pairs: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Places before which words are cut: ``starts`` (of the sentences, the last one their end) and cuts inside long sentences.

    A long sentence is cut where a word and the one before it have the least hash of seven places. What lies over
    ``most`` words apart is cut again, each time at the least hash from 4 to ``most`` words on. So all cuts after the
    first place that three words on either side decide depend on the words since that place alone.
    """
    least = np.ones(len(pairs), bool)
    for k in range(1, LEAST_WORDS):
        least[k:] &= pairs[k:] < pairs[:-k]
        least[:-k] &= pairs[:-k] <= pairs[k:]
    cuts = np.flatnonzero(least)
    of = np.searchsorted(starts, cuts, "right") - 1
    low, high = starts[of], starts[np.minimum(of + 1, len(starts) - 1)]
    chosen = np.zeros(len(pairs) + 1, bool)
    chosen[starts] = True
    chosen[cuts[(cuts - low >= LEAST_WORDS) & (high - cuts >= LEAST_WORDS) & (high - low > most)]] = True
    places = np.flatnonzero(chosen)
    more = []
    for k in np.flatnonzero(np.diff(places) > most).tolist():
        last, end = int(places[k]), int(places[k + 1])
        while end - last > most:
            low = last + LEAST_WORDS
            last = low + int(pairs[low : min(last + most, end - LEAST_WORDS) + 1].argmin())
            more.append(last)
    chosen[more] = True
    return np.flatnonzero(chosen) if more else places


def _pairs(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint64)
    out[1:] = mix(hashes[:-1, 0] * A + hashes[1:, 0] * B)
    return out


def _cuts(words: list[str], most: int = MOST_WORDS) -> list[int]:
    """Places inside one sentence before which it is cut."""
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
    return _places(_pairs(part_hashes(codes_of(_lower(" ".join(words))), starts)), np.array([0, len(words)]), most)[1:-1].tolist()


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every word of the texts in lower case; code is a 64-bit hash."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = codes_of("".join(map(_lower, texts)))
    begins = np.zeros(len(codes) + 1, bool)
    base = np.cumsum(lengths) - lengths
    begins[base] = True
    blank = BLANK[np.minimum(codes, 0xFFFF)]
    begins[1:-1] |= blank[:-1]
    begins[:-1] &= ~blank
    starts = np.flatnonzero(begins[:-1])
    text = np.searchsorted(base, starts, "right") - 1
    return text, part_hashes(codes, starts)[:, 0]


class Pieces:
    """The pieces of some texts: ``text`` they belong to, ``begin`` and ``end`` in characters, ``words`` in them, two ``lanes`` of hashes.

    A text's pieces join to it again. A text of blanks alone is one piece without words.
    """

    def __init__(self, texts: list[str], most: int = MOST_WORDS):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(lengths) - lengths
        joined = "".join(texts)
        codes = codes_of(joined)
        n = len(codes)
        begins = np.zeros(n + 1, bool)
        begins[base] = True
        place = np.minimum(codes, 0xFFFF).astype(np.uint16)
        blank = BLANK[place]
        begins[1:n] |= blank[: n - 1]
        begins[:n] &= ~blank
        if any(c in joined for c in _STOPS):
            for k, text in enumerate(texts):
                if any(c in text for c in _STOPS):
                    begins[[int(base[k]) + m.end() for m in _INNER.finditer(text)]] = True
        starts = np.flatnonzero(begins[:n])
        total = len(starts)
        # The last characters of the words, and before them what isn't a quote or bracket.
        lasts = np.flatnonzero(~blank & (np.r_[blank[1:], True] | np.r_[begins[1:n], True])) if n else starts
        marks = lasts.copy()
        quoted = np.flatnonzero(_QUOTE[place[marks]])
        while len(quoted):
            marks[quoted] -= 1
            quoted = quoted[marks[quoted] >= starts[quoted]]
            quoted = quoted[_QUOTE[place[marks[quoted]]]]
        ends = (marks >= starts) & _MARK[place[marks]]
        after = np.searchsorted(starts, np.flatnonzero(place == 10)) - 1
        ends[after[after >= 0]] = True
        del marks, lasts, blank, place
        text_of = np.searchsorted(base, starts, "right") - 1 if total else starts
        firsts = np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]]) if total else starts
        sentences = np.zeros(total + 1, bool)
        sentences[firsts] = sentences[total] = True
        sentences[1:] |= ends
        sentences = np.flatnonzero(sentences)
        hashes = part_hashes(codes_of("".join(map(_lower, texts))), starts)
        places = _places(_pairs(hashes), sentences, most) if total else sentences
        low, high = places[:-1], places[1:]
        text = text_of[low]
        size = high - low
        limit = np.r_[starts, n][high] - base[text]
        ends_text = np.r_[text[1:] != text[:-1], True] if total else text.astype(bool)
        end = np.where(ends_text, lengths[text], limit)
        begin = np.where(np.r_[True, text[1:] != text[:-1]] if total else ends_text, 0, starts[low] - base[text])
        if total:
            turn = (np.arange(total) - np.repeat(low, size)).astype(np.uint64)
            lanes = [np.add.reduceat(mix(hashes[:, k] + (turn + np.uint64(1)) * c), low) for k, c in ((0, A), (1, B))]
        else:
            lanes = [np.zeros(0, np.uint64)] * 2
        wordless = np.ones(len(texts), bool)
        wordless[text] = False
        blanks = np.flatnonzero(wordless & (lengths > 0))
        if len(blanks):
            none = np.zeros(len(blanks), np.int64)
            text, begin, end, size = (np.concatenate(x) for x in ((text, blanks), (begin, none), (end, lengths[blanks]), (size, none)))
            lanes = [np.concatenate([x, none.astype(np.uint64)]) for x in lanes]
            order = np.argsort(text, kind="stable")
            text, begin, end, size = text[order], begin[order], end[order], size[order]
            lanes = [x[order] for x in lanes]
        self.text, self.begin, self.end, self.words, self.lanes = text, begin, end, size, lanes
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))  # of each text its first piece

    def runs(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, at, h1, h2) of every run of ``run`` neighbouring pieces of a text; at is its first piece's place in the text."""
        n = len(self.text) - run + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        same = np.flatnonzero((self.text[:n] == self.text[run - 1 :]) & (self.words[:n] > 0))
        out = []
        for lane, c in zip(self.lanes, (A, B)):
            code = np.full(len(same), np.uint64(run))
            for k in range(run):
                code = mix(code * c + lane[same + k])
            out.append(code.view(np.int64))
        return self.text[same], same - self.first[self.text[same]], *out


def sentences(text: str, most_words: int = MOST_WORDS) -> list[str]:
    """The text in pieces that join to it again."""
    found = Pieces([text], most_words)
    return [text[a:b] for a, b in zip(found.begin.tolist(), found.end.tolist())]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))


def spans(docs: DataFrame, run: int = 3) -> DataFrame:
    """(h1, h2, i, t, at): every run of sentences; i and t name the document and its text, at is the run's first sentence."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, BATCH_CHARS):
                row, at, h1, h2 = Pieces(part.column(2).to_pylist()).runs(run)
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), part.column(0).take(index), part.column(1).take(index), pa.array(at, pa.int32())], ["h1", "h2", "i", "t", "at"])

    keyed = _keyed(docs)
    return keyed.mapInArrow(work, f"h1 long, h2 long, i {keyed.schema['i'].dataType.simpleString()}, t long, at int")


def deduplicated(docs: DataFrame, run: int = 3) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed_words, text), one row for each row of docs; text is what is left.

    Texts of fewer than ``run`` sentences hold no run and stay whole, as do texts of blanks alone; null texts count as
    empty. Rows that repeat a doc_id and text are one document: their runs repeat only if they do within the text. Rows
    without doc_id come last. Repeats within a text count: the first place stays. Extra columns are not read.
    """
    found = spans(docs, run)
    order = F.struct(F.col("i").isNull().alias("last"), "i", "t", "at")
    repeated = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    # Written out, so that the join deals both sides anew and a hot run's rows can be split over tasks.
    repeated, _ = stored(repeated.drop("n"), "repeated")
    later = found.join(repeated, ["h1", "h2"])
    same = F.col("i").eqNullSafe(F.col("first.i")) & (F.col("t") == F.col("first.t")) & (F.col("at") == F.col("first.at"))
    cuts = later.where(~same).groupBy("i", "t").agg(F.collect_set("at").alias("cuts"))
    cuts = cuts.select(F.col("i").alias("ci"), F.col("t").alias("ct"), "cuts")
    rows = _keyed(docs)
    rows = rows.join(cuts, rows.i.eqNullSafe(cuts.ci) & (rows.t == cuts.ct), "left").select("i", "text", "cuts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BATCH_CHARS):
                texts = part.column(1).to_pylist()
                pieces = Pieces(texts)
                gone = np.zeros(len(pieces.text) + run, bool)
                cut = part.column(2)
                sizes = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False)
                at = np.repeat(pieces.first[:-1], sizes) + cut.flatten().to_numpy(zero_copy_only=False)
                for k in range(run):
                    gone[at + k] = True
                gone = gone[: len(pieces.text)]
                first = pieces.first
                kept = list(texts)
                for k in np.flatnonzero(sizes).tolist():
                    own = slice(first[k], first[k + 1])
                    stays = ~gone[own]
                    kept[k] = "".join([texts[k][a:b] for a, b in zip(pieces.begin[own][stays].tolist(), pieces.end[own][stays].tolist())])
                upto = np.concatenate([[0], np.cumsum(gone)])
                words = np.concatenate([[0], np.cumsum(np.where(gone, pieces.words, 0))])
                columns = [np.diff(first), np.diff(upto[first]), np.diff(words[first])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(kept, pa.string())], ["doc_id", "n_sentences", "n_removed", "removed_words", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_sentences long, n_removed long, removed_words long, text string")
