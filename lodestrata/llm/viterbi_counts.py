"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton gives all pieces that end at each place of a word; the search carries the best score and
how many pieces it took, and nothing else. Ties are those of the tokenizers library's Unigram model: of equal scores
to a place, the piece that starts first stays; an unknown character costs the lowest score less 10, and stands only
where no single-character piece does; neighbouring unknown characters count as one token unless bytes stand for them.

Words start at blanks, which become the mark U+2581; as no piece holds that mark but at its start, a text's count is
the sum of its words' counts, and a word is searched once per worker. The search holds no more places than the longest
piece has characters, so its memory doesn't follow a word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000


class CountModel:
    """Counts the Unigram tokens of texts; vocabulary: [(piece, score)], unknown: the place of the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = True):
        import ahocorasick

        self.scores: dict[str, float] = {}
        for piece, score in vocabulary:
            self.scores[piece] = score  # of a piece listed twice the last counts
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.scores for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            if piece and (MARK not in piece[1:]):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.scores), default=1)
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word, its mark included. Only the places that a piece can still start from are held, in a ring."""
        n, ring = len(word), self.longest + 1
        best, count, open_run = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(word)
        last, (size, score) = next(matches, (n, (0, 0.0)))
        for end in range(1, n + 1):
            top = None
            single = False
            if last == end - 1:
                here = []
                while last == end - 1:
                    here.append((size, score))
                    last, (size, score) = next(matches, (n, (0, 0.0)))
                if len(here) > 1:
                    here.sort(reverse=True)
                for length, worth in here:
                    total = best[(end - length) % ring] + worth
                    if top is None or total > top:
                        top, came, unknown = total, (end - length) % ring, False
                single = here[-1][0] == 1
            if not single:
                before = (end - 1) % ring
                total = best[before] + self.unknown_score
                if top is None or total > top:
                    top, came, unknown = total, before, True
            if not unknown:
                tokens = count[came] + 1
            elif self.bytes:
                tokens = count[came] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            else:
                tokens = count[came] + (not open_run[came])
            now = end % ring
            best[now], count[now], open_run[now] = top, tokens, unknown
        return count[n % ring]

    def count(self, text: str) -> int:
        """Tokens of a text: blanks are marks, one more mark stands in front of a text that has none there."""
        if not text:
            return 0
        known, total = self.known, 0
        for word in text.replace(MARK, " ")[text[0] in (" ", MARK) :].split(" "):
            n = known.get(word)
            if n is None:
                n = self.word(MARK + word)
                if len(word) <= 64:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), float(model.get_score(k))) for k in range(model.get_piece_size())]


_models: dict[int, CountModel] = {}


def counted(docs: DataFrame, vocabulary: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_tokens, n_chars), one row for each row of docs.

    Null and empty texts have no tokens. Repeated rows keep a row each, null ids stay null, extra columns are not
    read. The vocabulary is broadcast; its size is that of a tokenizer file.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, unknown, byte_fallback))
    key = hash((len(vocabulary), unknown, byte_fallback, tuple(vocabulary[:: max(1, len(vocabulary) // 997)])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = CountModel(*shared.value)
        model = _models[key]
        for batch in batches:
            n = [model.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "n_chars"])

    text = F.coalesce("text", F.lit(""))
    chosen = docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    return chosen.mapInArrow(work, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_chars long")
