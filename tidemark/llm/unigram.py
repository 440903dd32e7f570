"""Token counts without tokens: Viterbi over a unigram vocabulary that carries only the best score and its pieces.

An Aho-Corasick automaton names every piece that ends at a character. Scores are added and compared just as the
tokenizers library does: for an end, starts are tried from left to right and only a better score replaces an earlier
one; a character that is no piece of its own costs the lowest score minus 10 and falls back to its bytes. The
pre-tokenizer cuts text before each space, so each distinct word is solved once and then looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, sliced, table

SPACE = "▁"
#: The library's penalty for an unknown character.
UNKNOWN_PENALTY = 10.0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces of a sentencepiece file, in order, with log-probabilities by rank (Zipf), as its own scores are ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    norm = math.log(sum(1 / (r + 2.7) for r in range(size)))
    return tuple((model.id_to_piece(i), -math.log(i + 2.7) - norm) for i in range(size))


class Counter(Memo):
    """Pieces of a word (with the space mark in front)."""

    def __init__(self, vocab, byte_fallback: bool = True):
        import ahocorasick

        super().__init__()

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocab}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))

    def solve(self, word: str) -> int:
        n = len(word)
        score, count, open_run = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        at, found = next(matches, (n, None))
        for end in range(n):
            best, single = None, False
            while at == end:  # the longest piece comes first, which is the leftmost start
                size, value = found
                new = value + score[end + 1 - size]
                if best is None or new > best:
                    best, come = new, end + 1 - size
                single |= size == 1
                at, found = next(matches, (n, None))
            unknown = False
            if not single:
                new = self.unknown + score[end]
                if best is None or new > best:
                    best, come, unknown = new, end, True
            score[end + 1] = best
            if not unknown:
                count[end + 1] = count[come] + 1
            elif self.bytes:
                count[end + 1] = count[come] + len(word[end].encode())
            else:  # a run of unknown characters is one token
                count[end + 1] = count[come] + (not open_run[come])
            open_run[end + 1] = unknown
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = marked.split(SPACE)
        if marked[0] == SPACE:
            words = words[1:]
        return sum(map(self.__getitem__, [SPACE + w for w in words]))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per Python worker, which serves many tasks."""
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens: a row per row of documents (doc_id, text; others are ignored), what the tokenizers library's
    unigram model of the vocabulary at path, with its space-marking pre-tokenizer, gives in tokens. No rows give none."""
    return documents.select("doc_id", "text").mapInArrow(_run(path), "doc_id long, n_tokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
