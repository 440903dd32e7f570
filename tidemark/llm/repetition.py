"""Quality rules on repetition: the share of a text's characters inside repeated lines and word n-grams.

Windows of several lengths are compared by rolling hashes over word hashes, in numpy, all texts of a batch at a time: the
hash of a window comes from that of the one a word shorter, and only windows whose shorter one is repeated can be
repeated themselves. What counts for lines and for n-grams of five to ten words is their second and later occurrences;
for two to four words it is all occurrences of the n-gram that covers most. Thresholds are those commonly used for web
text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced_by_bytes, table
from .shingles import ODD, Words, mixed

# Largest shares that are kept, from published web-text filtering rules.
MAX_DUP_LINE_CHARS = 0.20
MAX_TOP = {2: 0.20, 3: 0.18, 4: 0.16}
MAX_DUP = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BLANKS = " \t\n\x0b\x0c\r"

MEASURES = ["dup_line_chars", *(f"top_{k}" for k in MAX_TOP), *(f"dup_{k}" for k in MAX_DUP)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in one of the windows that begin at starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0


def repeat_words(words: list[str]) -> int:
    """Words inside three-word windows that are found twice or more, compared exactly."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-1] * len(number) + ids[1:]
    pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * np.int64(len(number)) + ids[2:], return_inverse=True, return_counts=True)
    return int(covered(np.flatnonzero(count[at] > 1), 3, n).sum())


def repeated_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word that are equal to an earlier one, and the characters of their words."""
    if not text or "\n" not in text:
        return 0, 0
    known: set[str] = set()
    n = chars = 0
    for line in text.split("\n"):
        if line in known:
            n += 1
            chars += len(line) - sum(map(line.count, _BLANKS))
        elif line.strip(_BLANKS):
            known.add(line)
    return n, chars


def judge_all(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base figures, measures, base_failed and kept of each text."""
    w, n_texts = Words(texts, lower=False), len(texts)
    at, plain = w.of_text, texts.to_pylist()
    n = np.diff(at)
    text = np.repeat(np.arange(n_texts), n)
    chars = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]
    size = chars[w.end] - chars[w.begin]
    of_text = lambda x: np.bincount(text, x, minlength=n_texts).astype(np.int64)
    total, ends, symbols = of_text(size), np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(_SYMBOLS[w.data])]
    lines = np.array([repeated_lines(t) for t in plain], np.int64).reshape(n_texts, 2)
    share = lambda x: np.where(total > 0, x / np.maximum(total, 1), 0.0)
    out = {"n_words": n, "word_chars": total, "n_symbols": symbols[w.edges[1:]] - symbols[w.edges[:-1]], "n_dup_lines": lines[:, 0], "n_repeat_words": np.zeros(n_texts, np.int64)}
    out |= dict.fromkeys(MEASURES, np.zeros(n_texts)) | {"dup_line_chars": share(lines[:, 1])}

    hashes, stop = w.hashes(), at[1:][text]
    start, rolling = np.arange(len(hashes)), hashes
    salt = mixed(np.arange(1, n_texts + 1, dtype=np.uint64) * ODD)
    for k in range(2, max(MAX_DUP) + 1):
        fit = start + k <= stop[start]
        start, rolling = start[fit], rolling[fit]
        if not len(start):
            break
        rolling = rolling * ODD + hashes[start + k - 1]
        key = mixed(rolling) ^ salt[text[start]]
        order = np.argsort(key, kind="stable")
        first = np.r_[True, key[order[1:]] != key[order[:-1]]]
        group = np.cumsum(first) - 1
        count = np.bincount(group)
        twice = count[group] > 1
        if k in MAX_TOP:
            begin, times = start[order[first]], count
            begin, times = begin[times > 1], times[times > 1]
            best = np.zeros(n_texts, np.int64)
            np.maximum.at(best, text[begin], times * (ends[begin + k] - ends[begin]))
            out[f"top_{k}"] = np.minimum(1.0, share(best))
        else:
            out[f"dup_{k}"] = share(of_text(size * covered(start[order[~first]], k, len(hashes))))
        if k == 3:
            inside = start[order[twice]]
            out["n_repeat_words"] = of_text(covered(inside, 3, len(hashes)))
            words = inside[:, None] + np.arange(3)
            other = w.hashes(w.begin[words].reshape(-1), w.end[words].reshape(-1), seed=1).reshape(-1, 3)
            unlike = (group[twice][1:] == group[twice][:-1]) & (other[1:] != other[:-1]).any(axis=1)
            for i in np.unique(text[inside[1:][unlike]]):  # two windows of one hash: this text word by word
                out["n_repeat_words"][i] = repeat_words(_WORD.findall(plain[i]))
        again = np.sort(order[twice])
        start, rolling = start[again], rolling[again]

    out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    limits = [MAX_DUP_LINE_CHARS, *MAX_TOP.values(), *MAX_DUP.values()]
    return out | {"kept": ~out["base_failed"] & np.all([out[m] <= limit for m, limit in zip(MEASURES, limits, strict=True)], axis=0)}


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced_by_bytes(batches, 1):
        found = judge_all(batch.column(1))
        names = [*BASE, "base_failed", "kept", *MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c]) for c in names)], ["doc_id", *names])


def repetition(documents: DataFrame) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and the measures: a row per row of documents (doc_id, text; others
    are ignored). A null or empty text has no words and fails. Rows may repeat; no rows give no rows."""
    fields = ["doc_id long", *(f"{c} long" for c in BASE), "base_failed boolean", "kept boolean", *(f"{c} double" for c in MEASURES)]
    return documents.select("doc_id", "text").mapInArrow(_run, ", ".join(fields))


def op4_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))
