"""Words and word shingles as 64-bit hashes, computed over whole Arrow batches with numpy (runs inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WIDTH = 5
#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 512
ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.arange(256, dtype=np.uint8)
_SPACE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` word hashes, as a polynomial in an odd number, then mixed."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        if n > 0:
            out = out * ODD + words[k : k + n]
    return mixed(out)


class Words:
    """The words of a batch of texts (null: none), split at ASCII white space: where each begins and ends among the bytes
    `data` of all texts, and the number of the first word of each text and of the end."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.data, self.edges = _LOWER[data] if lower else data, at - at[0]
        word = ~_SPACE[data]
        inner = self.edges[(self.edges > 0) & (self.edges < len(data))]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[inner], last[inner - 1] = word[inner], word[inner - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of_text = np.searchsorted(self.begin, self.edges)
        self.eight = None

    def hashes(self, begin: np.ndarray | None = None, end: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word, or of other stretches of the bytes, eight bytes at a time."""
        begin, end = (self.begin, self.end) if begin is None else (begin, end)
        size = end - begin
        if self.eight is None:
            self.eight = np.ndarray(len(self.data) + 1, "<u8", np.r_[self.data, np.zeros(8, np.uint8)].tobytes(), strides=(1,))
        out = size.astype(np.uint64) * ODD + np.uint64(seed)
        on = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        k = 0
        while len(on):
            left = size[on] - 8 * k
            out[on] = mixed(out[on] ^ self.eight[begin[on] + 8 * k] & _MASK[np.minimum(left, 8)]) + np.uint64(k)
            on, k = on[left > 8], k + 1
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh64_intdigest(self.data[begin[i] : end[i]].tobytes(), seed=seed)
        return out


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: lower-cased A-Z, words split at ASCII white space; fewer words
    than the width make one shingle; no text or no word makes none."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    windows, at = rolled(hashes, width), words.of_text.tolist()
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= width:
            found = np.sort(windows[a : b - width + 1])
            yield found[np.r_[True, found[1:] != found[:-1]]]
        else:
            yield rolled(hashes[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64)
