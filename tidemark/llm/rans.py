"""A static range asymmetric numeral system over token ids in numpy: shared frequency tables, independent blocks of
interleaved lanes, checkpoints that cut blocks into spans to start decoding from, and a checksum per span.

Each lane is a state kept in [2**21, 2**53), renormalised by 32-bit words; below 2**53 a division in floating point
rounds down to the exact quotient, which is several times as fast as one of integers. Step t of a block codes the symbols
t * lanes .. (t + 1) * lanes - 1, one a lane; the words of one step lie together, so that a decoder reads the stream
forwards, all lanes at a time.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 18
LOW = 1 << 21
HIGH_BITS = 53


def table(counts: np.ndarray) -> np.ndarray:
    """Frequencies for counts of symbols: they add up to 2**BITS, and every symbol that occurs has at least 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > 1 << BITS:
        raise ValueError("more symbols than the table has room for")
    out = np.maximum((counts.astype(np.float64) * (1 << BITS) / total).astype(np.int64), counts > 0)
    over = int(out.sum()) - (1 << BITS)
    order = np.argsort(-out, kind="stable")
    if over < 0:
        out[order[0]] -= over
    for i in order:  # the most frequent symbols give back what rounding up took
        if over <= 0:
            break
        back = min(over, int(out[i]) - max(1, int(out[i]) // 2))
        out[i] -= back
        over -= back
    while over > 0:
        order = np.argsort(-out, kind="stable")[:over]
        order = order[out[order] > 1]
        out[order] -= 1
        over -= len(order)
    return out.astype(np.uint32)


class Codec:
    """Encodes and decodes blocks under one table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.int64)
        self.start = np.cumsum(self.freq) - self.freq

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each slot of the table its symbol, the symbol's frequency and the slot's place among the symbol's."""
        symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        return symbol, self.freq[symbol].astype(np.int32), (np.arange(len(symbol)) - self.start[symbol]).astype(np.int32)

    def encode(self, symbols: np.ndarray, lanes: int, every: int) -> dict:
        """marks: step, place in words and states at the start of every span of so many steps, the first included; crcs:
        of each span's symbols as little-endian unsigned 32-bit integers."""
        n = len(symbols)
        steps = -(-n // lanes)
        freq, start = self.freq.take(symbols), self.start.take(symbols)
        state = np.full(lanes, LOW, np.int64)
        words, marks, place = [], [], 0
        for t in range(steps - 1, -1, -1):
            f, c = freq[t * lanes : (t + 1) * lanes], start[t * lanes : (t + 1) * lanes]
            x = state[: len(f)]
            full = np.flatnonzero(x >= f << (HIGH_BITS - BITS))
            if len(full):
                out = x.take(full)
                words.append(out.astype(np.uint32))  # the low 32 bits
                place += len(out)
                x[full] = out >> 32
            q = (x / f).astype(np.int64)
            x += (q << BITS) - q * f + c
            if t % every == 0:
                marks.append((t, place, state.copy()))
        flat = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        plain = symbols.astype("<u4")
        return {
            "n": n, "lanes": lanes, "every": every, "words": flat, "marks": [(t, len(flat) - p, s) for t, p, s in reversed(marks)],
            "crcs": [zlib.crc32(plain[i : i + every * lanes]) for i in range(0, n, every * lanes)],
        }

    def decode(self, block: dict, spans: range | None = None) -> np.ndarray:
        """The symbols of a block, or of some of its spans, each held against its checksum; what stands before the first
        of them is not decoded."""
        n, lanes, every, words = block["n"], block["lanes"], block["every"], block["words"].astype(np.int64)
        if not hasattr(self, "_slots"):
            self._slots = self.slots()
        symbol, freq, among = self._slots
        spans = range(len(block["marks"])) if spans is None else spans
        first, end = spans.start * every * lanes, min(n, spans.stop * every * lanes)
        out = np.empty(max(0, end - first), np.uint32)
        done = 0
        for i in spans:
            t, place, state = block["marks"][i]
            state, begun = state.copy(), done
            for t in range(t, min(t + every, -(-n // lanes))):
                k = min(lanes, n - t * lanes)
                x = state[:k]
                slot = x & ((1 << BITS) - 1)
                symbol.take(slot, out=out[done : done + k], mode="clip")
                x >>= BITS
                x *= freq.take(slot)
                x += among.take(slot)
                low = np.flatnonzero(x < LOW)
                if len(low):
                    x[low] = (x.take(low) << 32) | words[place : place + len(low)]
                    place += len(low)
                done += k
            if zlib.crc32(out[begun:done]) != block["crcs"][i]:
                raise ValueError(f"span {i}: its checksum does not match")
        return out
