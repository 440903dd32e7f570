"""Benchmark decontamination by pigeonhole edit matching.

A text holds an item if one of its substrings is within the item's error budget k (insertions, deletions and
substitutions). Split into k + 1 pieces, the item then has at least one piece that stands in that substring unchanged
and at most k characters off its place. One Aho-Corasick pass finds all pieces; Myers' bit-parallel distance settles
the windows around the hits. Nothing is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small, stored, table

#: Errors allowed, as a share of an item's characters.
ERROR_RATE = 0.05
#: Items matched in one pass over the documents; more take more passes.
BLOCK_ITEMS = 20_000
#: Bins of the character counts that settle most items of a piece which many share, and how many make it many.
BINS, MANY = 64, 8

FOUND = "array<struct<item_id: bigint, distance: int, end: bigint>>"


def normal(text: str | None) -> str:
    """Lower case, with one space for any white space."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their places."""
    cut = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """Myers' bit-parallel search: the least distance of the pattern to a substring, and the first end of such one."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        right = down | ~(diagonal | up)
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1, left << 1  # row 0 stays at distance 0: a match may start anywhere
        up = (left | ~(vertical | right)) & full
        down = right & vertical & full
        if score < best:
            best, end = score, j
    return best, end


def counted(text: str) -> np.ndarray:
    """How often characters occur, in BINS bins."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), "<u4") % BINS, minlength=BINS).astype(np.int32)


class Matcher:
    """All items of a block (item_id, text) at once. An item with a budget of no error must stand there as whole words."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        ids: dict[str, list[int]] = {}
        for item_id, text in items:
            if item_id is not None and (text := normal(text)):
                ids.setdefault(text, []).append(item_id)
        self.items, self.automaton = [], ahocorasick.Automaton()
        places: dict[str, list] = {}
        for text, own in ids.items():
            budget = int(len(text) * rate)
            pattern = text if budget else f" {text} "
            for at, piece in pieces(pattern, budget):
                places.setdefault(piece, []).append((len(self.items), at))
            self.items.append((own, pattern, budget))
        for piece, where in places.items():
            counts = np.stack([counted(self.items[i][1]) for i, _ in where]) if len(where) > MANY else None
            self.automaton.add_word(piece, (len(piece), where, counts))
        if places:
            self.automaton.make_automaton()

    def likely(self, text: str, end: int, size: int, where: list, counts: np.ndarray) -> list:
        """Of the items that share a piece, those that do not lack more characters around it than they may."""
        before = max(at + self.items[i][2] for i, at in where)
        after = max(len(self.items[i][1]) - at - size + self.items[i][2] for i, at in where)
        lacking = np.maximum(counts - counted(text[max(0, end - size - before) : end + after]), 0).sum(axis=1)
        return [w for w, n in zip(where, lacking.tolist(), strict=True) if n <= self.items[w[0]][2]]

    def __call__(self, text: str | None) -> list[dict]:
        """The items that a text holds: item_id, least distance, first end of such a match in the normal text."""
        text = normal(text)
        if not self.items or not text:
            return []
        text = f" {text} "
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where, counts) in self.automaton.iter(text):
            for item, at in where if counts is None else self.likely(text, end + 1, size, where, counts):
                _, pattern, budget = self.items[item]
                start = end + 1 - size - at
                a, b = max(0, start - budget), min(len(text), start + len(pattern) + budget)
                mine = windows.setdefault(item, [])
                if mine and a <= mine[-1][1]:
                    mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                else:
                    mine.append([a, b])
        out = []
        for item in sorted(windows):
            own, pattern, budget = self.items[item]
            best = min(((d, a + e) for a, b in windows[item] for d, e in (nearest(pattern, text[a:b]),) if d <= budget), default=None)
            if best:
                out += [{"item_id": i, "distance": best[0], "end": best[1] - (1 if budget else 2)} for i in own]
        return sorted(out, key=lambda x: x["item_id"])


def _block(items: list[tuple[int, str]], rate: float):
    """The digests of the texts that hold items of a block, and those items."""
    built: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Matcher(items, rate))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))
        for batch in sliced(batches):
            found = [(t, x) for t in batch.column(0).to_pylist() if (x := built[0](t))]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(t.encode()).hexdigest() for t, _ in found], pa.string()), pa.array([x for _, x in found], kind)], ["digest", "items"])

    return run


def held_items(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """digest (md5), items: a row per different text that holds an item of benchmark. The stated items go through the
    driver in blocks, each a pass of its own over the texts, so that a task holds one block at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    items = stored(items)
    blocks = max(1, -(-items.count() // block_items))
    texts, found = documents.select("text").where("text is not null"), None
    for k in range(blocks):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        own = texts.mapInArrow(_block(rows, rate), f"digest string, items {FOUND}")
        found = own if found is None else found.union(own)
    once = found.groupBy("digest", "items").agg(F.lit(1).alias("_"))  # repeated texts, before the blocks meet
    return stored(once.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items")))


def contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """documents with a column _benchmark_items (one of that name is replaced): for each benchmark item (item_id, text)
    that the text holds within floor(rate * length) errors, its id, the least distance and the first end of such a match,
    in normal text.

    Items without an id or without a word are ignored; those too short for an error must stand there as whole words; a
    null or empty text holds nothing; items that are equal are all named, rows that are equal once. An empty table, or
    an empty benchmark, gives no items.
    """
    found = small(held_items(documents, benchmark, rate, block_items)).alias("f")
    rows = documents.drop("_benchmark_items")
    both = rows.alias("d").join(found, F.md5(F.col("d.text").cast("binary")) == F.col("f.digest"), "left")
    return both.select("d.*", F.coalesce("f.items", F.expr(f"cast(array() as {FOUND})")).alias("_benchmark_items"))


def clean(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found = small(held_items(documents, benchmark, rate)).alias("f")
    return documents.alias("d").join(found, F.md5(F.col("d.text").cast("binary")) == F.col("f.digest"), "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    rows = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.array_min(F.transform("_benchmark_items", lambda x: F.struct(x["distance"].alias("distance"), x["item_id"].alias("item_id"))))
    return rows.select(
        "doc_id", F.size("_benchmark_items").cast("long").alias("n_items"), best["item_id"].alias("item_id"), best["distance"].alias("distance"),
        F.array_join(F.transform("_benchmark_items", lambda x: x["item_id"]).cast("array<string>"), ",").alias("item_ids"), (F.size("_benchmark_items") == 0).alias("kept"),
    )
