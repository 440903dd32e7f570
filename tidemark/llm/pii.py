"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers that no pattern knows.

Seed entities (what the fixed patterns find, and long keys) stand in contexts: the two words before with what is
attached to the value in front, and what is attached behind with the word after. Contexts and values form a graph that
Spark scores in rounds: a context is as good as the share of its different values that are believed, and what stands in
a trusted context is believed in the next round. Seeds are believed from the start, but only the fixed patterns and
trusted contexts make a span; a key in no such context is none.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, join_skewed, sliced_by_bytes, stored, table
from .shingles import Words, mixed

KINDS = ("email", "ip", "card", "phone", "found")
FOUND = 4

ROUNDS = 3
#: Distinct believed values that a context must have, and their least share among all its values (and a quarter).
MIN_SUPPORT = 3
MIN_TRUST = 0.8
#: A context is not counted exactly if an estimate gives it so many times the values that it could be trusted with: ten
#: standard errors.
SURELY = 1.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_EDGES = np.isin(np.arange(256), np.frombuffer(b"\"'`()[]{}<>,.;:!?#*$%&|=~", np.uint8))
#: Keys: long, of letters and digits with at least eight of these, so that paths and long words are none.
_KEY = re.compile(rb"(?=(?:[^0-9]*[0-9]){8})(?=.*[a-z])[a-z0-9+/_-]{32,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap, looking only around each @, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four kinds, sorted; ends are exclusive. Matches that fail their test are dropped."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Sights:
    """All values of a batch of texts in their contexts, as arrays: the base spans, and every other token (freed of
    punctuation at its ends) that touches none of them. A value has a row for its context before and one for that
    after, if there is a word on that side. A-Z is lower-cased; values and contexts are 64-bit hashes."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts, lower=True)
        self.base = [base_spans(t) for t in texts.to_pylist()]
        tokens, data = w.hashes(), w.data
        begin, end = w.begin.copy(), w.end.copy()
        edged = np.flatnonzero(_EDGES[data[begin]] | _EDGES[data[end - 1]])
        bare = np.flatnonzero(~_EDGES[data]) if len(edged) else edged
        begin[edged] = np.minimum(np.r_[bare, len(data)][np.searchsorted(bare, w.begin[edged])], w.end[edged])
        end[edged] = np.maximum(np.r_[-1, bare][np.searchsorted(bare, w.end[edged])] + 1, begin[edged])

        spans = [(i, a, b) for i, found in enumerate(self.base) for a, _, b in found]
        of = np.array([i for i, _, _ in spans], np.int64)
        a, b = (self._bytes(of, np.array([x[k] for x in spans], np.int64)) for k in (1, 2))
        first, last = np.searchsorted(w.begin, a, "right") - 1, np.searchsorted(w.begin, b - 1, "right") - 1
        touched = np.zeros(len(w.begin) + 1, np.int64)
        np.add.at(touched, first, 1)
        np.add.at(touched, last + 1, -1)
        free = np.flatnonzero((np.cumsum(touched)[:-1] == 0) & (begin < end))

        self.begin, self.end = np.r_[a, begin[free]], np.r_[b, end[free]]
        first, last = np.r_[first, free], np.r_[last, free]
        self.text = np.repeat(np.arange(len(texts)), np.diff(w.of_text))[first]
        self.n_base = len(spans)
        start, stop = w.of_text[self.text], w.of_text[self.text + 1]
        self.has_before, self.has_after = first > start, last + 1 < stop
        none = np.uint64(0)
        behind = mixed(np.r_[tokens, none])
        near = np.where(self.has_before, tokens[first - 1], none)
        far = np.where(first - 1 > start, behind[first - 2], none)
        self.before = mixed(mixed(far + near) + self._attached(w.begin[first], self.begin)) | np.uint64(1)
        self.after = mixed(np.where(self.has_after, behind[last + 1], none) + self._attached(self.end, w.end[last])) & ~np.uint64(1)

    def _bytes(self, text: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Places among the bytes of places among the characters of texts."""
        if not len(text):
            return char
        return np.searchsorted(self.chars, self.chars[self.words.edges[text]] + char, "right") - 1

    @functools.cached_property
    def chars(self) -> np.ndarray:
        """Characters before each byte."""
        return np.r_[0, np.cumsum((self.words.data & 0xC0) != 0x80)]

    def _attached(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of what stands between, mostly nothing."""
        out = np.zeros(len(begin), np.uint64)
        some = np.flatnonzero(end > begin)
        out[some] = self.words.hashes(begin[some], end[some])
        return out

    def values(self, which: np.ndarray) -> np.ndarray:
        return self.words.hashes(self.begin[which], self.end[which]).view(np.int64)

    def seeds(self) -> np.ndarray:
        """Numbers of the values that are seeds: base spans and keys."""
        long = np.flatnonzero(self.end - self.begin >= 32)
        data = self.words.data
        keys = [i for i in long.tolist() if i >= self.n_base and _KEY.fullmatch(data[self.begin[i] : self.end[i]].tobytes())]
        return np.r_[np.arange(self.n_base), np.array(keys, np.int64)]

    def rows(self, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of values (of some, or of all), and the context of each."""
        if which is None:
            a, b = np.flatnonzero(self.has_before), np.flatnonzero(self.has_after)
        else:
            a, b = which[self.has_before[which]], which[self.has_after[which]]
        return np.r_[a, b], np.r_[self.before[a], self.after[b]].view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    sight = pa.list_(pa.struct([("value", pa.int64()), ("context", pa.int64())]))
    for batch in sliced_by_bytes(batches, 1):
        s = Sights(batch.column(1))
        which, context = s.rows(s.seeds())
        seeds: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i, v, c in zip(s.text[which].tolist(), s.values(which).tolist(), context.tolist(), strict=True):
            seeds[i].append({"value": v, "context": c})
        spans = [[{"start": a, "kind": k, "end": b} for a, k, b in found] for found in s.base]
        digests = [_digest(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0), pa.array(spans, span), pa.array(seeds, sight)], ["row", "doc_id", "base", "seeds"])


def _digest(text: str | None) -> bytes:
    return xxhash.xxh128_digest((text or "").encode())


def scan(documents: DataFrame) -> DataFrame:
    """row (a digest of the text), doc_id, base spans and the seeds' values and contexts, of every row of documents."""
    schema = "row binary, doc_id long, base array<struct<start: bigint, kind: int, end: bigint>>, seeds array<struct<value: bigint, context: bigint>>"
    return stored(documents.select("doc_id", "text").mapInArrow(_scan, schema))


def _look_up(column: str, keys: np.ndarray | None, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, 0):
            s = Sights(batch.column(0))
            which, context = s.rows()
            if keys is not None:
                asked = context if column == "context" else s.values(which)
                found = np.flatnonzero(np.r_[keys, np.iinfo(np.int64).max][np.searchsorted(keys, asked)] == asked) if len(keys) else np.zeros(0, np.int64)
                which, context = which[found], context[found]
            out, names = [pa.array(context), pa.array(s.values(which))], ["context", "value"]
            if places:
                texts = s.text[which]
                digests = {i: _digest(batch.column(0)[i].as_py()) for i in np.unique(texts).tolist()}
                char = lambda x: pa.array(s.chars[x[which]] - s.chars[s.words.edges[texts]], pa.int64())
                out += [pa.array([digests[i] for i in texts.tolist()], pa.binary()), char(s.begin), char(s.end), pa.array(which < s.n_base)]
                names += ["row", "start", "end", "base"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def look_up(documents: DataFrame, keys: DataFrame, places: bool = False) -> DataFrame:
    """context, value (and row, start, end, base: where, and whether a fixed pattern finds it) of all values of documents
    whose context, or value, is among the keys (a stored table of one column). Keys go to the tasks if they are few;
    otherwise all values are joined to them."""
    column = keys.columns[0]
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = np.sort(np.array([r[0] for r in keys.collect()], np.int64)) if few else None
    schema = "context long, value long" + ", row binary, start long, end long, base boolean" * places
    rows = documents.select("text").where("text is not null").mapInArrow(_look_up(column, known, places), schema)
    return rows if few else rows.join(keys, column, "left_semi")


def revealed(documents: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row, start, end: what stands in contexts that are trusted after so many rounds and is no base span, from the
    seeds' sightings (context, value; a stored table).

    In each round the contexts of MIN_SUPPORT different believed values are candidates; their different values are
    counted over all documents, by estimate first and exactly where that leaves a doubt; those with a share of believed
    values of MIN_TRUST are trusted, and what stands in them is believed. It ends early if nothing new is.
    """
    seen, out = seeds, None  # believed values in all their contexts
    believed = stored(seen.select("value").distinct())
    for k in range(rounds):
        support = stored(seen.groupBy("context").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= MIN_SUPPORT))
        about = look_up(documents, support.select("context")).groupBy("context").agg(F.approx_count_distinct("value").alias("n"))
        open_ = stored(support.join(about, "context").where(F.col("n") <= F.col("support") / MIN_TRUST * SURELY + 1).select("context", "support"))
        held = stored(look_up(documents, open_.select("context"), places=True).distinct())
        counted = held.groupBy("context").agg(F.count_distinct("value").alias("n")).join(open_, "context")
        trusted = counted.where(F.col("support") >= MIN_TRUST * (F.col("n") + 0.25)).select("context")
        inside = stored(held.join(trusted, "context", "left_semi"))
        new = stored(inside.select("value").distinct().join(believed, "value", "left_anti"))
        for df in (support, open_, held, *([out] if out else [])):
            forget(df)
        out = inside
        if k + 1 == rounds or new.limit(1).count() == 0:
            break
        seen = stored(seen.union(look_up(documents, new)).distinct())
        believed = stored(believed.union(new))
    return out.where("not base").select("row", "start", "end").distinct()


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, as positions in KINDS): a row per row of documents (doc_id,
    text; others are ignored).

    spans has all base spans and, as kind `found`, the values that stand in trusted contexts; those never touch a base
    span. Values are single tokens: one written in groups is found by the group next to the context. Null and empty
    texts have none. Rows may share a doc_id or have none; equal texts have equal spans. An empty table gives no rows.
    """
    documents = documents.select("doc_id", "text")
    scanned = scan(documents)
    seeds = stored(scanned.select(F.explode("seeds").alias("s")).select("s.context", "s.value").distinct())
    more = revealed(documents, seeds)
    more = stored(more.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(FOUND).alias("kind"), "end")).alias("more")))
    both = join_skewed(scanned.select("row", "doc_id", "base"), more, "row", "left")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")))).alias("spans"))


def listed(spans) -> F.Column:
    """kind:start:end of spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(4)]
    n_spans = F.size("spans").cast("long")
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (n_spans - F.size("base")).alias("n_found"), n_spans.alias("n_spans")
    )
