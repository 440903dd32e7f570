"""Runs of repeated words in texts, found in a grammar: what crosses a rule's middle is searched for once, however often
the rule is used, and then stands wherever the rule does.

A run is a stretch of words with smallest period q that no neighbouring word extends, of LENGTH words and PERIODS
periods at least. Of all nodes of the derivation tree that hold a run, the lowest has it across its middle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import sliced_by_bytes, table
from .repair import balanced, repair
from .shingles import Words, mixed, rolled

LENGTH, PERIODS = 24, 3
#: A run has a word in the middle of its node; its longer half has so many words a period away.
ANCHOR = 4
#: Pairs of places that are compared together.
COMPARED = 1 << 18
PRIMES = (2147483647, 2147483629)


class Sums:
    """Polynomial sums of a word sequence modulo two primes, which tell how far two places read alike."""

    def __init__(self, words: np.ndarray, seed: int):
        n, self.parts = len(words), []
        for k, p in enumerate(map(np.uint64, PRIMES)):
            salt = mixed(np.array([seed * 2 + k + 1], np.uint64))[0]
            value = mixed(words.astype(np.uint64) ^ salt) % p
            base = salt % (p - np.uint64(1000)) + np.uint64(500)
            power = np.ones(n + 1, np.uint64)
            size = 1
            while size <= n:  # powers up to twice as many at a time
                more = min(size, n + 1 - size)
                power[size : size + more] = power[:more] * (power[size - 1] * base % p) % p
                size += more
            self.parts.append((p, power, np.r_[np.uint64(0), np.cumsum(value * power[:n] % p) % p]))

    def alike(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from x and those from y (further on) are the same."""
        same = np.ones(len(x), bool)
        for p, power, total in self.parts:
            same &= (total[x + n] + p - total[x]) % p * power[y - x] % p == (total[y + n] + p - total[y]) % p
        return same

    def ahead(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that are the same from x and y (further on) on, `most` at most."""
        got = np.zeros(len(x), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            step = np.where(got + (1 << bit) <= most, 1 << bit, 0)
            got += np.where(self.alike(x + got, y + got, step), step, 0)
        return got

    def back(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that are the same before x and y."""
        got = np.zeros(len(x), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            step = np.where(got + (1 << bit) <= most, 1 << bit, 0)
            got += np.where(self.alike(x - got - step, y - got - step, step), step, 0)
        return got


def _candidates(words: np.ndarray, owner: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """node, place, period: where a run across a node's middle may be told from its first words after the middle, which
    stand again a period later, or from its last ones before it, which stand a period earlier."""
    n = len(words)
    grams = rolled(mixed(words.astype(np.uint64)) ^ mixed(owner.astype(np.uint64) + np.uint64(1 << 40)), ANCHOR)
    order = np.argsort(grams, kind="stable")
    rank = np.empty(n, np.int64)
    rank[: len(order)][order] = np.arange(len(order))
    kind = np.cumsum(np.r_[False, grams[order][1:] != grams[order][:-1]]) if len(order) else order
    key = kind * (n + 1) + order  # ascending: places of each gram
    start, middle, end = nodes.T
    furthest = (end - start) // PERIODS
    for later in (True, False):
        own = middle if later else middle - ANCHOR
        which = np.flatnonzero((own + ANCHOR <= end) & (own >= start))
        r, at = rank[own[which]], own[which]
        low = r + 1 if later else np.searchsorted(key, kind[r] * (n + 1) + np.maximum(start[which], at - furthest[which]))
        high = np.searchsorted(key, kind[r] * (n + 1) + np.minimum(end[which] - ANCHOR, at + furthest[which]), "right") if later else r
        some = np.flatnonzero(high > low)
        which, at, low, size = which[some], at[some], low[some], (high - low)[some]
        total = np.cumsum(size)
        a = 0
        while a < len(which):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + COMPARED, "right")))
            each = np.repeat(np.arange(a, b), size[a:b])
            place = order[low[each] + np.arange(len(each)) - np.repeat(total[a:b] - size[a:b] - (total[a - 1] if a else 0), size[a:b])]
            period = np.abs(place - at[each])
            yield which[each], middle[which[each]] - (0 if later else period), period
            a = b


def _found(words: np.ndarray, owner: np.ndarray, edges: np.ndarray, seed: int) -> np.ndarray:
    """owner, start, end, period of all runs, by those; start and end are places in all texts' words."""
    grammar = repair(words, owner, int(words.max(initial=0)) + 1, shared=False)
    tree = balanced(grammar)
    nodes = np.concatenate([grammar.first, tree])
    long = np.flatnonzero(nodes[:, 2] - nodes[:, 0] >= LENGTH)
    sums, parts = None, []
    for node, x, period in _candidates(words, owner, nodes[long]):
        sums = sums or Sums(words, seed)
        start, _, end = nodes[long[node]].T
        ahead, back = sums.ahead(x, x + period, end - x - period), sums.back(x, x + period, x - start)
        run = np.stack([long[node], x - back, x + period + ahead, period], axis=1)
        parts.append(run[(run[:, 2] - run[:, 1] >= np.maximum(LENGTH, PERIODS * period)) & (back + ahead > 0)])
    run = _smallest(np.concatenate([np.zeros((0, 4), np.int64), *parts]))
    if not len(run):
        return run
    # a rule's runs stand at all its places; a node that joins what is left has but one
    places, rules = [], len(grammar.left)
    of_rule = run[run[:, 0] < rules]
    order = np.argsort(grammar.rule, kind="stable")
    low, high = np.searchsorted(grammar.rule[order], of_rule[:, 0]), np.searchsorted(grammar.rule[order], of_rule[:, 0], "right")
    each = np.repeat(np.arange(len(of_rule)), high - low)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    shift = grammar.at[order][low[each] + nth] - grammar.first[of_rule[each, 0], 0]
    places.append(of_rule[each, 1:] + np.stack([shift, shift, np.zeros_like(shift)], axis=1))
    places.append(run[run[:, 0] >= rules, 1:])
    run = np.concatenate(places)
    run = np.column_stack([owner[run[:, 0]], run])
    return _smallest(_merged(run))


def _smallest(run: np.ndarray) -> np.ndarray:
    """Of stretches (holder, start, end, period) that differ in the period alone, the one with the smallest."""
    run = run[np.lexsort(run.T[::-1])]
    return run[np.r_[True, np.any(run[1:, :3] != run[:-1, :3], axis=1)]] if len(run) else run


def _merged(run: np.ndarray) -> np.ndarray:
    """Stretches of one holder and period that overlap by a period or more are one."""
    run = run[np.lexsort((-run[:, 2], run[:, 1], run[:, 3], run[:, 0]))]
    group = np.cumsum(np.r_[False, np.any(run[1:, [0, 3]] != run[:-1, [0, 3]], axis=1)])
    far = int(run[:, 2].max()) + 1
    reach = np.maximum.accumulate(run[:, 2] + group * far) - group * far
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (run[1:, 1] + run[1:, 3] > reach[:-1])])
    return np.column_stack([run[new, 0], run[new, 1], np.maximum.reduceat(run[:, 2], new), run[new, 3]])


def _right(words: np.ndarray, edges: np.ndarray, run: np.ndarray) -> bool:
    """Whether stretches have their periods, and no word beside them goes on."""
    for owner, start, end, q in run.tolist():
        if (words[start : end - q] != words[start + q : end]).any():
            return False
        if start > edges[owner] and words[start - 1] == words[start - 1 + q] or end < edges[owner + 1] and words[end] == words[end - q]:
            return False
    return True


def find_runs(words: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """owner, start, end (exclusive), period of the runs in texts that stand one after another: words as small numbers,
    edges where texts begin and the last ends; start and end are places in all words."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    for seed in count():  # sums that mistake two stretches for each other are drawn again
        run = _found(words, owner, edges, seed)
        if _right(words, edges, run):
            return run


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as numbers, equal for equal words, and where texts begin and the last ends."""
    split = Words(texts, lower=False)
    size = split.end - split.begin
    ends = np.cumsum(size)
    data = split.data[np.repeat(split.begin - (ends - size), size) + np.arange(int(size.sum()))] if len(size) else np.zeros(0, np.uint8)
    offsets = np.r_[0, ends].astype(np.int64)
    each = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return each.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), split.of_text


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original place of each of n words where a text is made to repeat itself; None for most texts, and for all
    without a doc_id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


def greatest(run: list[tuple[int, int, int]]) -> tuple | None:
    """Of (start, length, period), that of the greatest length / period; of equals the first by start, then period."""
    best = None
    for x in sorted(run, key=lambda r: (r[0], r[2])):
        if best is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    return best


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def _judged(change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, 1):
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            words, edges = coded(texts)
            ids, source = batch.column(0).to_pylist(), {}
            for i, doc_id in enumerate(ids):
                moved = change(doc_id, int(edges[i + 1] - edges[i]))
                if moved is not None:
                    source[i] = moved
                    words[edges[i] : edges[i + 1]] = words[edges[i] + moved]
            found = find_runs(words, edges)
            at = np.searchsorted(found[:, 0], np.arange(len(ids) + 1))
            rows = []
            for i, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                own = found[at[i] : at[i + 1]]
                begin, n = int(edges[i]), int(edges[i + 1] - edges[i])
                runs = [(s - begin, e - s, q) for _, s, e, q in own.tolist()]
                said = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
                split, dropped = text.as_py().encode().split(), 0
                if runs or i in source:
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, own[:, 1] - begin + own[:, 3], 1)
                    np.add.at(cover, own[:, 2] - begin, -1)
                    kept = np.flatnonzero(np.cumsum(cover[:n]) == 0)
                    dropped = n - len(kept)
                    split = [split[k] for k in (source[i][kept] if i in source else kept).tolist()]
                best = greatest(runs) or (None, None, None)
                milli = best[1] * 1000 // best[2] if runs else None
                rows.append((doc_id, len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(split)).hexdigest(), n, dropped))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def repeated_runs(documents: DataFrame, change=lambda doc_id, n: None) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the run of the greatest exponent (null without runs);
    runs_sha256 of all runs; collapsed_sha256 of the words that are left when each run keeps its first period, n_words,
    n_dropped: a row per row of documents (doc_id long, text; other columns are ignored).

    change(doc_id, n) may give the word that stands at each of a text's n places, to plant runs. Null, empty and blank
    texts have no words and no runs; rows that share a doc_id, or have none, are judged each by its own text; an empty
    table gives no rows. A text is one task's, whatever its length.
    """
    return documents.select("doc_id", "text").mapInArrow(_judged(change), SCHEMA)


def op11_repeated_runs(spark, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents"), planted)


SQL = {
    "op11_repeated_runs": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents),
g AS (SELECT r, doc_id, w, len(w) AS n, coalesce(h % 10 = 0, false) AND len(w) > 0 AS moved, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN moved THEN g % n END AS a FROM g),
p AS (SELECT *, CASE WHEN moved THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
word AS (
  SELECT r, n, i, w[CASE WHEN moved AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
gram AS (SELECT r, n, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS g4 FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
met AS (SELECT x.r, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.r = y.r AND x.g4 = y.g4 AND x.i < y.i AND 3 * (y.i - x.i) <= x.n WHERE y.i + 4 <= x.n),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM met),
stretch AS (SELECT r, min(i) AS s, count(*) + 3 + q AS l, q FROM isle GROUP BY r, q, k),
run AS (SELECT r, s, l, min(q) AS q FROM stretch WHERE l >= greatest(24, 3 * q) GROUP BY r, s, l),
said AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM run GROUP BY r),
best AS (SELECT r, s, l, q FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY l / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word w ANTI JOIN gone USING (r, i) GROUP BY w.r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(best.l * 1000 // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN said USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
}
