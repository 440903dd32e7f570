import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repair as rp
from tidemark.llm import runs as rn


def plain_runs(words):
    """(start, end, period), every period tried at every word."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def plain(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-((r[1] - r[0]) / r[2]), r[0], r[2])) if runs else None
    said = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    figures = (best[0], best[1] - best[0], best[2], (best[1] - best[0]) * 1000 // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(), n, len(gone))


def texts_of(rng):
    """Words with planted repetitions, in repetitions, of few and of many kinds."""
    for _ in range(rng.randint(1, 6)):
        n, kinds = rng.choice([0, 1, 5, 30, 100, 300]), rng.choice([1, 2, 3, 10, 100])
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 10 else 0):
            a, p = rng.randrange(n), rng.randint(1, n // 4)
            for i in range(a + p, rng.randint(a, n)):
                words[i] = words[i - p]
        yield words


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 1 << 30))
def test_runs_equal_brute_force(seed):
    texts = list(texts_of(random.Random(seed)))
    edges = np.cumsum([0, *map(len, texts)])
    got = rn.find_runs(np.array([w for t in texts for w in t], np.int64), edges)
    assert got.tolist() == [[i, s + edges[i], e + edges[i], q] for i, t in enumerate(texts) for s, e, q in sorted(plain_runs(t), key=lambda r: (r[0], r[1]))]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.booleans())
def test_grammar_derives_its_texts(seed, shared):
    texts = list(texts_of(random.Random(seed)))
    symbols, owner = np.array([w for t in texts for w in t], np.int64), np.repeat(np.arange(len(texts)), list(map(len, texts)))
    g = rp.repair(symbols, owner, 100, shared)

    def derived(x):
        return [x] if x < 100 else derived(g.left[x - 100]) + derived(g.right[x - 100])

    for i, t in enumerate(texts):
        assert [w for s in g.symbols[g.owner == i].tolist() for w in derived(s)] == t
    for k, at in zip(g.rule.tolist(), g.at.tolist(), strict=True):
        start, _, end = g.first[k]
        assert symbols[at : at + end - start].tolist() == derived(100 + k)
    if not shared:
        pairs = {}
        for a, b, x, y in zip(g.symbols, g.symbols[1:], g.owner, g.owner[1:], strict=False):
            if x == y:
                pairs[x, a, b] = pairs.get((x, a, b), 0) + 1
        assert all(n == 1 or a == b for (_, a, b), n in pairs.items())
    nodes = rp.balanced(g)
    assert len(nodes) == len(g.symbols) - len(set(g.owner.tolist())) and sorted(nodes[:, 1].tolist()) == sorted(g.start[1:][g.owner[1:] == g.owner[:-1]].tolist())


def test_mistaken_sums_are_drawn_again(monkeypatch):
    """Sums that call all stretches alike lead to no wrong run."""
    seeds = []
    right = rn.Sums.alike

    def wrong(self, x, y, n):
        return np.ones(len(x), bool) if len(seeds) == 1 else right(self, x, y, n)

    made = rn.Sums.__init__
    monkeypatch.setattr(rn.Sums, "__init__", lambda self, words, seed: (seeds.append(seed), made(self, words, seed))[1])
    monkeypatch.setattr(rn.Sums, "alike", wrong)
    words = [1, 2, 3, 4, 5] * 7 + [9, 8, 7] + [1, 2, 3, 4, 5] * 3 + [6]
    assert rn.find_runs(np.array(words), np.array([0, len(words)])).tolist() == [[0, 0, 35, 5]] and seeds == [0, 1]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(rn.SQL["op11_repeated_runs"])
    got = rn.op11_repeated_runs(spark, sf)
    assert got.columns == rel.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(rel.fetchall()) and any(r[1] for r in rows)
    few = [(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 400]
    assert len(few) > 50 and {plain(*x) for x in few} <= set(rows)


def test_awkward_rows(spark):
    line = "one two three four five six seven eight nine "
    rows = [
        (1, None, 0), (2, "", 0), (3, " \n\t ", 0), (None, line * 3, 0), (None, None, 0), (4, line * 3, 1), (4, line * 3, 1), (4, "a " * 23, 1), (5, "a " * 24, 1), (6, "a b " * 40 + "c " + "b a " * 12, 1),
        (7, "nbsp\xa0stays one\x0bword\x1c " * 9, 1), (-15, "négatif ou non " * 5, 1), (8, "word", 1), (9, "x" * 100000 + " y " + "z z " * 20, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period int")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, rn.repeated_runs(docs, rn.planted).collect()), key=key) == sorted((plain(d, t) for d, t, _ in rows), key=key)
    bare = {(r.doc_id, r.n_runs) for r in rn.repeated_runs(docs).collect()}
    assert (5, 1) in bare and (4, 0) in bare and (4, 1) in bare
    empty = rn.repeated_runs(docs.limit(0))
    assert empty.columns == [c.split()[0] for c in rn.SCHEMA.split(", ")] and empty.count() == 0


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: [i % 7 for i in range(n)], lambda n: [(i * i) % 97 for i in range(n)], lambda n: [bin(i).count("1") % 2 for i in range(n)]])
def test_long_texts_take_time_in_proportion(make):
    took = []
    for n in (20_000, 160_000):
        words = np.array(make(n), np.int64)
        at = time.process_time()
        rn.find_runs(words, np.array([0, n]))
        took.append(time.process_time() - at)
    assert took[1] < 30 * max(took[0], 0.05)
