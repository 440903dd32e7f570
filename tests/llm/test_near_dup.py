import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import near_dup as nd
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets


def sets(text):
    w = re.sub(r"[A-Z]+", lambda m: m[0].lower(), text).encode().split() if text else []
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    """doc_id to (n, component) by all pairs; ids unique."""
    s = {d: sets(t) for d, t in rows}
    parent = {d: d for d in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s[d]), root(d)) for d in ids}


def family(rnd, first, n, length=150):
    """A text and copies with up to a fifth of their words changed, so that some link, some chain and some do neither."""
    base = [f"w{rnd.randrange(10**6)}" for _ in range(length)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rnd.randrange(length)] = f"x{rnd.randrange(10**6)}"
        out.append((first + i, " ".join(words)))
    return out


def test_equals_all_pairs(spark):
    rnd = random.Random(7)
    rows = family(rnd, 0, 60) + family(rnd, 100, 40, 60) + family(rnd, 200, 30, 20) + [(300 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(20)]
    rows += [(400, "A b C"), (401, "a B c"), (402, "a b d"), (403, ""), (404, " \n"), (405, ""), (500, rows[3][1].upper()), (501, rows[3][1].replace(" ", "\n\t "))]
    rnd.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_awkward_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text, 1), (None, text, 2), (5, "another text of six words", 3), (3, text, 4), (3, text, 4), (7, None, 5), (8, "another text of six words", 6), (9, "long " * 20000 + text, 7)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect())
    assert got == [(False, 0, 36, 0, True), (True, 3, 36, 3, True), (True, 3, 36, 3, True), (True, 5, 1, 3, False), (True, 5, 36, 3, False), (True, 7, 0, 7, True), (True, 8, 1, 3, False), (True, 9, 41, 3, False)]
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_id_of_two_texts_is_linked_by_both(spark):
    """The second text of doc_id 5 has a near copy, 3; the first one has one too, 9."""
    rnd = random.Random(2)
    one, two = ([f"{x}{rnd.randrange(10**6)}" for _ in range(80)] for x in "uv")
    rows = [(5, " ".join(one)), (5, " ".join(two)), (3, " ".join([*two, "more"])), (9, " ".join([*one, "more"])), (20, "nothing like it at all here")]
    for _ in range(2):
        got = {(r.doc_id, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {(5, 3), (3, 3), (9, 3), (20, 20)}
        rows.reverse()


@pytest.mark.parametrize("own", [3, 4, 7, 8, 14])
def test_templated_pages_are_not_paired_up(spark, monkeypatch, own):
    """Pages of one template with some words of their own share buckets, but few pairs of them get as far as the test of
    links: their number grows with the pages, not with its square. With 3 or 4 words of their own, pages that depart from
    the template in the same places link and others are 2 points below the threshold; with 7 all but equal places are, and
    pages at equal places, whose links do grow with the square, are a hundredth of all pairs."""
    tested = []
    likely, delta_links = nd.likely, nd.delta_links
    monkeypatch.setattr(nd, "likely", lambda pairs, *rest: (tested.append(pairs.count()), likely(pairs, *rest))[1])
    monkeypatch.setattr(nd, "delta_links", lambda pairs, *rest: (tested.append(pairs.count()), delta_links(pairs, *rest))[1])
    totals = []
    for n in (100, 200, 400):
        rnd = random.Random(own)
        template = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
        rows = []
        for i in range(n):
            words = list(template)
            at = rnd.randrange(100)
            words[at : at + own] = [f"x{i}_{k}" for k in range(own)]
            rows.append((i, " ".join(words)))
        tested.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows)
        totals.append(sum(tested))
    most = 3.2 if own == 7 else 2.8
    assert totals[1] <= most * max(totals[0], 100) and totals[2] <= most * max(totals[1], 200) and totals[2] < 400 * 399 / 2 * 0.05, totals


def test_just_below_the_threshold(spark):
    """Pairs a shingle on either side of the threshold, in sets of many sizes."""
    rnd, rows = random.Random(11), []
    for k in range(40):
        n = rnd.randrange(20, 200)
        base = [f"b{k}_{i}" for i in range(n + 4)]
        most = next(j for j in range(n) if 100 * (n - j) < 85 * (n + j)) - 1  # shingles that may be replaced at the end
        for d, j in enumerate((0, most, most + 1)):
            rows.append((3 * k + d, " ".join([*base[: n + 4 - j], *(f"y{k}_{d}_{i}" for i in range(j))])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len({c for _, c in got.values()}) == 80


def test_sketches_merge_and_agree():
    rnd = np.random.default_rng(1)
    for j in (0.3, 0.7, 0.85, 0.95):
        errors, agree = [], []
        for _ in range(30):
            n = 400
            common = int(2 * n * j / (1 + j))
            x = rnd.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n - common :])
            ra, rb = nd.registers(a), nd.registers(b)
            assert (nd.merged(ra, rb) == nd.registers(np.union1d(a, b))).all()
            agree.append((ra == rb).mean())
            errors.append(nd.likely_jaccard(ra[None], rb[None], np.array([n * 1.0]), np.array([n * 1.0]))[0] - j)
        assert abs(np.mean(agree) - j) < 0.03 and abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.12
    assert (nd.registers(np.zeros(0, np.uint64)) == 0).all()


def test_shingle_sets_are_exact(sf, spark):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [None, "", "one", "one two three four", "a b c d e f " * 3]
    texts += ["\u0085\u00a0x\x1c \x0b\x0c" * 3, "X" * 5000 + " y", "É é A a Ａ ａ", "w" * 511 + " " + "w" * 512 + " " + "w" * 513]
    assert [len(s) for s in shingle_sets(pa.array(texts, pa.string()))] == [len(sets(t)) for t in texts]
    assert [len(s) for s in shingle_sets(pa.array(texts, pa.string())[7:19])] == [len(sets(t)) for t in texts[7:19]]
    assert list(shingle_sets(pa.array([], pa.string()))) == []
    one, two, other = shingle_sets(pa.array(["A b\tc d e f", " a B c\nd E F ", "a b c d f e"]))
    assert (one == two).all() and not set(one) & set(other)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(5, 5), (9, 8), (8, 9), (8, 9), (None, 3), (30, 20), (20, 10)]])
def test_components(spark, edges):
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {n: root(n) for n in list(parent)}
