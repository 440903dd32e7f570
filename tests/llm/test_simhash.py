import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash as sh


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows of (doc_id, fingerprint) to the smallest doc_id that links lead to, by all pairs."""
    leader = {d: d for d, _ in rows}

    def top(d):
        while leader[d] != d:
            d = leader[d]
        return d

    ids, f = [d for d, _ in rows], np.array([x for _, x in rows], np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            a, b = top(ids[i]), top(ids[int(j)])
            leader[max(a, b)] = min(a, b)
    return {d: top(d) for d in ids}


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sh.op13_simhash(spark, sf).collect()
    want = {d: plain_fingerprint(t) for d, t in docs}
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in want.items()} and len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == plain_components(list(want.items()))


def test_awkward_rows(spark):
    long = " ".join(f"w{i * i % 7919}" for i in range(60000))
    rows = [
        (5, None, "x"), (6, "", "x"), (7, " \n\t", "y"), (None, "no id at all here", None), (None, None, None), (3, "only three words", "x"), (2, "Only THREE  words", "x"),
        (9, "É stays É, nbsp\xa0stays one", "x"), (10, "É stays É, nbsp\xa0stays one", "x"), (11, long, "x"), (12, long + " end", "x"), (1, "a node of two texts that are far apart", "x"), (1, "only three words", "x"), (8, "a node of two texts that are far apart", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumnRenamed("component_id", "fingerprint")
    got = sh.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((d is None, d or 0, f"{plain_fingerprint(t):016x}") for d, t, _ in rows)
    of = {r.doc_id: r.component_id for r in got}
    assert of[None] is None and of[5] == of[6] == of[7] == 5 and of[1] == of[2] == of[3] == of[8] == 1 and of[9] == of[10] == 9 and of[11] == of[12]
    empty = sh.near_duplicates(docs.limit(0))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0


def linked(spark, values):
    classes = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)), d) for d, f in values], "fingerprint long, rep long")
    pairs = sh.links(classes).collect()
    of = dict(values)
    assert all((of[r.a] ^ of[r.b]).bit_count() <= 4 for r in pairs)
    leader = {d: d for d in of}

    def top(d):
        while leader[d] != d:
            d = leader[d]
        return d

    for r in pairs:
        a, b = top(r.a), top(r.b)
        leader[max(a, b)] = min(a, b)
    return {d: top(d) for d in of}, len(pairs)


@pytest.mark.parametrize("groups", [5, 6, 8, 12])
def test_no_pair_is_lost_in_any_grid(spark, monkeypatch, groups):
    """Random fingerprints and neighbours at 1 to 6 bits, across all grids."""
    monkeypatch.setattr(sh, "groups_for", lambda n: groups)
    rng = random.Random(groups)
    found = set()
    for _ in range(250):
        f = rng.getrandbits(64)
        found |= {f} | {f ^ sum(1 << k for k in rng.sample(range(64), r)) for r in range(1, 7)}
    rows = list(enumerate(sorted(found, key=lambda f: f * 0x9E3779B97F4A7C15 % (1 << 64))))
    got, _ = linked(spark, rows)
    assert got == plain_components(rows)


@pytest.mark.parametrize("tile", [64, 512])
def test_large_cluster(spark, monkeypatch, tile):
    """All members within a few bits of each other: cells above a tile lose nothing, and those within one make no more
    than some links for each member."""
    monkeypatch.setattr(sh, "TILE", tile)
    rng = random.Random(3)
    centre, weak = rng.getrandbits(64), rng.sample(range(64), 12)
    counts = []
    for n in (400, 1600):
        rows = list(enumerate(sorted({centre ^ sum(1 << k for k in rng.sample(weak, rng.randint(0, 9))) for _ in range(4 * n)})[:n]))
        got, pairs = linked(spark, rows)
        assert got == plain_components(rows)
        counts.append(pairs / len(rows))
    assert counts[1] < 2 * counts[0] or tile == 64


def test_grid_covers_the_segments_and_names_each_pair_once():
    rng = np.random.default_rng(1)
    for groups in range(5, 13):
        masks, before = sh.grid(groups)
        for _ in range(50):
            f = rng.integers(0, 1 << 63, dtype=np.uint64)
            g = f ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 4, replace=False)))
            x = int(sh.embedded(np.array([f]))[0] ^ sh.embedded(np.array([g]))[0])
            assert x.bit_count() <= (int(f) ^ int(g)).bit_count()
            assert sum(not x & m and all(x & d for d in own) for m, own in zip(masks, before, strict=True)) == 1
