import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repetition as rp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """All figures with plain tuples."""
    text = text or ""
    words = WORD.findall(text)
    n, total = len(words), sum(map(len, words))
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup_lines += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    grams = lambda k: [tuple(words[i : i + k]) for i in range(n - k + 1)]
    count = Counter(grams(3))
    inside = {j for i, g in enumerate(grams(3)) if count[g] > 1 for j in range(i, i + 3)}
    base = [n, total, sum(c in "#*$%&|<>" for c in text), dup_lines, len(inside)]
    shares = [dup_chars / total if total else 0.0]
    for k in rp.MAX_TOP:
        best = max([c * sum(map(len, g)) for g, c in Counter(grams(k)).items() if c > 1], default=0)
        shares.append(min(1.0, best / total) if total else 0.0)
    for k in rp.MAX_DUP:
        known, later = set(), set()
        for i, g in enumerate(grams(k)):
            if g in known:
                later |= set(range(i, i + k))
            known.add(g)
        shares.append(sum(len(words[j]) for j in later) / total if total else 0.0)
    failed = n < 50 or 100 * len(inside) > 50 * n
    limits = [rp.MAX_DUP_LINE_CHARS, *rp.MAX_TOP.values(), *rp.MAX_DUP.values()]
    return base, shares, failed, not failed and all(s <= m for s, m in zip(shares, limits, strict=True))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from(list("ab #é\n\t ")), max_size=200), max_size=4))
def test_judge(texts):
    got = rp.judge_all(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        base, shares, failed, kept = brute(text)
        assert [got[c][i] for c in rp.BASE] == base and [got[m][i] for m in rp.MEASURES] == shares and (got["base_failed"][i], got["kept"][i]) == (failed, kept)


def test_colliding_hashes_are_told_apart(monkeypatch):
    """Were all words one hash, words in repeated windows would still be counted by the words themselves."""
    true = rp.Words.hashes
    monkeypatch.setattr(rp.Words, "hashes", lambda self, *a, seed=0: true(self, *a, seed=seed) if seed else np.zeros(len(self.begin), np.uint64))
    texts = ["a b c d e f g h", "a b c x a b c y", "", "one two three four one two three"]
    assert rp.judge_all(pa.array(texts))["n_repeat_words"].tolist() == [brute(t)[0][4] for t in texts] == [0, 6, 0, 6]


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = rp.op4_repetition(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base, shares, failed, kept = brute(texts[r.doc_id])
        assert [r[c] for c in rp.BASE] == base and [r.base_failed, r.kept] == [failed, kept] and [r[c] for c in rp.MEASURES] == pytest.approx(shares)


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    rows = rp.op4_repetition(spark, sf).join(good, "doc_id").where("not base_failed").collect()
    assert sum(r.kept for r in rows) >= 0.98 * len(rows) > 0


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, None, 1), (None, "", 2), (1, "x " * 60, 3), (1, "x " * 60, 3), (2, long, 4), (3, " \n\n\t ", 5)]
    got = rp.repetition(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert sorted((r.n_words, r.n_repeat_words, r.kept) for r in got) == [(0, 0, False)] * 3 + [(60, 60, False)] * 2 + [(60000, 0, True)]
    assert rp.repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0
