import random

import corpus_pipeline
from tidemark.llm import near_dup as nd

from .test_near_dup import brute, sets


def test_bands_miss_no_pair_at_the_threshold():
    assert nd.banding(85) == (nd.ROWS, nd.BANDS)
    for percent in (100, 95, 85, 80, 70, 50):
        rows, bands = nd.banding(percent)
        assert rows * bands <= nd.REGISTERS and (1 - (percent / 100) ** rows) ** bands <= nd.MISSED


def test_near_dedup_links_from_80_percent(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(40):  # one word changed in 50: 5 shingles of 46 differ, 41 / 51 = 0.804
        words = [f"w{rnd.randrange(10**6)}" for _ in range(50)]
        other = list(words)
        other[25] = "changed"
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(other))]
        other[35] = "again"  # 0.643 to the first, 0.804 to the second
        rows += [(10 * k + 2, " ".join(other))] if k % 2 else []
    a, b = sets(rows[0][1]), sets(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {d for d, (_, first) in brute(rows, 80).items() if d == first} == {10 * k for k in range(40)}


def test_near_dedup_of_the_table_at_80_percent(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {d for d, (_, first) in brute([(r.doc_id, r.text) for r in docs.collect()], 80).items() if d == first}
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == want and len(want) < len({d for d, (_, f) in brute([(r.doc_id, r.text) for r in docs.collect()]).items() if d == f})
