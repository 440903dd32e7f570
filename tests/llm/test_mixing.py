import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.llm import mixing as mx

SCHEMA = "doc_id long, text string, source string, target string, n_chars long"


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0.5, 1e4), min_size=1, max_size=12), st.integers(0, 60))
def test_apportion(spark, votes, seats):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(votes)], "g string, i int, v double")
    got = mx.apportion(rows, F.lit(seats).cast("long"), votes="v", order="i", by=["g"])
    assert [r.quota for r in got.orderBy("i").collect()] == sainte_lague(votes, seats)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(mx.SQL["op2_mixing"])
    want = sorted(tuple(dict(zip(rel.columns, r))[c] for c in ("doc_id", "size", "source_size", "taken", "target")) for r in rel.fetchall())
    got = sorted((r.doc_id, r.size, r.source_size, r.taken, r.target) for r in mx.op2_mixing(spark, sf).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want] and [g[4] for g in got] == pytest.approx([w[4] for w in want])


def test_mix_keeps_its_promises(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mx.mix(docs).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in rows) and len(rows) == docs.count()
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=0.02 * mine[0].target + 3 * mx.BLOCK_WORDS)
        assert sum(r.part not in (0, r.size) for r in mine) <= 1
        ends = mine[0].ends
        assert len(ends) == mx.N_SHARDS and ends == sorted(ends)
    assert sorted((r.doc_id, r.taken) for r in mx.mix(docs).collect()) == sorted((r.doc_id, r.taken) for r in rows)
    out = mx.mixed_rows(docs)
    assert out.columns == docs.columns
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mx.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in rows if r.taken}


def test_awkward_rows(spark):
    rows = [(1, None, "a", "x", 0), (None, "one two three " * 30, None, "x", 1), (2, "word " * 400, "a", "x", 2), (2, "word " * 400, "a", "x", 2), (3, "", "b", None, 0), (4, " \n\t", "b", None, 3), (5, "tiny", "c", None, 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mx.mix(docs).collect()
    assert len(got) == 7 and all(r.taken <= 3 * r.size for r in got)
    assert {r.source: r.source_size for r in got} == {"a": 800, None: 90, "b": 0, "c": 1}
    assert {r.source: round(r.target, 3) for r in got} == {"a": 618.0, None: 270.0, "b": 0.0, "c": 3.0}
    assert delivered(mx.mixed_rows(docs)) == planned(docs)
    assert mx.mix(docs.limit(0)).count() == 0 and mx.mixed_rows(docs.limit(0)).count() == 0


def delivered(rows):
    assert rows.where(mx.word_count(F.col("text")) != F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).count() == 0
    return {(r.source, r.doc_id): r.n for r in rows.groupBy("source", "doc_id").agg(F.sum(mx.word_count(F.col("text"))).alias("n")).collect()}


def planned(docs):
    return {(r.source, r.doc_id): r.n for r in mx.mix(docs).groupBy("source", "doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()}


@pytest.mark.parametrize("hot", [1, 50, 400])
def test_repeated_rows_are_delivered_as_planned(spark, hot):
    """One id stands for many equal rows of source a and the quota of a ends among them, with other columns that clash with
    those of the plan; b has as many distinct ones."""
    rows = [(7, "w1 w2 w3 w4 w5 w6 w7 " * 10, "a", f"x{i % 3}", 0) for i in range(hot)] + [(100 + i, "u v w x y z " * 12, "b", "x", 0) for i in range(50)] + [(None, "no id " * 9, "a", "x", 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("target", "size").withColumn("_words", F.lit("clash")).withColumn("key", F.lit(1))
    out = mx.mixed_rows(docs)
    assert out.columns == docs.columns and delivered(out) == planned(docs)
    assert {r._words for r in out.collect()} == {"clash"} and all(r.n_chars == len(r.text) for r in out.collect())
    assert sorted(out.collect(), key=str) == sorted(mx.mixed_rows(docs).collect(), key=str)


def test_sources_of_ten_trillion_words(spark, monkeypatch):
    """Sizes come from a column, as no test has so much text: quotas, cuts and places neither overflow nor lose a word."""
    monkeypatch.setattr(mx, "word_count", lambda text: text.cast("long"))
    sizes = [(i, str(2_000_000_000_000 + i), "abc"[i % 3]) for i in range(40)] + [(40, "7", "d")]
    docs = spark.createDataFrame(sizes, "doc_id long, text string, source string")
    rows = mx.mix(docs).collect()
    total = sum(int(t) for _, t, _ in sizes)
    assert all(0 <= r.taken <= 3 * r.size for r in rows) and sum(r.taken for r in rows) == pytest.approx(total, rel=1e-9)
    for source in "abcd":
        mine = sorted((r for r in rows if r.source == source), key=lambda r: r.order)
        want = min(mine[0].quota, 3 * mine[0].blocks)
        whole, part = divmod(want, mine[0].blocks)
        assert sum(r.taken for r in mine) == whole * mine[0].source_size + part * mine[0].source_size // mine[0].blocks
        starts = [sum(r.size for r in mine[:i]) for i in range(len(mine))]
        assert [r.first_block for r in mine] == [s * mine[0].blocks // mine[0].source_size for s in starts]
    assert {r.target for r in rows if r.source == "d"} == {21.0}
    copies = mx.mixed_rows(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: r.passes + (r.part > 0) for r in rows if r.taken}
