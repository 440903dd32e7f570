import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.llm import decontaminate as dc


def brute(pattern, text):
    """Least distance of the pattern to a substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@settings(max_examples=500, deadline=None)
@given(st.text("abc", min_size=1, max_size=15), st.text("abc", max_size=40))
def test_distance(pattern, text):
    assert dc.nearest(pattern, text)[0] == brute(pattern, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_matcher_equals_brute_force(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(4, 9)))) for i in range(5)]
    text = " ".join(word() for _ in range(20)) + " " + rnd.choice(items)[1].upper() + "\n" + " ".join(word() for _ in range(5))
    chars = list(text)
    for _ in range(rnd.randint(0, 4)):
        chars[rnd.randrange(len(chars))] = rnd.choice(["", "x", "ab"])
    text = "".join(chars)
    items += [(9, "ab"), (10, "c"), (11, "abc cab"), (12, items[0][1])]
    assert {x["item_id"]: x["distance"] for x in dc.Matcher(items, 0.2)(text)} == expected(items, text, 0.2)


def expected(items, text, rate):
    want = {}
    for i, t in items:
        t, budget = dc.normal(t), int(len(dc.normal(t)) * rate)
        d = brute(t, dc.normal(text)) if budget else int(f" {t} " not in f" {dc.normal(text)} ")
        if d <= budget:
            want[i] = d
    return want


def test_items_that_share_a_piece():
    """A hundred items begin alike; one document holds two of them, one only what they share."""
    rnd = random.Random(4)
    shared = "which of the following statements is true of "
    items = [(i, shared + " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(5))) for i in range(100)]
    match = dc.Matcher(items, 0.05)
    assert max(len(w) for _, (_, w, _) in match.automaton.items()) == 100
    for text in (items[7][1] + " and " + items[70][1].replace("a", "", 1) + ".", shared + "nothing in particular", items[3][1].upper()):
        assert {x["item_id"]: x["distance"] for x in match(text)} == expected(items, text, 0.05)


def test_whole_table(spark, sf):
    """Every document against every item by plain search for what is exact, and no clean document is lost."""
    docs = {r.doc_id: dc.normal(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: dc.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = {r.doc_id: r for r in dc.op9_decontaminate(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    for d, text in docs.items():
        exact = {i for i, t in items.items() if t in text}
        got = {int(x) for x in rows[d].item_ids.split(",") if x}
        assert exact <= got and rows[d].kept == (not got)
        for i in got - exact:
            assert brute(items[i], text) <= int(len(items[i]) * dc.ERROR_RATE)


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "no id for this item here"), (3, None), (4, ""), (5, "short")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x ONE  two\nthree four five six seven y", "a"), (2, None, "b"), (None, "", "c"), (2, "short", "d"), (3, "one two three fuor five six seven", "e"), (4, "word " * 50000 + "one two three four five siix seven", "f")],
        "doc_id long, text string, distance string",
    )
    more = docs.withColumn("digest", F.lit("x")).withColumn("items", F.lit(1)).withColumn("_benchmark_items", F.lit(2))
    assert dc.clean(more, items, rate=0.07).columns == more.columns and dc.contaminated(more, items).columns == more.columns
    got = dc.contaminated(docs, items, rate=0.07)
    assert got.columns == ["doc_id", "text", "distance", "_benchmark_items"]
    found = {r.distance: sorted({(x.item_id, x.distance) for x in r._benchmark_items}) for r in got.collect()}
    assert found == {"a": [(1, 0)], "b": [], "c": [], "d": [(5, 0)], "e": [(1, 2)], "f": [(1, 1)]}
    assert {r.distance for r in dc.clean(docs, items, rate=0.07).collect()} == {"b", "c"}
    few = dc.contaminated(docs, items, rate=0.07, block_items=1)
    assert {r.distance: sorted({(x.item_id, x.distance) for x in r._benchmark_items}) for r in few.collect()} == found
    assert dc.clean(docs.limit(0), items).count() == 0 and dc.clean(docs, items.limit(0)).count() == 6
