import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.llm import preference as pf

SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def results(spark, folder, rows):
    """What the query and its SQL make of a table of conversations."""
    path = str(folder / "conversations.parquet")
    pq.write_table(pa.table(list(zip(*rows, strict=True)), schema=SCHEMA), path)
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{path}'")
    rel = duck.sql(pf.SQL["op1_preference"])
    return sorted(map(tuple, pf.op1_preference(spark, str(folder)).select(*rel.columns).collect())), sorted(rel.fetchall())


def test_texts_are_not_broadcast(spark, tmp_path):
    """12 MB of last answers of 60 conversations, where no broadcast may have more than 4 MB."""
    rows = [x for c in range(60) for x in ((c, 0, "user", f"q{c}"), (c, 1, "assistant", f"{c:08} " * 22_000))]
    conf = {"spark.sql.maxBroadcastTableSize": "4m", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got, wanted = results(spark, tmp_path, rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == wanted and len(got) == 90


def test_last_answers_without_a_text_and_repeated_ones(spark, tmp_path):
    """A conversation gives on its last answer that has a text; an answer given twice is replaced twice."""
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "first"), (0, 2, "user", "more"), (0, 3, "assistant", None),
        (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, "assistant", "late"),
        (2, 0, "assistant", None), (3, 0, "assistant", "x"), (4, 5, "assistant", "x"), (4, 5, "user", "x"), (4, 6, None, None),
        (None, 0, "assistant", "nobody"), (-1, 0, "assistant", "minus"), (2**63 - 1, 0, "assistant", "end"), (8, 0, "user", "alone"),
    ]
    got, wanted = results(spark, tmp_path, rows)
    assert got == wanted
    rejected = {r[1]: r[4] for r in got if r[0] == "variant"}
    assert rejected[1] == "<|assistant|>\nfirst\n" * 3 + "<|assistant|>\nlate\n" and rejected[0] == "<|assistant|>\nminus\n"


def test_turns_rendered_alike_are_one_span(spark, tmp_path):
    """A null text and an empty one differ where sides are compared, and are one span of the mask."""
    rows = [(0, 0, "assistant", None), (0, 0, "assistant", ""), (0, 0, "assistant", "x"), (0, 1, "assistant", ""), (0, 2, "user", None), (1, None, "assistant", ""), (1, None, "assistant", None), (1, 0, None, "u"), (1, 0, "unknown", "u")]
    got, wanted = results(spark, tmp_path, rows)
    assert got == wanted
    alike = len("<|assistant|>\n\n")
    assert next(r[5] for r in got if r[0] == "unlike") == f"0-{2 * alike},{2 * alike}-{3 * alike + 1},{3 * alike + 1}-{4 * alike + 1}"


def test_texts_move_once(spark, sf):
    """Two exchanges: of the turns, and of what a pair is given from the one before it."""
    plan = pf.op1_preference(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "BroadcastExchange" not in plan
