from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import preference as pf

SCHEMA = "pair_id long, rejected boolean, turn long, role string, text string"


def test_pairs(spark):
    rows = [
        (1, False, 0, "user", "q"), (1, False, 1, "assistant", "a"), (1, False, 2, "user", "more"), (1, False, 3, "assistant", "good"),
        (1, True, 0, "user", "q"), (1, True, 1, "assistant", "a"), (1, True, 2, "user", "more"), (1, True, 3, "assistant", "bad"),
        (2, False, 0, "user", "same"), (2, True, 0, "user", "same"), (3, False, 0, "user", "alone"),
        (4, False, 0, None, None), (4, True, 0, None, None), (4, False, None, "assistant", "late"), (None, True, 0, "user", "nobody"),
        (5, False, 0, "user", "twice"), (5, False, 0, "user", "twice"), (5, True, 0, "user", "twice"),
    ]
    seg = pf.preference_segments(spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r.pair_id, r.part, r.turn, r.text, r.copies, r.trained) for r in seg.collect()), key=str)
    u, a = (lambda t: f"<|user|>\n{t}\n"), (lambda t: f"<|assistant|>\n{t}\n")
    assert got == sorted([
        (1, "prompt", 0, u("q"), 1, False), (1, "prompt", 1, a("a"), 1, False), (1, "prompt", 2, u("more"), 1, False), (1, "chosen", 3, a("good"), 1, True), (1, "rejected", 3, a("bad"), 1, True),
        (2, "prompt", 0, u("same"), 1, False), (3, "chosen", 0, u("alone"), 1, False), (4, "prompt", 0, "<|unknown|>\n\n", 1, False), (4, "chosen", None, a("late"), 1, True),
        (None, "rejected", 0, u("nobody"), 1, False), (5, "chosen", 0, u("twice"), 2, False), (5, "rejected", 0, u("twice"), 1, False),
    ], key=str)
    one = {r.pair_id: r for r in pf.assembled(seg).collect()}[1]
    assert one.prompt == u("q") + a("a") + u("more") and one.chosen == a("good") and [tuple(s) for s in one.chosen_mask] == [(0, len(a("good")))]


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", part string, copies int")
    assert pf.preference_segments(empty).count() == 0 and pf.assembled(pf.preference_segments(empty)).count() == 0


def by_hand(rows):
    """pair_id to prompt, chosen, rejected and masks of turns (pair_id, rejected, turn, role, text), in plain loops."""
    out = {}
    render = lambda r, t: f"<|{r or 'unknown'}|>\n{t or ''}\n"
    for pair in {r[0] for r in rows} - {None}:
        sides = [[(t, r or "", x or "", r, x) for p, j, t, r, x in rows if p == pair and j == side] for side in (False, True)]
        turns = sorted({t for s in sides for t, *_ in s if t is not None})
        of = lambda s, t: sorted(((r, x) for u, _, _, r, x in s if u == t), key=str)
        shared = []
        for t in turns if all(sides) else ():
            if of(sides[0], t) != of(sides[1], t):
                break
            shared.append(t)
        late = lambda t: (t is None, t or 0)
        text, spans = [], []
        for side in ([x for x in sides[0] if x[0] in shared], *([x for x in s if x[0] not in shared] for s in sides)):
            made, mask = "", []
            for (t, _, _, r, x), n in sorted(Counter(side).items(), key=lambda i: (late(i[0][0]), i[0][3] or "unknown", render(i[0][3], i[0][4]))):
                if r == "assistant":
                    mask.append((len(made), len(made) + n * len(render(r, x))))
                made += n * render(r, x)
            text.append(made)
            spans.append(mask)
        out[pair] = (*text, spans[1], spans[2])
    return out


def test_pairs_equal_brute_force_and_share_prompts(spark, sf):
    """Every conversation of the table against itself with another answer, and awkward ones: nulls, repeated turns, long
    texts, conversations without an answer."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = [(None, 0, "user", "nobody"), (9001, None, "assistant", "late"), (9001, 0, None, None), (9002, 0, "user", "w " * 50000), (9002, 1, "assistant", "a"), (9002, 1, "assistant", "a"), (9003, 0, "assistant", None), (9003, 0, "assistant", None)]
    turns = turns.union(spark.createDataFrame(more, turns.schema)).withColumn("text_x", F.lit(1)).drop("text_x")
    pairs = pf.variants(turns)
    got = {r.pair_id: (r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]) for r in pf.assembled(pf.preference_segments(pairs)).collect()}
    assert got == by_hand([tuple(r) for r in pairs.collect()])
    assert sum(bool(p) for p, *_ in got.values()) > 0.9 * len(got) and sum(c != r for _, c, r, *_ in got.values()) > 0.7 * len(got)
    assert got[9003][1].startswith("<|assistant|>\n\n") and got[9003][2] == "<|assistant|>\na\n" * 2


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rel = duck.sql(pf.SQL["op1_preference"])
    got = sorted(map(tuple, pf.op1_preference(spark, sf).select(*rel.columns).collect()))
    assert got == sorted(rel.fetchall()) and {g[0] for g in got} == {"variant", "unlike"}
