import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import structure as sr

SCHEMA = "conv_id long, turn long, role string, text string"


def fits(initials):
    rest = initials[1:] if initials.startswith("s") else initials
    return initials == "" or len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)


def plain_edits(rows):
    """rows of (role, fault) to (cost, audit), every row edited in every way, with up to two insertions at each place."""
    best = {("", ""): 0}  # initials so far and audit: the least cost

    def insertions(paths):
        out = dict(paths)
        for _ in range(2):
            for (initials, audit), cost in list(out.items()):
                for x in "ua":
                    out.setdefault((initials + x, audit + "I"), cost + 5)
        return out

    for role, fault in rows:
        new = {}
        for (initials, audit), cost in insertions(best).items():
            ways = [("", "D", 2)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                ways += [(role[:1] or "-", "K", extra), ("u", "R", 1 + extra), ("a", "R", 1 + extra)]
            for x, edit, more in ways:
                state = initials + x
                if fits(state) or fits(state + "a") or state == "s":
                    key = (state, audit + edit)
                    new[key] = min(new.get(key, 1 << 30), cost + more)
        least = {}  # of the paths that end alike, the least
        for (initials, audit), cost in new.items():
            end = initials[-1:] or ""
            if end not in least or (cost, audit) < least[end][0]:
                least[end] = ((cost, audit), initials)
        best = {(initials, audit): cost for (cost, audit), initials in least.values()}
    return min((cost, audit) for (initials, audit), cost in insertions(best).items() if fits(initials))


def plain(rows):
    """(conv_id, turn, role, text) to the promised figures, by the plainest path; rows of equal turns are the copies."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
            mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        seen, faults = set(), []
        for _, role, text in mine:
            tail = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "none")
            seen.add((role, text))
        cost, audit = plain_edits([(role, fault) for (_, role, _), fault in zip(mine, faults, strict=True)])
        at, lines, n = 0, [], len(audit) - audit.count("D")
        for edit in audit:
            fitting = "user" if (n - len(lines)) % 2 == 0 else "assistant"
            if edit != "I":
                _, role, text = mine[at]
                at += 1
            if edit != "D":
                lines.append(f"{role}:{text}" if edit == "K" else f"{fitting}:{text if edit == 'R' else ''}")
        turns = [t for t, _, _ in mine if t is not None]
        initials = [role[:1] for _, role, _ in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in sr.FAULTS[1:]), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(mine),
        )
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(sr.FAULTS)), max_size=14), min_size=1, max_size=5))
def test_least_edits(conversations):
    sequences = ["".join(chr(65 + 4 * ("sua".find(role[:1]) if role[:1] in tuple("sua") else 3) + sr.FAULTS.index(fault)) for role, fault in c) for c in conversations]
    assert sr.solved(sequences) == [plain_edits(c) for c in conversations]


def test_long_conversations_share_rules():
    rng = random.Random(2)
    long = "".join(chr(65 + rng.choice([0, 4, 4, 8, 8, 12, 6, 7])) for _ in range(3000))
    cost, audit = sr.solved([long, "EI" * 2000, ""])[0]
    assert sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit) <= cost and len(audit) - audit.count("I") == 3000
    assert sr.solved(["EI" * 2000, ""]) == [(0, "K" * 4000), (0, "")]
    halves = [sr.product([sr.row_matrix(ord(x) - 65) for x in long[i : i + 1500]]) for i in (0, 1500)]
    ends = sr.times(sr.times(*halves), sr.inserted())[sr.EMPTY]
    assert min(x for x in (ends[sr.EMPTY], ends[sr.ASSISTANT]) if x) == (cost, audit)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = sr.op12_conversation_repair(spark, sf)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rel = con.sql(sr.SQL["op12_conversation_repair"])
    assert result.columns == rel.columns
    assert got(result) == {r[0]: r[1:] for r in rel.fetchall()} == plain(rows)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 3, "user", "a b."), (1, 9, "user", "a b."), (1, 4, "assistant", "cut"), (None, 0, "system", "s."), (None, 1, "user", "q?"), (None, None, "assistant", "a!"), (2, None, "user", None), (2, 7, "tool", "x." * 50000)]
    rows += [(k, t, ("system", "user", "assistant", "", "Sam", "observer")[(k * t) % 6], f"text {k * t % 4}" + ("." if t % 3 else "  ") + " \n" * (t % 2)) for k in range(3, 40) for t in range(-2, k % 9)]
    want = plain(rows)
    with_more = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], SCHEMA + ", at long, symbol long")
    assert got(sr.repaired(with_more, sr.damaged)) == want
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.sql(sr.SQL["op12_conversation_repair"]).fetchall()} == want
    empty = sr.repaired(with_more.limit(0), sr.damaged)
    assert empty.count() == 0 and empty.columns == ["conv_id", "gaps", *sr.FAULTS[1:], "illegal", "cost", "audit", "repaired_sha256", "n_rows"]


def test_rows_that_all_go(spark):
    """Conversations of one row, which the damage may drop, have zeros."""
    rows = [(k, 0, "user", "only one.") for k in range(200)]
    result = got(sr.repaired(spark.createDataFrame(rows, SCHEMA), sr.damaged))
    gone = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    assert gone and all(result[k] == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest(), 0) for k in gone) and len(result) == 200


def test_repeated_rows_and_hot_conversation(spark, monkeypatch):
    """A third of all rows in one conversation, over many blocks of symbols; repeated rows are duplicates of the first."""
    monkeypatch.setattr(sr, "GATHERED", 4)
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 90}.") for t in range(300)] + [(k, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for k in range(1, 101) for t in range(6)]
    assert got(sr.repaired(spark.createDataFrame(rows, SCHEMA).repartition(7), sr.damaged)) == plain(rows)
    same = spark.createDataFrame([(1, 1, "user", "hi."), (1, 1, "user", "hi."), (1, 2, "assistant", "yes.")], SCHEMA)
    assert got(sr.repaired(same))[1][:6] == (0, 0, 1, 0, 1, 2)


@pytest.mark.parametrize("sequence, want", [("E", (2, "D")), ("AEI", (0, "KKK")), ("A", (2, "D")), ("EE", (1, "KR")), ("IE", (2, "RR")), ("EEI", (2, "DKK"))])
def test_small_cases(sequence, want):
    assert sr.solved([sequence]) == [want]
