"""Repair of conversations: the cheapest edits that make a conversation an optional system turn and then pairs of a
user's and an assistant's turn.

A row is a symbol, its role's initial and its fault. A symbol's transfer matrix has, for each two states of the pattern,
the least cost and the audit (the edits' initials) of getting from one to the other across the row; matrices multiply in
the semiring of least (cost, audit) and joined audits. Symbols of all conversations of a batch share a Re-Pair grammar
with one matrix per rule, so a stretch that many conversations have is solved once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, join_skewed, sliced_by_bytes, stored, table
from .repair import repair

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Before anything, after a system turn, after a user's, after an assistant's; the first and the last may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
INITIALS, FAULTS = "sua-", ("none", "blank", "duplicate", "truncated")
#: Rows of a conversation whose symbols are gathered at a time: 2 to the power of it.
GATHERED = 12
SPACE = " \t\n\x0b\f\r"

Matrix = list[list[tuple[int, str] | None]]


def _next(state: int) -> int:
    """Where a user's or an assistant's turn, whichever fits, leads."""
    return ASSISTANT if state == USER else USER


def _better(a: tuple[int, str] | None, b: tuple[int, str] | None) -> tuple[int, str] | None:
    return b if a is None or b is not None and b < a else a


@cache
def inserted() -> Matrix:
    """Insertions alone; more than two come back to a state that costs less."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for n in range(3):
            out[start][state] = _better(out[start][state], (n * INSERT, "I" * n))
            state = _next(state)
    return out


@cache
def row_matrix(symbol: int) -> Matrix:
    """Insertions, then one edit of a row."""
    initial, fault = INITIALS[symbol // 4], FAULTS[symbol % 4]
    extra = CUT_OFF if fault == "truncated" else 0
    edit: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        edit[state][state] = (DELETE, "D")
        if fault in ("blank", "duplicate"):
            continue
        edit[state][_next(state)] = _better(edit[state][_next(state)], (REROLE + extra, "R"))
        kept = SYSTEM if initial == "s" and state == EMPTY else _next(state) if initial == "-sua"[_next(state)] else None
        if kept is not None:
            edit[state][kept] = _better(edit[state][kept], (KEEP + extra, "K"))
    return times(inserted(), edit)


def times(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b. Equal costs are settled by the audits, of which none that join the same states at the same cost
    begins another: what is least in parts is least as a whole."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k, x in enumerate(a[i]):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None and ((best := out[i][j]) is None or x[0] + y[0] < best[0] or x[0] + y[0] == best[0] and x[1] + y[1] < best[1]):
                        out[i][j] = (x[0] + y[0], x[1] + y[1])
    return out


def product(matrices: list[Matrix]) -> Matrix:
    """Of one or more, neighbours first."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def solved(sequences: list[str]) -> list[tuple[int, str]]:
    """Least cost and least of the cheapest audits of sequences of symbols (letters from A on), which share a grammar."""
    codes = np.frombuffer("".join(sequences).encode(), np.uint8).astype(np.int64) - ord("A")
    grammar = repair(codes, np.repeat(np.arange(len(sequences)), list(map(len, sequences))), len(INITIALS) * len(FAULTS), shared=True)
    matrix = {int(x): row_matrix(int(x)) for x in np.unique(codes)}
    for k, (left, right) in enumerate(zip(grammar.left.tolist(), grammar.right.tolist(), strict=True), grammar.terminals):
        matrix[k] = times(matrix[left], matrix[right])
    edges = np.searchsorted(grammar.owner, np.arange(len(sequences) + 1)).tolist()
    symbols, out = grammar.symbols.tolist(), []
    for a, b in zip(edges, edges[1:], strict=False):
        ends = times(product([matrix[x] for x in symbols[a:b]]), inserted())[EMPTY] if b > a else inserted()[EMPTY]
        out.append(_better(ends[EMPTY], ends[ASSISTANT]))
    return out


def illegal(sequence: str) -> int:
    """Neighbouring initials that the pattern does not know."""
    initials = "".join(INITIALS[(ord(x) - ord("A")) // 4] for x in sequence)
    return len(initials) - 1 - sum(initials[i : i + 2] in ("su", "ua", "au") for i in range(len(initials) - 1))


SOLVED = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Solved(Memo):
    """Figures of sequences; those of a batch that are not known are solved together."""

    def figures(self, sequences: list[str]) -> list[tuple]:
        out = {s: self[s] for s in set(sequences) if s in self}
        new = sorted(set(sequences) - out.keys())
        for s, (cost, audit) in zip(new, solved(new), strict=True) if new else ():
            counts = [sum(s.count(chr(ord("A") + 4 * i + FAULTS.index(f))) for i in range(4)) for f in FAULTS[1:]]
            out[s] = self.keep(s, (*counts, illegal(s), cost, audit))
        return [out[s] for s in sequences]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Solved(20_000)
    for batch in sliced_by_bytes(batches, 1):
        columns = zip(*memo.figures(batch.column(1).to_pylist()), strict=True)
        kinds = [pa.int64()] * 5 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [c.split()[0] for c in SOLVED.split(", ")])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of conversations, each led by its audit, to a digest of each."""
    conv, digest, first, edits, left, done = None, None, True, iter(""), 0, []

    def line(role, text=None):
        nonlocal first, left
        said = ("" if first else "\n") + (role or ("assistant" if left % 2 else "user")) + ":"
        digest.update(said.encode())
        if text:
            digest.update(text.encode())
        first, left = False, left - 1

    def finish():
        for _ in edits:
            line(None)
        done.append((conv, digest.hexdigest()))

    def batch_of():
        a, b = zip(*done, strict=True)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string())], ["conv_id", "repaired_sha256"])

    for batch in sliced_by_bytes(batches, 3):
        for own, at, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at < 0:
                if digest is not None:
                    finish()
                conv, digest, first, edits, left = own, hashlib.sha256(), True, iter(text), len(text) - text.count("D")
                continue
            for edit in edits:
                if edit != "I":
                    break
                line(None)
            if edit == "K":
                line(role, text)
            elif edit == "R":
                line(None, text)
        if done:
            yield batch_of()
    if digest is not None:
        finish()
        yield batch_of()


def faulty(rows: DataFrame) -> DataFrame:
    """Add symbol: initial and first fault of rows (conv_id, at, role, text; a stored table whose `at` is their order)."""
    tail = F.rtrim("text", F.lit(SPACE))
    digest = F.unhex(F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    light = rows.select(
        "conv_id", "at", digest.alias("said"), F.substring("role", 1, 1).alias("initial"), (tail == "").alias("blank"), F.substring(tail, -1, 1).isin(".", "!", "?").alias("ended")
    )
    again = stored(light.groupBy("said").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).where("n > 1").select("said", "first_at"))
    known = join_skewed(light, again, "said", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("at") > F.col("first_at"), 2).when(~F.col("ended"), 3).otherwise(0)
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    return known.select("conv_id", "at", F.char(F.lit(ord("A")) + initial * 4 + fault).alias("symbol"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) stored in the order of conversation and turn (nulls first), with their
    place in it as `at`; rows of the same turn go by role, digest of the text and copy."""
    keys = ["conv_id", "turn", "role", "digest", "copy"]
    rows = rows.withColumn("digest", F.md5("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")))


def repaired(conversations: DataFrame, change=None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows: a row per conv_id of
    conversations (conv_id long, turn long, role, text; other columns are ignored).

    Nulls in role and text are one space; a null conv_id is a conversation of its own, null turns come first. change()
    may alter the rows (conv_id, turn, role, text) and add copies (column copy) before anything is looked at; a
    conversation that it leaves without rows has zeros, an empty audit and the digest of an empty text. gaps: turns that
    are missing between the first and the last. Repeated rows are duplicates of the first. An empty table gives no rows.

    Rows are ordered and looked at by tasks of any part of a conversation. A conversation's symbols, a byte a row, and
    its audit are one cell each, and its digest is worked out by one task, in a stream: a digest cannot be cut.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    plain = conversations.select("conv_id", "turn", blank("role"), blank("text"))
    rows = ordered(change(plain) if change else plain.withColumn("copy", F.lit(0)))
    symbols = faulty(rows)
    in_order = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["symbol"]), "")
    blocks = symbols.groupBy("conv_id", F.shiftright("at", GATHERED).alias("block")).agg(in_order(F.struct("at", "symbol")).alias("symbol"))
    whole = blocks.groupBy("conv_id").agg(in_order(F.struct("block", "symbol")).alias("symbols"))
    figures = stored(whole.mapInArrow(_solve, SOLVED))
    lines = rows.select("conv_id", "at", "role", "text").union(figures.select("conv_id", F.lit(-1).cast("long"), F.lit(None).cast("string"), "audit"))
    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_repaired, "conv_id long, repaired_sha256 string")
    turns = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_rows"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    every = conversations.select("conv_id").distinct()
    for name, own in (("_t", turns), ("_f", figures), ("_h", hashed)):
        every = every.join(own.withColumnRenamed("conv_id", name), F.col("conv_id").eqNullSafe(F.col(name)), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select(
        "conv_id", number("gaps"), *map(number, FAULTS[1:]), number("illegal"), number("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"), number("n_rows"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, told by a checksum of conversation and turn: some go, some are blank, lose their stops,
    stand twice or get another role."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k: Column = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))), F.lit(20))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(0), F.when(k == 3, 1).otherwise(0)))
    return rows.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"), damaged)


SQL = {
    "op12_conversation_repair": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
k AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS k FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE k <> 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS tail, left(role, 1) AS initial FROM d),
s AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY r, role, text) THEN 'duplicate' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
  lag(initial) OVER (PARTITION BY r ORDER BY i) AS before FROM o),
keeps(st, initial, nxt) AS (VALUES ('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('A', 'u', 'U'), ('U', 'a', 'A')),
moves(st, nxt) AS (VALUES ('E', 'U'), ('S', 'U'), ('A', 'U'), ('U', 'A')),
ins(st, nxt, n) AS (VALUES ('E', 'E', 0), ('E', 'U', 1), ('E', 'A', 2), ('S', 'S', 0), ('S', 'U', 1), ('S', 'A', 2), ('U', 'U', 0), ('U', 'A', 1), ('A', 'A', 0), ('A', 'U', 1)),
edits AS (
  SELECT r, i, st, st AS nxt, 2 AS cost, 'D' AS e FROM s, (SELECT DISTINCT st FROM ins)
  UNION ALL SELECT r, i, st, nxt, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R' FROM s, moves WHERE fault IN ('none', 'truncated')
  UNION ALL SELECT r, i, st, nxt, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K' FROM s JOIN keeps USING (initial) WHERE fault IN ('none', 'truncated')),
steps(r, i, st, z) AS (
  SELECT r, 0::BIGINT, nxt, lpad(CAST(5 * n AS VARCHAR), 12, '0') || repeat('I', n) FROM (SELECT DISTINCT r FROM s), ins WHERE st = 'E'
  UNION ALL
  SELECT p.r, e.i, n.nxt, min(lpad(CAST(CAST(left(z, 12) AS BIGINT) + e.cost + 5 * n.n AS VARCHAR), 12, '0') || substr(z, 13) || e.e || repeat('I', n.n))
  FROM steps p JOIN edits e ON e.r = p.r AND e.i = p.i + 1 AND e.st = p.st JOIN ins n ON n.st = e.nxt GROUP BY p.r, e.i, n.nxt),
best AS (SELECT r, min(z) AS z FROM steps JOIN (SELECT r, max(i) AS i FROM s GROUP BY r) USING (r, i) WHERE st IN ('E', 'A') GROUP BY r),
walk AS (SELECT r, unnest(string_split(substr(z, 13), '')) AS e, unnest(range(1, length(z) - 11)) AS j FROM best WHERE length(z) > 12),
placed AS (SELECT r, e, j, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY r ORDER BY j DESC) AS rest FROM walk WINDOW w AS (PARTITION BY r ORDER BY j)),
lines AS (
  SELECT p.r, j, CASE WHEN e = 'K' THEN s.role WHEN rest % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE s.text END AS line
  FROM placed p LEFT JOIN s ON s.r = p.r AND s.i = p.i WHERE e <> 'D'),
told AS (SELECT r, string_agg(line, chr(10) ORDER BY j) AS text FROM lines GROUP BY r),
figures AS (
  SELECT r, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM s GROUP BY r)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(z, 12) AS BIGINT), 0) AS cost, coalesce(substr(z, 13), '') AS audit, sha256(coalesce(told.text, '')) AS repaired_sha256, coalesce(n_rows, 0) AS n_rows
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN figures f ON f.r IS NOT NULL AND f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best USING (r) LEFT JOIN told USING (r)
"""
}
