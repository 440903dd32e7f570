"""Preference formatting: a prompt rendered once, and the chosen and the rejected completion with a loss mask.

Two conversations share their longest common prefix of turns. Turns are compared by counting each (turn, role, text) on
either side, so that a conversation of any length is spread over tasks: nothing gathers a whole conversation but what
makes it a row, as assembled() does; rows that are gathered for that first are counted where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

TRAINED_ROLE = "assistant"


def preference_segments(turns: DataFrame) -> DataFrame:
    """turns (pair_id, rejected boolean, turn, role, text) to pair_id, part, turn, role, text, copies, trained.

    part: `prompt` for the turns before the first turn number at which the sides differ, once for both sides; then
    `chosen` and `rejected` for the rest. text: the rendered turn. trained: whether the loss counts there: turns of the
    assistant in completions. copies: how often the same turn is repeated. Equal sides are all prompt. A pair with one
    side has no prompt. Rows without a pair_id are `chosen` or `rejected` without a partner; rows without a turn number
    come after all others and are never prompt; a null role is `unknown`, a null text empty; no turns give no rows.
    """
    counted = stored(_counted(turns, ("pair_id",)))
    pairs = counted.where("pair_id is not null").groupBy("pair_id").agg(*_fork(lambda total: total))
    return _parts(counted.join(pairs, "pair_id", "left"), ("pair_id",))


def gathered_segments(turns: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """preference_segments() of pairs told apart by several keys, none of them null, of which the first has dealt the rows
    to tasks already: no row moves."""
    pair = Window.partitionBy(*keys)
    return _parts(_counted(turns, keys).select("*", *_fork(lambda total: total.over(pair))), keys)


def _counted(turns: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return turns.groupBy(*keys, "turn", "role", "text").agg(F.count_if(~F.col("rejected")).alias("n_chosen"), F.count_if("rejected").alias("n_rejected"))


def _fork(of) -> tuple:
    """The first turn number at which the sides of a pair differ, and whether it has both; of: its totals, as they are taken."""
    differ = F.when(F.col("n_chosen") != F.col("n_rejected"), F.col("turn"))
    return of(F.min(differ)).alias("fork"), ((of(F.sum("n_chosen")) > 0) & (of(F.sum("n_rejected")) > 0)).alias("both")


def _parts(joined: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    shared = F.col("both") & F.col("turn").isNotNull() & (F.col("fork").isNull() | (F.col("turn") < F.col("fork")))
    part = lambda name, n: F.struct(F.lit(name).alias("part"), n.cast("long").alias("copies"))
    own = F.filter(F.array(part("chosen", F.col("n_chosen")), part("rejected", F.col("n_rejected"))), lambda x: x["copies"] > 0)
    parts = F.when(F.coalesce(shared, F.lit(False)), F.array(part("prompt", F.col("n_chosen")))).otherwise(own)
    role = F.coalesce("role", F.lit("unknown"))
    rendered = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = joined.select(*keys, "turn", role.alias("role"), rendered.alias("text"), F.explode(parts).alias("p"))
    return rows.select(*keys, "p.part", "turn", "role", "text", "p.copies", ((F.col("role") == TRAINED_ROLE) & (F.col("p.part") != "prompt")).alias("trained"))


def assembled(segments: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """The keys of a pair, prompt, chosen, rejected (strings) and chosen_mask, rejected_mask (spans of characters with a
    loss, as start, end): for conversations that fit a row; a row per pair."""
    keep = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text", "copies", "trained")
    turns = segments.where("pair_id is not null").groupBy(*keys).pivot("part", ["prompt", "chosen", "rejected"]).agg(F.array_sort(F.collect_list(keep)))
    text = lambda c: F.array_join(F.transform(F.coalesce(c, F.expr("array()")), lambda x: F.repeat(x["text"], x["copies"].cast("int"))), "")

    def mask(c):  # turns that are rendered alike are one span
        alike = lambda x, y: F.coalesce(x["turn"].eqNullSafe(y["turn"]) & (x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False))
        width = lambda x: (F.char_length(x["text"]) * x["copies"]).cast("int")
        sized = F.transform(c, lambda x, i: F.struct(width(x).alias("width"), x["trained"].alias("trained"), alike(F.get(c, i - 1), x).alias("again")))
        begun = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

        def grown(s, x):
            end = s["at"] + x["width"]
            start = F.when(x["again"], F.element_at(s["spans"], -1)["start"]).otherwise(s["at"])
            before = F.when(x["again"], F.slice(s["spans"], 1, F.size(s["spans"]) - 1)).otherwise(s["spans"])
            return F.struct(end.alias("at"), F.when(x["trained"], F.concat(before, F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["spans"]).alias("spans"))

        return F.aggregate(F.coalesce(sized, F.expr("array()")), begun, grown, lambda s: s["spans"])

    masked = turns.select("*", mask(F.col("chosen")).alias("chosen_mask"), mask(F.col("rejected")).alias("rejected_mask"))
    return masked.select(*keys, *(text(F.col(c)).alias(c) for c in ("prompt", "chosen", "rejected")), "chosen_mask", "rejected_mask")


def answered(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text; rows without a conv_id are left out) with `pair`, conv_id / 2 rounded down,
    and `put`: the text in place of a last turn of the assistant, null for other turns.

    A pair's rows are one task's, and sorted by it. Their texts move once; what a pair is given from the one before moves
    as a row a pair. No text is broadcast, as no number of rows bounds it.
    """
    known = turns.where("conv_id is not null").select(F.shiftright("conv_id", 1).alias("pair"), "conv_id", "turn", "role", "text")
    odd = F.col("conv_id").bitwiseAND(1) == 1
    answer = F.coalesce(F.col("turn").isNotNull() & (F.col("role") == TRAINED_ROLE), F.lit(False))
    said = answer & F.col("text").isNotNull()
    given = known.where(odd & said).groupBy((F.col("pair") + 1).alias("pair")).agg(F.max_by("text", F.struct("turn", "text")).alias("given"))
    whole = Window.partitionBy("pair")
    at = lambda side: F.max(F.when(answer & side, F.col("turn"))).over(whole)
    own = F.max(F.when(said & ~odd, F.struct("turn", "text"))).over(whole)
    met = known.join(given.hint("merge"), "pair", "left").select("*", at(~odd).alias("at_even"), at(odd).alias("at_odd"), own.alias("own"))
    last = answer & (F.col("turn") == F.when(odd, F.col("at_odd")).otherwise(F.col("at_even")))
    put = F.coalesce(F.when(odd, F.col("own.text")).otherwise(F.col("given")), F.lit(""))
    return met.select("pair", "conv_id", "turn", "role", "text", F.when(last, put).alias("put"))


def variants(turns: DataFrame) -> DataFrame:
    """Pairs that share turns, from conversations (conv_id, turn, role, text) which have no pairs of their own: each is
    chosen, and rejected with its last turn of the assistant replaced by that of the conversation numbered before it
    (conv_id - 1; an empty text where there is none). pair_id, rejected, turn, role, text.

    A conversation without an assistant's numbered turn is a pair of equal sides. Rows of one turn number are replaced
    together, each row being one turn; rows without a conv_id stand on the chosen side alone. A null text is no answer to
    put elsewhere: the last one before it is.
    """
    known = _sided(answered(turns), _own_sides()).select("pair_id", "rejected", "turn", "role", "text")
    return known.union(turns.where("conv_id is null").select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("rejected"), "turn", "role", "text"))


def _side(kind: str, pair_id, rejected, text):
    return F.struct(F.lit(kind).alias("kind"), pair_id.alias("pair_id"), rejected.alias("rejected"), text.alias("text"))


def _own_sides() -> list:
    conv = F.col("conv_id")
    return [_side("variant", conv, F.lit(False), F.col("text")), _side("variant", conv, F.lit(True), F.coalesce("put", "text"))]


def _sided(rows: DataFrame, sides: list) -> DataFrame:
    """Rows of answered() on each of some sides, dealt as they were."""
    return rows.select("pair", "turn", "role", F.explode(F.array(*sides)).alias("s")).select("pair", "s.kind", "s.pair_id", "s.rejected", "turn", "role", "s.text")


def op1_preference(spark, sf_dir: str) -> DataFrame:
    """Masked pairs of the whole table, by way of assembled(): of variants(), whose sides share a prompt, and of unlike
    conversations, 2k as chosen and 2k + 1 as rejected, which share one only by chance. Masks are written as
    start-end, joined by commas. Either kind has its texts from answered(), where a pair's rows are one task's."""
    unlike = _side("unlike", F.col("pair"), F.col("conv_id").bitwiseAND(1) == 1, F.col("text"))
    rows = _sided(answered(table(spark, sf_dir, "conversations")), [*_own_sides(), unlike])
    keys = ("pair", "kind", "pair_id")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return assembled(gathered_segments(rows, keys), keys).select("kind", "pair_id", "prompt", "chosen", "rejected", listed("chosen_mask"), listed("rejected_mask"))


_SIDES = """
 t AS (
  SELECT 'variant' AS kind, conv_id AS pair_id, 0 AS side, turn, role, text FROM conversations
  UNION ALL SELECT 'variant', c.conv_id, 1, c.turn, c.role, CASE WHEN c.turn = l.at AND c.role = 'assistant' THEN coalesce(o.own, '') ELSE c.text END
  FROM conversations c LEFT JOIN l ON c.conv_id = l.conv_id LEFT JOIN l o ON o.conv_id = c.conv_id - 1 WHERE c.conv_id IS NOT NULL
  UNION ALL SELECT 'unlike', conv_id >> 1, coalesce(conv_id & 1, 0), turn, role, text FROM conversations),
"""

SQL = {
    "op1_preference": f"""
WITH l AS (
  SELECT conv_id, max(turn) AS at, arg_max(text, {{'a': turn, 'b': text}}) AS own FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role = 'assistant' GROUP BY conv_id),{_SIDES}
sides AS (
  SELECT kind, pair_id, turn, list_sort(list(coalesce(role, '~null') || chr(1) || coalesce(text, '~null')) FILTER (side = 0)) AS a,
         list_sort(list(coalesce(role, '~null') || chr(1) || coalesce(text, '~null')) FILTER (side = 1)) AS b
  FROM t GROUP BY kind, pair_id, turn),
pairs AS (SELECT kind, pair_id, count(DISTINCT side) = 2 AS complete FROM t WHERE pair_id IS NOT NULL GROUP BY kind, pair_id),
fork AS (SELECT kind, pair_id, min(turn) AS fork FROM sides WHERE a IS DISTINCT FROM b GROUP BY kind, pair_id),
placed AS (
  SELECT t.kind, t.pair_id, side, turn, coalesce(role, 'unknown') AS role, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS txt,
    CASE WHEN complete AND turn IS NOT NULL AND (fork IS NULL OR turn < fork) THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part
  FROM t JOIN pairs p ON t.kind = p.kind AND t.pair_id = p.pair_id LEFT JOIN fork f ON t.kind = f.kind AND t.pair_id = f.pair_id),
ordered AS (
  SELECT *, part <> 'prompt' AND role = 'assistant' AS trained,
    sum(length(txt)) OVER (PARTITION BY kind, pair_id, part ORDER BY turn NULLS LAST, role, txt ROWS UNBOUNDED PRECEDING) AS e
  FROM placed WHERE NOT (part = 'prompt' AND side = 1)),
spans AS (  -- repeats of a turn are one span
  SELECT kind, pair_id, part, turn, role, txt, trained, min(e - length(txt)) AS a, max(e) AS b, count(*) AS n FROM ordered GROUP BY ALL),
parts AS (
  SELECT kind, pair_id, part, string_agg(repeat(txt, n), '' ORDER BY turn NULLS LAST, role, txt) AS txt,
    coalesce(string_agg(CAST(a AS BIGINT)::VARCHAR || '-' || CAST(b AS BIGINT)::VARCHAR, ',' ORDER BY a) FILTER (trained), '') AS mask
  FROM spans GROUP BY kind, pair_id, part)
SELECT p.kind, p.pair_id, coalesce(a.txt, '') AS prompt, coalesce(b.txt, '') AS chosen, coalesce(c.txt, '') AS rejected,
  coalesce(b.mask, '') AS chosen_mask, coalesce(c.mask, '') AS rejected_mask
FROM pairs p
LEFT JOIN parts a ON a.kind = p.kind AND a.pair_id = p.pair_id AND a.part = 'prompt'
LEFT JOIN parts b ON b.kind = p.kind AND b.pair_id = p.pair_id AND b.part = 'chosen'
LEFT JOIN parts c ON c.kind = p.kind AND c.pair_id = p.pair_id AND c.part = 'rejected'
"""
}
