"""Delimited text with full accounting: every record is kept, dropped as empty or rejected with a reason, and every cell
is parsed, missing or a counted failure.

A table is one file or many of one shape, of any size: tasks cut ranges of bytes into records (see ranges), which are
stored once; header, triage, typing and statistics are Spark expressions over the record table. What holds for a whole
column (decimal sign, date order, percent) is decided from one aggregate over all its cells in all files.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import stored
from . import ranges

# Fixed values of the reading rules.
MAX_BYTES = 256 * 1024 * 1024
ACCEPT = 0.8
SAMPLES = 5
DATE_NAMES = re.compile(r"(^|_)(date|dates|dt|datetime|timestamp|day|on|at|since|until)($|_)", re.IGNORECASE)

#: Columns of every frame; a header of such a name is renamed.
RESERVED = ("source_file", "line_number")
#: Evidence of a column without cells.
NOTHING = dict.fromkeys(("cand", "pct", "serial", "dates", "apart", "both", "comma", "multiplied", "tokens", "filled", "dot_all", "dot_plain", "com_all", "com_plain"), 0) | {"first": None, "second": None, "verdict": None, "signs": []}
#: Files whose header lines may be broadcast; of more, they are joined by a shuffle.
BROADCAST_FILES = 100_000


class FileTooLargeError(ValueError):
    """The file is larger than max_bytes; nothing of it was read."""


@dataclass(frozen=True)
class Warned:
    code: str
    column: str | None
    message: str


@dataclass(frozen=True)
class Column_:
    name: str
    source_name: str
    kind: str
    unit: str | None = None
    currency: str | None = None
    decimal: str | None = None
    date_format: str | None = None
    ambiguous: bool = False


@dataclass(frozen=True)
class ParseResult:
    """frame: typed rows with source_file and line_number; rejects: those, n_fields, n_expected, raw_line, reason; stats: a
    row per column (n_parsed, n_failed, n_missing, null_tokens, sample_failures); counts: n_rows_in, kept, empty,
    rejected; encoding, delimiter, header_line: of the first file by name; preamble: source_file, line_number, raw_line
    of what stands above the headers."""

    frame: DataFrame
    rejects: DataFrame
    stats: DataFrame
    columns: tuple[Column_, ...]
    counts: dict[str, int]
    encoding: str
    delimiter: str
    header_line: int
    preamble: DataFrame
    renamed: dict[str, str]
    warnings: tuple[Warned, ...]

    @property
    def ambiguous(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.ambiguous)


def header_names(fields: list[str]) -> tuple[list[str], dict[str, str], list[bool]]:
    """Unique names: blanks become column_<position>, repeats get the next free number."""
    names, renamed, unnamed = [], {}, []
    taken = {f.strip() for f in fields if f.strip()} | set(RESERVED)
    for i, f in enumerate(fields):
        name = f.strip()
        unnamed.append(not name)
        if not name:
            name = f"column_{i + 1}"
        if name in names or name in RESERVED:
            k = 1
            while f"{name}_{k}" in names or f"{name}_{k}" in taken:
                k += 1
            renamed[f"{name}_{k}"] = name
            name = f"{name}_{k}"
        names.append(name)
    return names, renamed, unnamed


def _header(rows: DataFrame) -> tuple[str, int, list[str], DataFrame]:
    """First file, line and fields of its header (the first record of the most common width with two names or more and
    at most half numbers), and source_file, header_line: where every file has those fields again. A file whose first
    record of that width is another has no header (line 0), and all its records are data."""
    width = rows.groupBy(F.size("fields").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source_file", "line_number")).alias("at")).orderBy(F.desc("n"), "at").first()
    if width is None:
        raise ValueError("there are no records in this file")
    named = F.size(F.filter("fields", lambda x: x != ""))
    numbers = F.size(F.filter("fields", lambda x: x.rlike(r"^[+-]?[0-9][0-9.,]*%?$")))
    first = rows.agg(F.min("source_file")).first()[0]
    own = rows.where(F.col("source_file") == first)
    fit = own.where((F.size("fields") == width.w) & (named >= 2) & (numbers * 2 <= F.size("fields")))
    found = fit.orderBy("line_number").first() or own.orderBy("line_number").first()
    top = rows.groupBy("source_file").agg(F.min_by(F.struct("line_number", "fields"), F.when(F.size("fields") == len(found.fields), F.col("line_number"))).alias("top"))
    again = F.when(F.col("source_file") == first, found.line_number).when(F.col("top.fields") == F.array(*map(F.lit, found.fields)), F.col("top.line_number")).otherwise(0)
    return first, found.line_number, found.fields, top.select("source_file", again.cast("long").alias("header_line"))


def evidence(cells: DataFrame) -> dict[int, dict]:
    """What decides columns' kinds, from all cells (i, v; source_file and line_number), by column. Cells are counted by
    column and value first, so that values that come again are looked at once, all by the same small set of expressions,
    whatever the number of columns. Cells that are plain numbers or have no digit skip what they cannot be."""
    v = F.col("v")
    yes = lambda x: F.coalesce(x, F.lit(False))
    rows = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("token", V.is_null_token(v)).withColumn("cand", (v != "") & ~F.col("token"))
    digit = F.col("cand") & v.rlike("[0-9]")
    rows = rows.withColumns({"plain": F.col("cand") & v.rlike(V.PLAIN), "sign": F.when(F.col("cand"), V.currency_bit(v))})
    rows = rows.withColumn("open", digit & ~F.col("plain"))
    rows = rows.withColumns({"date": F.col("open") & V.is_date(v), "number": F.col("open") & V.is_amount(v)})
    turnable, first, second = V.day_and_month(v)
    rows = rows.withColumn("apart", F.col("date") & turnable)
    pct, sound = F.col("cand") & v.endswith("%"), lambda sign: F.col("plain") | F.when(F.col("number"), V.parse_number(v, sign).isNotNull())
    both = F.col("open") & v.contains(",") & v.contains(".")
    rows = rows.withColumns({
        "pct": pct, "serial": F.col("plain") & V.is_serial(v), "first": F.when(F.col("apart"), first), "second": F.when(F.col("apart"), second), "dot": yes(sound(".")), "com": yes(sound(",")),
        "comma": F.col("open") & v.rlike(r",[0-9]{1,2}$"), "both": both, "multiplied": F.when(F.col("sign") > 0, V.has_multiplier(v)),
    })
    n = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0))
    c = F.col
    found = rows.groupBy("i").agg(
        n(c("cand")).alias("cand"), n(c("pct")).alias("pct"), n(c("serial")).alias("serial"), n(c("date")).alias("dates"), n(c("apart")).alias("apart"), F.max("first").alias("first"), F.max("second").alias("second"),
        n(c("both")).alias("both"), n(c("comma")).alias("comma"), n(c("multiplied")).alias("multiplied"), F.bit_or("sign").alias("signs"), n(c("token")).alias("tokens"), n(v != "").alias("filled"),
        n(c("dot")).alias("dot_all"), n(c("dot") & ~c("pct")).alias("dot_plain"), n(c("com")).alias("com_all"), n(c("com") & ~c("pct")).alias("com_plain"),
    )
    out = {r["i"]: r.asDict() | {"verdict": None, "signs": V.currencies_of(r["signs"] or 0)} for r in found.collect()}
    if any(e["both"] for e in out.values()):  # the first cell that has both signs tells which one is the decimal
        last = F.when(F.instr(F.reverse("v"), ",") < F.instr(F.reverse("v"), "."), ",").otherwise(".")
        told = cells.where(V.is_candidate(v) & v.rlike("[0-9]") & v.contains(",") & v.contains(".")).groupBy("i").agg(F.min(F.struct("source_file", "line_number", last.alias("sign"))).alias("at"))
        for r in told.collect():
            out[r["i"]]["verdict"] = r["at"]["sign"]
    return out


def _decide(name: str, source: str, e: dict, day_first: bool | None) -> tuple[Column_, list[Warned]]:
    cand = e["cand"]
    said: list[Warned] = []
    if cand and DATE_NAMES.search(name) and e["serial"] == cand:
        return Column_(name, source, "datetime", date_format="serial"), [Warned("serial", name, f"{name}: numbers read as spreadsheet serial dates")]
    if cand and e["dates"] >= (ACCEPT if DATE_NAMES.search(name) else 1.0) * cand:
        order = True if (e["first"] or 0) > 12 else False if (e["second"] or 0) > 12 else day_first
        if e["apart"] and order is None:
            return Column_(name, source, "text", ambiguous=True), [Warned("ambiguous_date", name, f"{name}: day or month first cannot be told; kept as text")]
        return Column_(name, source, "datetime", date_format="iso" if not e["apart"] else "day_first" if order else "month_first"), said
    decimal = e["verdict"] or ("," if e["comma"] else ".")
    percent = cand > 0 and e["pct"] == cand
    if cand and e[f"{'com' if decimal == ',' else 'dot'}_{'all' if percent else 'plain'}"] >= ACCEPT * cand:
        if decimal == ",":
            said.append(Warned("decimal_comma", name, f"{name}: the comma is the decimal sign"))
        if len(e["signs"]) > 1:
            said.append(Warned("mixed_currency", name, f"{name}: several currencies, {' '.join(sorted(e['signs']))}"))
        if e["multiplied"]:
            said.append(Warned("multiplier", name, f"{name}: lakh and crore were multiplied out"))
        if e["pct"] and not percent:
            said.append(Warned("partial_percent", name, f"{name}: some values carry %, they count as failures"))
        return Column_(name, source, "numeric", "percent" if percent else None, e["signs"][0] if len(e["signs"]) == 1 else None, decimal), said
    if e["tokens"]:
        said.append(Warned("null_like_text", name, f"{name}: {e['tokens']} values look like null but stay text"))
    return Column_(name, source, "text"), said


def typed(v: Column, c: Column_) -> Column:
    """The cell under its column's verdict; null where it is missing or fails."""
    if c.kind == "datetime":
        return F.when(V.is_candidate(v), V.parse_serial(v) if c.date_format == "serial" else V.parse_date(v, c.date_format == "day_first"))
    if c.kind == "numeric":
        ok = V.is_candidate(v) & (F.lit(True) if c.unit == "percent" else ~v.endswith("%"))
        return F.when(ok, V.parse_number(v, c.decimal or "."))
    return F.nullif(v, F.lit(""))


def read_table(spark: SparkSession, path: str, *, encoding: str | None = None, delimiter: str | None = None, day_first: bool | None = None, max_bytes: int = MAX_BYTES) -> ParseResult:
    """Read one delimited file, or all files that path matches as one table: the header of the first by name names the
    columns, and the others may repeat it. Bad data never raises; a missing or too large file and a table without
    records do."""
    try:
        files = spark.read.format("binaryFile").load(path)
        large = files.select("path", "length").where(F.col("length") > max_bytes).orderBy("path").first()
        n_files = files.select("path").count()
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if not n_files:
        raise FileNotFoundError(path)
    if large:
        raise FileTooLargeError(f"{large.path} has {large.length} bytes; max_bytes is {max_bytes}")
    lines, blocks = ranges.survey(spark, path, encoding, delimiter)
    rows = stored(ranges.cut_records(lines, stored(blocks, "ranges")), "records")
    if rows.where("piece is not null").limit(1).count():
        rows = rows.where("piece is null").union(stored(ranges.joined_pieces(rows), "pieces"))

    first, line, fields, heads = _header(rows)
    seen = rows.where((F.col("source_file") == first) & (F.col("line_number") == line)).select("encoding", "delimiter", "raw_line").first()
    written = next(ranges.records(io.StringIO(seen.raw_line, newline=""), seen.delimiter))[1]
    names, renamed, unnamed = header_names(fields)
    n = len(names)
    warnings = [Warned("renamed", new, f"column {old} is now {new}, as there is one of that name") for new, old in renamed.items()]
    if n_files > 1 and rows.agg(F.count_distinct("encoding", "delimiter")).first()[0] > 1:
        warnings.append(Warned("mixed_files", None, f"the {n_files} files differ in encoding or delimiter"))
    rows = rows.select(*RESERVED, "fields", "raw_line").join(F.broadcast(heads) if n_files <= BROADCAST_FILES else heads, "source_file")
    preamble = rows.where(F.col("line_number") < F.col("header_line")).select(*RESERVED, "raw_line")
    if above := preamble.count():
        warnings.append(Warned("header", None, f"the header is on line {line}, below {above} lines of preamble" if n_files == 1 else f"{above} lines of preamble above the headers"))

    tail_blank = ~F.exists(F.slice(F.col("v"), n + 1, F.greatest(F.size("v") - n, F.lit(0))), lambda x: x != "")
    status = F.when(~F.exists("v", lambda x: x != ""), "empty").when(F.size("v") == n, "kept").when((F.size("v") > n) & tail_blank, "trimmed").otherwise("rejected")
    body = rows.where(F.col("line_number") > F.col("header_line")).withColumnRenamed("fields", "v").withColumn("status", status)
    kept = body.where(F.col("status").isin("kept", "trimmed"))
    flat = kept.select(*RESERVED, *[F.col("v")[i].alias(f"c{i}") for i in range(n)])

    found = evidence(kept.select(*RESERVED, F.posexplode(F.slice("v", 1, n)).alias("i", "v"))) if n else {}
    counted = {r.status: r.n for r in body.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {"kept": counted.get("kept", 0) + counted.get("trimmed", 0), "empty": counted.get("empty", 0), "rejected": counted.get("rejected", 0)}
    counts["n_rows_in"] = sum(counts.values())
    if counts["empty"]:
        warnings.append(Warned("empty_rows", None, f"{counts['empty']} empty rows were dropped"))
    if counted.get("trimmed"):
        warnings.append(Warned("trimmed", None, f"{counted['trimmed']} rows had empty fields at the end"))
    if not counts["kept"]:
        warnings.append(Warned("no_data", None, "there are no data rows below the header"))

    columns, places = [], []
    for i, name in enumerate(names):
        if unnamed[i] and not found.get(i, {}).get("filled"):
            warnings.append(Warned("ghost_column", name, f"{name}: unnamed and empty, dropped"))
            continue
        column, said = _decide(name, written[i], found.get(i, NOTHING), day_first)
        columns.append(column)
        places.append(i)
        warnings += said

    frame = flat.select(*RESERVED, *[typed(F.col(f"c{i}"), c).alias(c.name) for i, c in zip(places, columns, strict=True)])
    rejects = body.where(F.col("status") == "rejected").select(
        *RESERVED, F.size("v").alias("n_fields"), F.lit(n).alias("n_expected"), "raw_line", F.when(F.size("v") < n, "too few fields").otherwise("too many fields").alias("reason")
    )
    return ParseResult(frame, rejects, _stats(flat, columns, places), tuple(columns), counts, seen.encoding, seen.delimiter, line, preamble, renamed, tuple(warnings))


def _stats(flat: DataFrame, columns: list[Column_], places: list[int]) -> DataFrame:
    """column, n_parsed, n_failed, n_missing, null_tokens (map), sample_failures (first ones by line)."""
    each = []
    for i, c in zip(places, columns, strict=True):
        v = F.col(f"c{i}")
        missing = (v == "") if c.kind == "text" else ~V.is_candidate(v)
        state = F.when(missing, "missing").when(typed(v, c).isNull(), "failed").otherwise("parsed")
        each.append(F.struct(F.lit(c.name).alias("column"), v.alias("raw"), state.alias("state"), F.lit(c.kind != "text").alias("typed")))
    if not each:
        return flat.sparkSession.createDataFrame([], "column string, n_parsed long, n_failed long, n_missing long, null_tokens map<string,long>, sample_failures array<string>")
    cells = flat.select(*RESERVED, F.explode(F.array(*each)).alias("x")).select(*RESERVED, "x.*")
    n = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    base = cells.groupBy("column").agg(n("parsed"), n("failed"), n("missing"))
    tokens = cells.where(F.col("typed") & (F.col("state") == "missing") & (F.col("raw") != "")).groupBy("column", "raw").agg(F.count(F.lit(1)).alias("n"))
    tokens = tokens.groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("raw", "n")))).alias("null_tokens"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(*RESERVED))
    first = cells.where(F.col("state") == "failed").withColumn("place", place).where(F.col("place") <= SAMPLES)
    samples = first.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw"))), lambda x: x["raw"]).alias("sample_failures"))
    return base.join(tokens, "column", "left").join(samples, "column", "left")
