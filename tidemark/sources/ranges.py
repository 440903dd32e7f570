"""Records of delimited files by ranges of bytes: a file of any size is read by many tasks.

Whether a line begins inside quotes hangs on all lines before it. A first pass tells for each range how it would end
either way, which is two states and so composes like a prefix sum; the second pass cuts each range into records from
its true state. Records that lie across ranges come as pieces, which are put together again.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the reading rules.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_ROWS = 50

#: Bytes of a file's beginning that its delimiter is told from at most.
HEAD_BYTES = 16 << 20
#: White space at the ends of cells.
BLANKS = " \t\n\x0b\x0c\r\u00a0\u202f"
#: Records of a batch.
BATCH = 10_000

RANGES = "source_file string, block long, size long, n_bytes long, n_lines long, utf8 boolean, c1 boolean, cp1252 boolean, sniffed string, open_0 array<int>, open_1 array<int>"
RECORDS = "source_file string, encoding string, delimiter string, line_number long, fields array<string>, raw_line string, block long, piece int"
#: Pieces of a record: its end, a part without either end, its beginning.
TAIL, MIDDLE, HEAD = range(3)


def detect_encoding(data: bytes) -> str:
    """utf-8-sig with a mark, utf-8 if valid, cp1252 if a byte of 80-9F is there and decodes, else latin-1."""
    facts = facts_of(data)
    return named(data.startswith(b"\xef\xbb\xbf"), **facts)


def named(bom: bool, utf8: bool, c1: bool, cp1252: bool) -> str:
    return "utf-8-sig" if bom else "utf-8" if utf8 else "cp1252" if c1 and cp1252 else "latin-1"


def facts_of(data: bytes) -> dict[str, bool]:
    """What tells an encoding; for whole lines, facts of parts combine to those of the whole."""
    try:
        data.decode()
        utf8 = True
    except UnicodeDecodeError:
        utf8 = False
    return {"utf8": utf8, "c1": bool(re.search(rb"[\x80-\x9f]", data)), "cp1252": not re.search(rb"[\x81\x8d\x8f\x90\x9d]", data)}


@cache
def closers(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end outside quotes, if they begin outside and inside. A quote counts at the start of a field alone, and
    what follows the closing one belongs to the field."""
    d = re.escape(delimiter.encode())
    field = rb'(?:"(?:[^"]|"")*+"[^%(d)s]*+|[^"%(d)s][^%(d)s]*+|)' % {b"d": d}
    rest = rb"(?:%(d)s%(field)s)*+" % {b"d": d, b"field": field}
    return re.compile(field + rest + rb"\Z"), re.compile(rb'(?:[^"]|"")*+"[^%(d)s]*+' % {b"d": d} + rest + rb"\Z")


def opened(state: int, line: bytes, delimiter: str) -> int:
    """1 if a line that begins in a state (1: inside quotes) ends inside quotes."""
    for part in line.split(b"\r") if b"\r" in line else (line,):
        state = 0 if closers(delimiter)[state].match(part) else 1
    return state


def records(text: Iterable[str], delimiter: str) -> Iterator[tuple[int, list[str], str]]:
    """Line where a record starts, its fields, its raw text with the line's end, from lines; blank lines vanish."""
    csv.field_size_limit(2**31 - 1)
    taken: list[str] = []

    def kept():
        for line in text:
            taken.append(line)
            yield line

    at = 1
    for fields in csv.reader(kept(), delimiter=delimiter):
        if fields:
            yield at, fields, "".join(taken)
        at += len(taken)
        taken.clear()


def detect_delimiter(lines: list[str]) -> tuple[str, bool]:
    """The candidate under which most of the first rows have one width of two or more, then the widest, then the first;
    and whether there were rows enough under each."""
    best, chosen, enough = (0.0, 0), DELIMITERS[0], True
    for d in DELIMITERS:
        widths = [len(fields) for _, fields, _ in islice((r for r in records(lines, d) if any(f.strip() for f in r[1])), SNIFF_ROWS)]
        enough &= len(widths) == SNIFF_ROWS
        if widths:
            width, n = Counter(widths).most_common(1)[0]
            score = (n / len(widths), width) if width > 1 else (0.0, 0)
            if score > best:
                best, chosen = score, d
    return chosen, enough


def physical(values: Iterable[bytes], encoding: str) -> Iterator[str]:
    """Lines with their ends from what stands between line feeds; Spark's reader has taken a mark at the beginning away."""
    for value in values:
        line = value.decode("utf-8" if encoding == "utf-8-sig" else encoding) + "\n"
        if "\r" in line:
            yield from io.StringIO(line, newline="")
        else:
            yield line


class Sniffed:
    """The delimiter of a file, from as much of its beginning as it takes."""

    def __init__(self):
        self.head, self.size, self.next, self.found = [], 0, 64, None

    def feed(self, values: list[bytes], over: bool = False) -> None:
        if self.found:
            return
        self.head += values
        self.size += sum(map(len, values))
        if len(self.head) >= self.next or over or self.size > HEAD_BYTES:
            self.next = 2 * len(self.head)
            chosen, enough = detect_delimiter(list(physical(self.head, detect_encoding(b"\n".join(self.head)))))
            if enough or over or self.size > HEAD_BYTES:
                self.found, self.head = chosen, []


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes]]]:
    """What leads the value column of rows, and the values that share it, in order."""
    for batch in batches:
        block = batch.column(1).to_numpy(zero_copy_only=False)
        path = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (path[1:] != path[:-1])]).tolist() if batch.num_rows else []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            yield tuple(c[a].as_py() for c in batch.columns[:-1]), batch.column(batch.num_columns - 1)[a:b].to_pylist()


def _survey(delimiter: str | None):
    candidates = (delimiter,) if delimiter else DELIMITERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block, size), parts in groupby(_parts(batches), key=lambda x: x[0]):
            n, n_bytes, facts, sniffed = 0, 0, {"utf8": True, "c1": False, "cp1252": True}, Sniffed()
            ends = [[0, 1] for _ in candidates]
            for _, values in parts:
                data = b"\n".join(values)
                if block == 0 and not delimiter:
                    sniffed.feed(values)
                own = facts_of(data)
                facts = {"utf8": facts["utf8"] and own["utf8"], "c1": facts["c1"] or own["c1"], "cp1252": facts["cp1252"] and own["cp1252"]}
                returns = data.count(b"\r")
                lone = returns - data.count(b"\r\n") - data.endswith(b"\r") if returns else 0
                if b'"' in data:
                    quoted = [v for v in values if b'"' in v]
                    for d, state in zip(candidates, ends, strict=True):
                        for line in quoted:
                            state[0], state[1] = (same := opened(state[0], line, d)), (same if state[0] == state[1] else opened(state[1], line, d))
                n, n_bytes = n + len(values) + lone, n_bytes + len(data) + 1
            if block == 0 and not delimiter:
                sniffed.feed([], over=True)
            row = [path, block, size, n_bytes, n, *facts.values(), delimiter or sniffed.found, [s[0] for s in ends], [s[1] for s in ends]]
            kinds = [pa.string(), *[pa.int64()] * 4, *[pa.bool_()] * 3, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in RANGES.split(", ")])

    return run


def _batch(lead: tuple, rows: list[tuple]) -> pa.RecordBatch:
    """rows: line_number, fields, raw_line, piece."""
    path, block, encoding, delimiter = lead
    at, fields, raw, piece = zip(*rows, strict=True)
    fields = [f and [x.strip(BLANKS) for x in f] for f in fields]
    same = lambda x, kind=pa.string(): pa.array([x] * len(rows), kind)
    columns = [same(path), same(encoding), same(delimiter), pa.array(at, pa.int64()), pa.array(fields, pa.list_(pa.string())), pa.array(raw, pa.string()), same(block, pa.int64()), pa.array(piece, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RECORDS.split(", ")])


def _in_range(lines: Iterator[str], delimiter: str, inside: bool, cut: bool, at: int) -> Iterator[tuple]:
    """line_number, fields, raw_line, piece of a range that begins inside quotes and is cut inside them, or not."""
    if inside:
        end = []
        for line in lines:
            end.append(line)
            if not opened(1, line.rstrip("\r\n").encode(), delimiter):
                yield at, None, "".join(end), TAIL
                break
        else:
            yield at, None, "".join(end), MIDDLE
            return
        at += len(end)
    last = None
    for row in records(lines, delimiter):
        if last:
            yield at - 1 + last[0], last[1], last[2].rstrip("\r\n"), None
        last = row
    if last:
        yield (at - 1 + last[0], None, last[2], HEAD) if cut else (at - 1 + last[0], last[1], last[2].rstrip("\r\n"), None)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lead, parts in groupby(_parts(batches), key=lambda x: x[0]):
        path, block, encoding, delimiter, inside, cut, at = lead
        lines = physical(chain.from_iterable(values for _, values in parts), encoding)
        rows = _in_range(lines, delimiter, bool(inside), bool(cut), at)
        while some := list(islice(rows, BATCH)):
            yield _batch((path, block, encoding, delimiter), some)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, encoding, delimiter, at, raw, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = [(at - 1 + k, fields, text.rstrip("\r\n"), None) for k, fields, text in records(io.StringIO(raw, newline=""), delimiter)]
            yield _batch((path, block, encoding, delimiter), rows)


def survey(spark: SparkSession, path: str, encoding: str | None, delimiter: str | None) -> tuple[DataFrame, DataFrame]:
    """The lines of files (source_file, block, value), in order within each block; and a row per block: source_file, block,
    encoding, delimiter, inside and cut (whether it begins and ends inside quotes), at (its first line)."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(meta["file_path"].alias("source_file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))
    return lines, _settled(lines.mapInArrow(_survey(delimiter), RANGES), encoding, delimiter)


def _settled(found: DataFrame, encoding: str | None, delimiter: str | None) -> DataFrame:
    of_file = Window.partitionBy("source_file")
    order = of_file.orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = F.max("size").over(of_file) - F.sum("n_bytes").over(of_file) >= 2  # its three bytes, less a line feed at the end
    told = F.when(marked, "utf-8-sig").when(F.min("utf8").over(of_file), "utf-8").when(F.max("c1").over(of_file) & F.min("cp1252").over(of_file), "cp1252").otherwise("latin-1")
    rows = found.withColumns({"encoding": F.lit(encoding) if encoding else told, "delimiter": F.max("sniffed").over(of_file)})
    place = F.lit(1) if delimiter else F.array_position(F.array(*map(F.lit, DELIMITERS)), F.col("delimiter")).cast("int")
    rows = rows.withColumns({"from_0": F.element_at("open_0", place), "from_1": F.element_at("open_1", place)})
    # a block settles the state, leaves it, or turns it around: the last that settles it counts, and the turns since
    turns = F.when((F.col("from_0") == 1) & (F.col("from_1") == 0), 1).otherwise(0)
    settles = F.when(F.col("from_0") == F.col("from_1"), F.struct("block", F.col("from_0").alias("state"), F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("turns")))
    rows = rows.withColumns({"settles": settles, "turned": F.coalesce(F.sum(turns).over(earlier), F.lit(0)), "before": F.coalesce(F.sum("n_lines").over(earlier), F.lit(0))})
    last = F.last("settles", ignorenulls=True).over(earlier)
    rows = rows.withColumn("inside", F.pmod(F.coalesce(last["state"], F.lit(0)) + F.col("turned") - F.coalesce(last["turns"], F.lit(0)), F.lit(2)).cast("int"))
    cut = F.when(F.col("inside") == 1, F.col("from_1")).otherwise(F.col("from_0"))
    return rows.select("source_file", "block", "encoding", "delimiter", "inside", cut.alias("cut"), (F.col("before") + 1).alias("at"))


def cut_records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records and pieces of records (RECORDS) of lines; blocks (a stored table) has a row per range of bytes, so it is
    small beside them and goes to all tasks: a shuffle would take the lines out of order."""
    known = blocks.select(F.col("source_file").alias("_file"), F.col("block").alias("_block"), "encoding", "delimiter", "inside", "cut", "at")
    both = lines.join(F.broadcast(known), (F.col("source_file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return both.select("source_file", "block", "encoding", "delimiter", "inside", "cut", "at", "value").mapInArrow(_cut, RECORDS)


def joined_pieces(rows: DataFrame) -> DataFrame:
    """The records that pieces make together. A record's pieces are one cell in the end, whatever ranges they lie in."""
    order = Window.partitionBy("source_file").orderBy("block", "piece")
    pieces = rows.where("piece is not null").withColumn("_record", F.count_if(F.col("piece") == HEAD).over(order))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece", "raw_line"))), lambda x: x["raw_line"]), "")
    whole = pieces.groupBy("source_file", "_record").agg(F.min_by("encoding", "block").alias("encoding"), F.min_by("delimiter", "block").alias("delimiter"), F.min("line_number").alias("at"), raw.alias("raw"), F.min("block").alias("block"))
    return whole.select("source_file", "encoding", "delimiter", "at", "raw", "block").mapInArrow(_join, RECORDS)
