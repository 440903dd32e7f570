import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import delimited as d
from tidemark.sources import ranges


def plain(data: bytes, encoding: str, delimiter: str):
    """line, fields, raw of a whole file, by the standard reader alone."""
    text = io.TextIOWrapper(io.BytesIO(data), encoding, newline="")
    return [(at, [x.strip(ranges.BLANKS) for x in fields], raw.rstrip("\r\n")) for at, fields, raw in ranges.records(text, delimiter)]


@pytest.fixture
def small_ranges(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in was.items():
        spark.conf.set(k, v)


def cut(spark, path, encoding=None, delimiter=None):
    lines, blocks = ranges.survey(spark, path, encoding, delimiter)
    blocks = d.stored(blocks, "test")
    rows = d.stored(ranges.cut_records(lines, blocks), "test")
    both = rows.where("piece is null").union(ranges.joined_pieces(rows))
    return blocks, [(r.line_number, r.fields, r.raw_line) for r in both.orderBy("line_number").collect()], {(r.encoding, r.delimiter) for r in rows.collect()}


def awkward(rng, n):
    """Lines with quotes that count and quotes that do not, line breaks of all kinds, blank lines and very long fields."""
    out = []
    for i in range(n):
        cells = [str(i)]
        for _ in range(3):
            kind = rng.randrange(10)
            cells.append({0: '"a; ""b"""', 1: f'"two\n{"long " * rng.randrange(60)}\n""lines"""', 2: '5" pipe', 3: "", 4: '""', 5: '"cr\rin"', 6: '"closed"after "it', 7: "é" * rng.randrange(5), 8: ' "not first"', 9: "plain, text"}[kind])
        out.append(";".join(cells) + rng.choice(["\n", "\n", "\r\n", "\r", "\n\n"]))
    return "".join(out)


@pytest.mark.parametrize("seed, size", [(1, 97), (2, 400), (3, 3000), (4, 1 << 20)])
def test_ranges_make_the_records_of_the_whole_file(spark, tmp_path, small_ranges, seed, size):
    rng = random.Random(seed)
    data = ("ref;a;b;c\n" + awkward(rng, 120) + rng.choice(["", "last;x;y;z"])).encode("utf-8")
    (tmp_path / "t.csv").write_bytes(data)
    small_ranges(size)
    blocks, got, told = cut(spark, str(tmp_path / "t.csv"))
    assert got == plain(data, "utf-8", ";") and told == {("utf-8", ";")}
    assert blocks.count() > len(data) / size / 3
    if size < 1000:
        assert blocks.where("inside = 1").count() > 0


def test_a_record_over_many_ranges_and_one_that_never_ends(spark, tmp_path, small_ranges):
    data = ("a,b\n1,x\n2,\"" + "line of a long note\n" * 300 + "\"\n3,y\n4,\"open\n" + "never closed\n" * 40).encode()
    (tmp_path / "t.csv").write_bytes(data)
    small_ranges(500)
    blocks, got, _ = cut(spark, str(tmp_path / "t.csv"))
    assert got == plain(data, "utf-8", ",") and [g[0] for g in got] == [1, 2, 3, 304, 305]
    assert blocks.where("inside = 1 and cut = 1").count() > 5


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "latin-1"])
@pytest.mark.parametrize("end", ["", "\n"])
def test_encodings_are_told_from_all_ranges(spark, tmp_path, small_ranges, encoding, end):
    """The only telling byte stands in the last range."""
    tail = {"utf-8": "é", "utf-8-sig": "plain", "cp1252": "“quoted”", "latin-1": "\x81é"}[encoding]
    data = ("id,note\n" + "".join(f"{i},text\n" for i in range(300)) + f"300,{tail}" + end).encode(encoding)
    (tmp_path / "t.csv").write_bytes(data)
    small_ranges(600)
    blocks, got, told = cut(spark, str(tmp_path / "t.csv"))
    assert told == {(encoding, ",")} and got == plain(data, encoding, ",") and blocks.count() > 3


def test_read_table_over_ranges_equals_one_range(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    body = "".join(f'{i};"note {i}{chr(10) if i % 3 else ""} with ""quotes""";{i % 50},{i % 7};{1 + i % 28:02d}.0{1 + i % 9}.2023{";extra" if i % 40 == 7 else ""}\n' for i in range(400))
    (tmp_path / "t.csv").write_text("made by hand\nref;note;price;made_on\n" + body + "".join(rng.choice([";;;\n", "\n"]) for _ in range(5)))
    results = []
    for size in (1 << 24, 700):
        small_ranges(size)
        out = d.read_table(spark, str(tmp_path / "t.csv"))
        results.append((sorted(map(tuple, out.frame.collect())), sorted(map(tuple, out.rejects.collect())), out.counts, out.columns, out.warnings, [tuple(r) for r in out.preamble.collect()]))
    assert results[0] == results[1] and results[0][2]["kept"] == 390 and results[0][2]["rejected"] == 10


def test_large_file_reads_above_the_guard(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(5000)))
    small_ranges(10_000)
    with pytest.raises(d.FileTooLargeError):
        d.read_table(spark, str(path), max_bytes=20_000)
    out = d.read_table(spark, str(path), max_bytes=1 << 30)
    r = out.frame.agg(F.sum("a").alias("s"), F.max("line_number").alias("last"), F.count(F.lit(1)).alias("n")).first()
    assert (r.s, r.last, r.n) == (sum(range(5000)), 10_000, 5000)


def test_states_agree_with_the_reader():
    """A line's end state by pattern is what the standard reader makes of it, from either state."""
    rng = random.Random(4)
    for _ in range(3000):
        line = "".join(rng.choice('",;a ') for _ in range(rng.randrange(12)))
        for d_ in (",", ";"):
            for state in (0, 1):
                rows = list(csv.reader([('"' if state else "") + line + "\n", "sentinel\n"], delimiter=d_))
                assert ranges.opened(state, line.encode(), d_) == int(rows[-1] != ["sentinel"]), (line, d_, state)
