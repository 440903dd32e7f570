import datetime as dt

import pytest

from tidemark.sources import delimited as d


@pytest.fixture
def read(spark, tmp_path):
    def run(text, name="t.csv", **options):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        out = d.read_table(spark, str(path), **options)
        c = out.counts
        assert c["n_rows_in"] == c["kept"] + c["empty"] + c["rejected"]
        for s in out.stats.collect():
            assert s.n_parsed + s.n_failed + s.n_missing == c["kept"]
        return out

    return run


def values(out, column):
    return [r[column] for r in out.frame.orderBy("line_number").collect()]


def kinds(out):
    return {c.name: c.kind for c in out.columns}


def test_semicolons_win_over_more_commas(read):
    out = read('ref;plan;fee;left\nA1;"gold, large, old";10.5;no\nA2;"silver, small";8;yes\nA3;basic, x;7;no\n')
    assert out.delimiter == ";" and kinds(out) == {"ref": "text", "plan": "text", "fee": "numeric", "left": "text"}
    assert values(out, "plan") == ["gold, large, old", "silver, small", "basic, x"] and values(out, "fee") == [10.5, 8.0, 7.0]


def test_encodings(read):
    assert read("key,region\n1,Süd\n".encode("utf-8-sig")).encoding == "utf-8-sig"
    latin = read("full_name,n\nJosé Álvarez,1\n".encode("latin-1"))
    assert latin.encoding == "latin-1" and values(latin, "full_name") == ["José Álvarez"]
    quotes = read("note,n\n“too high”,1\n".encode("cp1252"))
    assert quotes.encoding == "cp1252" and values(quotes, "note") == ["“too high”"]


def test_dates(read):
    out = read("ref,signup_date\na,07.03.2023\nb,25.12.2022\n")
    assert values(out, "signup_date") == [dt.datetime(2023, 3, 7), dt.datetime(2022, 12, 25)]
    serial = read("p,start_date,tenure_days\na,44927,365\nb,45000,40000\n")
    assert values(serial, "start_date")[0] == dt.datetime(2023, 1, 1) and kinds(serial)["tenure_days"] == "numeric"
    assert any(w.code == "serial" and w.column == "start_date" for w in serial.warnings)
    text = "lead,created_on\na,03/04/2024\nb,05/06/2024\n"
    assert read(text).ambiguous == ("created_on",) and values(read(text), "created_on") == ["03/04/2024", "05/06/2024"]
    assert values(read(text, day_first=True), "created_on")[0] == dt.datetime(2024, 4, 3)
    assert values(read(text, day_first=False), "created_on")[0] == dt.datetime(2024, 3, 4)
    broken = read("id,paid_on\n" + "".join(f"{i},2024-01-{i:02d}\n" for i in range(1, 10)) + "10,2024-02-31\n")
    assert [r.n_failed for r in broken.stats.where("column = 'paid_on'").collect()] == [1]


def test_null_spellings(read):
    out = read("acct,tier,calls\n" + "".join(f"{i},{t},{c}\n" for i, (t, c) in enumerate([("None", "1"), ("gold", "N/A"), ("None", "3"), ("x", "-"), ("y", "5"), ("z", "unknown"), ("z", "")])))
    assert values(out, "tier")[0] == "None" and values(out, "calls") == [1.0, None, 3.0, None, 5.0, None, None]
    s = {r.column: r for r in out.stats.collect()}
    assert s["calls"].n_missing == 4 and s["calls"].null_tokens == {"N/A": 1, "-": 1, "unknown": 1} and s["tier"].n_missing == 0


def test_numbers(read):
    out = read('o,value,rate,life\n1,"$1,234.56",45%,₹1.2 lakh\n2,$98,5%,"₹45,000"\n3,"$12,000",0%,₹8.5 lakh\n4,$450.25,12.5%,₹1.2 lakh\n')
    assert values(out, "value") == [1234.56, 98.0, 12000.0, 450.25]
    assert values(out, "rate") == pytest.approx([0.45, 0.05, 0.0, 0.125]) and values(out, "life") == pytest.approx([120000, 45000, 850000, 120000])
    assert [(c.unit, c.currency) for c in out.columns] == [(None, None), (None, "$"), ("percent", None), (None, "₹")]
    comma = read("a;b\n1;1,5\n2;1.234,56\n3;7,25\n")
    assert values(comma, "b") == [1.5, 1234.56, 7.25] and any(w.code == "decimal_comma" for w in comma.warnings)
    assert values(read('a,b\n1,"1,234"\n2,"5,678"\n'), "b") == [1234.0, 5678.0]
    assert values(read("a;b\n1;1 234,5\n2;12 000\n3;5\n"), "b") == [1234.5, 12000.0, 5.0]
    bad = read("a,b\n" + "".join(f"x,{v}\n" for v in (1, 2, 3, "oops", 5, 6)))
    s = bad.stats.where("column = 'b'").first()
    assert (s.n_parsed, s.n_failed, s.sample_failures) == (5, 1, ["oops"]) and values(bad, "b")[3] is None
    partial = read("a,b\n" + "".join(f"x,{v}\n" for v in (1, 2, 3, 4, "5%")))
    assert values(partial, "b") == [1, 2, 3, 4, None] and any(w.code == "partial_percent" for w in partial.warnings)
    mixed = read("a,b\nx,$1\ny,€2\n")
    assert any(w.code == "mixed_currency" for w in mixed.warnings) and values(mixed, "b") == [1.0, 2.0]
    assert kinds(read("a,b\nx,1_000\ny,5d\n"))["b"] == "text"


def test_headers(read):
    out = read("id,amount,amount,amount_1\n1,100,250,3\n")
    assert out.frame.columns == ["source_file", "line_number", "id", "amount", "amount_2", "amount_1"] and out.renamed == {"amount_2": "amount"}
    pre = read("Report of partners\nmade on Monday\npartner,value,months\na,1,2\nb,3,4\n")
    assert pre.header_line == 3 and [r.raw_line for r in pre.preamble.orderBy("line_number").collect()] == ["Report of partners", "made on Monday"]
    long = read("".join(f"line {i}\n" for i in range(1500)) + "partner,value,months\n" + "a,1,2\n" * 1600)
    assert long.header_line == 1501 and long.preamble.count() == 1500 and any("1500 lines" in w.message for w in long.warnings)
    own = read("line_number,x\n7,a\n8,b\n")
    assert values(own, "line_number_1") == [7.0, 8.0] and own.renamed == {"line_number_1": "line_number"}
    ghost = read("site,visits,,\na,1,,\nb,2,,\n,,,\n\nc,3,,\n")
    assert ghost.frame.columns == ["source_file", "line_number", "site", "visits"] and ghost.counts == {"kept": 3, "empty": 1, "rejected": 0, "n_rows_in": 4}


def test_ragged_rows_and_lines(read):
    out = read("device,owner,months,back\nD1,a,1,no\nD2,b,2\nD3,c,3,no,extra\nD4,d,4,yes\n,,,\nlonely\nD6,f,6,no,\n")
    assert [(r.line_number, r.n_fields) for r in out.rejects.orderBy("line_number").collect()] == [(3, 3), (4, 5), (7, 1)]
    assert values(out, "device") == ["D1", "D4", "D6"] and out.counts["empty"] == 1
    quoted = read('id,note\n1,"two\nlines"\n2,x,y\n')
    assert [r.line_number for r in quoted.rejects.collect()] == [4] and values(quoted, "note") == ["two\nlines"]


def test_guards(spark, tmp_path, read):
    with pytest.raises(FileNotFoundError):
        d.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(d.FileTooLargeError):
        read("a,b\n1,2\n", max_bytes=7)
    assert read("a,b\n1,2\n", max_bytes=8).counts["kept"] == 1
    with pytest.raises(ValueError, match="no records"):
        read("\n\n")
    empty = read("a,b\n")
    assert empty.counts["kept"] == 0 and any(w.code == "no_data" for w in empty.warnings)


def test_many_files_are_one_table(spark, tmp_path):
    """Typing is decided over all files: the comma of one is the sign of all; one file has no header, one a preamble and
    another encoding; line numbers are each file's own."""
    parts = {"a.csv": b"ref;price\nA1;1,5\nA2;2\n", "b.csv": b"B1;3\nB2;4\nlonely\n", "c.csv": "Über alles\nref;price\nÇ1;5,25\n;\n".encode("latin-1")}
    for name, data in parts.items():
        (tmp_path / name).write_bytes(data)
    out = d.read_table(spark, str(tmp_path / "*.csv"))
    rows = {(r.source_file.split("/")[-1], r.line_number, r.ref, r.price) for r in out.frame.collect()}
    assert rows == {("a.csv", 2, "A1", 1.5), ("a.csv", 3, "A2", 2.0), ("b.csv", 1, "B1", 3.0), ("b.csv", 2, "B2", 4.0), ("c.csv", 3, "Ç1", 5.25)}
    assert out.counts == {"kept": 5, "empty": 1, "rejected": 1, "n_rows_in": 7} and [r.raw_line for r in out.preamble.collect()] == ["Über alles"]
    assert any(w.code == "mixed_files" for w in out.warnings) and (out.encoding, out.delimiter) == ("utf-8", ";")
    with pytest.raises(d.FileTooLargeError, match="a.csv|b.csv|c.csv"):
        d.read_table(spark, str(tmp_path / "*.csv"), max_bytes=20)


def test_delimiter_of_very_long_rows(read):
    """The first fifty rows decide, however long they are."""
    out = read("id;note\n" + "".join(f"{i};{'a, b, ' * 9000}\n" for i in range(60)))
    assert out.delimiter == ";" and out.counts["kept"] == 60
