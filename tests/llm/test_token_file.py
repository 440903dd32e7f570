import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import rans, token_file

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, rows):
    """Rows (doc_id, text) to what op3 promises, by the plainest path."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # equal ids keep their order
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in token_file.op3_token_file(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute(library, [(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark, library):
    rows = [
        (3, None, "x"), (1, "", "y"), (None, "no id", None), (2, "tie b", "z"), (2, "tie a", "z"), (7, "same", "z"), (7, "same", "z"),
        (9, " lead  double   triple \n \n  lines \t tab   nbsp \x1c fs \x1c  z\n", ""), (10, "<|endoftext|> !! it's we'll", ""), (11, "long " * 30000 + "x" * 5000, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").withColumnRenamed("part", "segment")
    got = [tuple(r) for r in token_file.encoded(spark, docs).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert got == brute(library, [r[:2] for r in rows])
    empty = token_file.encoded(spark, docs.limit(0))
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and empty.count() == 0


def test_added_tokens_are_the_librarys(library):
    """Texts that spell out an added token, at their ends and in a row, among texts that do not."""
    import pyarrow as pa

    texts = ["a <|endoftext|> b", None, "plain text", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "", "a <|endoftext |> b", "ends in <|endoftext|>", "plain again"]
    ids, n = token_file.tokens(PATH).encode(pa.array(texts))
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_large_vocabularies_raise(library, tmp_path):
    import json

    known = json.loads(library.to_str())
    known["model"]["vocab"] |= {f"x{i}": 50257 + i for i in range(20000)}
    (tmp_path / "large.json").write_text(json.dumps(known))
    with pytest.raises(ValueError, match="65,535"):
        token_file.Tokens(str(tmp_path / "large.json"))


def test_segments_and_ids(spark, library, tmp_path):
    rows = [(i, f"document {i} says {i * i} things, and more. " * (i % 7)) for i in range(300)]
    path = str(tmp_path / "tokens")
    token_file.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, segment_tokens=500)
    assert spark.read.parquet(path).count() > 10
    got = token_file.read_tokens(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == brute(library, rows)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [library.encode(t, add_special_tokens=False).ids + [0] for _, t in rows]


def test_blocks_hold_whole_documents_and_ranges_need_few_spans(spark, library, tmp_path, monkeypatch):
    rows = [(i, f"document {i} says {i * i} things, and more. " * (1 + i % 7)) for i in range(200)]
    path = str(tmp_path / "tokens")
    token_file.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, PATH, segment_tokens=4000, block_tokens=900)
    blocks = [b for r in spark.read.parquet(path).collect() for b in r.blocks]
    assert len(blocks) > 10 and all(len(token_file.unpacked(b.data)["marks"]) >= token_file.SPANS for b in blocks)
    whole = [i for _, t in rows for i in library.encode(t, add_special_tokens=False).ids + [0]]
    for a, b in ((0, 1), (0, len(whole)), (777, 4321), (len(whole) - 3, len(whole) + 9), (5000, 5000)):
        got = token_file.read_range(spark, path, a, b).orderBy("start").collect()
        assert [i for r in got for i in np.frombuffer(r.ids, "<u4").tolist()] == whole[a:b]


def test_hot_id_is_dealt_to_several_tasks(spark, library, tmp_path):
    """A third of the rows have one id, as many none: no task holds all of either."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"row {i} of a hot table") for i in range(3000)]
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    token_file.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_file.read_tokens(spark, path, ids=False)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [tuple(r) for r in got.orderBy("start").collect()] == brute(library, rows)
    assert spark.read.parquet(path).select("part").distinct().count() >= 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from(list("ab ' \n\t,.1é  \u0085\x1c!s漢\0")), max_size=40), min_size=1, max_size=4))
def test_pieces_equal_the_whole(texts):
    import pyarrow as pa

    want = [token_file.tokens(PATH).tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    ids, size = token_file.tokens(PATH).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for x in want for i in x] and size.tolist() == list(map(len, want))


def test_few_are_remembered():
    """Forgetting changes no id."""
    import pyarrow as pa

    asked = []

    def solve(texts):
        asked.extend(texts.to_pylist())
        return token_file.Ragged(np.array([ord(c) for t in texts.to_pylist() for c in t], "<u2"), np.array([len(t) for t in texts.to_pylist()]))

    known = token_file.Remembered(solve, limit=6)
    for texts in (["a", "bb", "c"], ["a", "dd", "e", "f"], ["a", "g", "long" * 99], ["a", "bb", "long" * 99, ""]):
        got = known(pa.array(texts))
        assert "".join(map(chr, got.take(np.arange(len(texts))))) == "".join(texts) and len(known.hits) <= 6 + len(texts)
    assert asked.count("a") == 1 and asked.count("long" * 99) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60000), min_size=1, max_size=900), st.integers(1, 40), st.integers(1, 7))
def test_round_trip(symbols, lanes, every):
    s = np.array(symbols, np.uint16)
    codec = rans.Codec(rans.table(np.bincount(s)))
    block = token_file.unpacked(token_file.packed(codec.encode(s, lanes, every)))
    assert (codec.decode(block) == s).all()
    for i in range(len(block["marks"])):
        assert (codec.decode(block, range(i, i + 1)) == s[i * every * lanes : (i + 1) * every * lanes]).all()


def test_tables():
    for counts in (np.array([5]), np.array([1, 0, 10**9]), np.ones(65536, int), np.r_[np.ones(60000, int), 10**12]):
        freq = rans.table(counts)
        assert freq.sum() == 1 << rans.BITS and ((freq > 0) == (counts > 0)).all()


def test_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_file.write_tokens(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), path, PATH)
    row = spark.read.parquet(path).first().asDict()
    block = row["blocks"][0].asDict()
    bad = bytearray(block["data"])
    bad[28] ^= 1  # the first span's checksum
    row["blocks"] = [block | {"data": bytes(bad)}]
    spark.createDataFrame([row], token_file.SCHEMA).write.parquet(path + "2")
    with pytest.raises(Exception, match="checksum"):
        token_file.read_tokens(spark, path + "2").collect()
