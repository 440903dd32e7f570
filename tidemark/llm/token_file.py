"""Token ids of documents as range-coded files.

A file is a Parquet table of segments in the order of part and segment. A segment has a frequency table, shared by its
blocks, and blocks of whole documents in ascending doc_id order. A block has interleaved lanes and checkpoints that cut
it into spans, each with a checksum: every segment, block and span can be decoded without what stands before it.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import LONGEST_KEY, shared_dir, sliced_by_bytes, table

SEGMENT_TOKENS = 1 << 21
BLOCK_TOKENS = 1 << 19
LANES = 1024
#: Spans that a block is cut into at least, and tokens of a span at most.
SPANS = 4
SPAN_TOKENS = 1 << 17
END = 0
#: Ids are two bytes wide.
MOST_IDS = 1 << 16
#: Words, and pieces of words, whose ids a Python worker keeps at most.
REMEMBERED = 200_000
#: Bytes of text that are encoded together.
ENCODED_BYTES = 2 << 20
#: Words whose ids are put together at a time, and pieces that the model gets in one list.
GATHERED, LISTED = 1 << 18, 200

_BLOCK = "struct<n: bigint, doc_ids: binary, lengths: binary, data: binary>"
SCHEMA = f"part int, segment int, frequencies binary, blocks array<{_BLOCK}>"


def _byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable in Latin-1, the
    others in order from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class Ragged:
    """Runs of ids in a pool: where each begins and how long it is."""

    def __init__(self, pool=None, n=None, start=None):
        self.pool = np.zeros(0, "<u2") if pool is None else pool
        self.n = np.zeros(0, np.int64) if n is None else n
        self.start = np.cumsum(self.n) - self.n if start is None else start

    def plus(self, other: Ragged) -> Ragged:
        return Ragged(np.r_[self.pool, other.pool], np.r_[self.n, other.n], np.r_[self.start, other.start + len(self.pool)])

    def take(self, which: np.ndarray) -> np.ndarray:
        """The ids of some runs, one after another."""
        parts = [self.pool[:0]]
        for i in range(0, len(which), GATHERED):
            n, start = self.n[which[i : i + GATHERED]], self.start[which[i : i + GATHERED]]
            parts.append(self.pool[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return np.concatenate(parts)


class Remembered:
    """Ids of texts that solve() has worked out, for the texts asked for most: once there are `limit` of them, the half
    with fewer hits goes. Texts above LONGEST_KEY bytes are not kept."""

    def __init__(self, solve, limit: int = REMEMBERED):
        self.solve, self.limit = solve, limit
        self.texts, self.runs, self.hits = pa.array([], pa.string()), Ragged(), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> Ragged:
        at = pc.fill_null(pc.index_in(texts, value_set=self.texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        self.hits += np.bincount(at[at >= 0], minlength=len(self.hits))
        if not len(new):
            return Ragged(self.runs.pool, self.runs.n[at], self.runs.start[at])
        asked = texts.take(pa.array(new))
        found = self.solve(asked)
        at[new] = len(self.runs.n) + np.arange(len(new))
        both = self.runs.plus(found)
        keep = np.flatnonzero(pc.binary_length(asked).to_numpy(zero_copy_only=False) <= LONGEST_KEY)
        self.runs = self.runs.plus(Ragged(found.take(keep), found.n[keep]))
        self.texts, self.hits = pa.concat_arrays([self.texts, asked.take(pa.array(keep))]), np.r_[self.hits, np.ones(len(keep), np.int64)]
        if len(self.hits) > self.limit:
            best = np.sort(np.argpartition(-self.hits, self.limit // 2)[: self.limit // 2])
            self.runs, self.texts, self.hits = Ragged(self.runs.take(best), self.runs.n[best]), self.texts.take(pa.array(best)), self.hits[best] // 2
        return Ragged(both.pool, both.n[at], both.start[at])


class Tokens:
    """Token ids of texts, by the library's model and a table of what was encoded of late.

    The tokenizer's pattern never joins a space that follows something else than white space to what stands before it,
    so a text cut before such spaces is encoded word by word, and a word by the pieces that its pattern makes. Arrow
    numbers the distinct words and pieces of a batch; the model sees each new piece once. Words with letters beyond
    Latin go through the library's whole encoder.
    """

    #: Texts that may have white space before a space (told by characters that are surely none), or a space in front.
    _odd = r"(?:^|[^\pL\pN\pP\pS\pM]) "
    _cut = re.compile(r"(?<=\S) ")
    #: Texts with a space in front and surely no white space at their end.
    _apart = r"(?s)^ .*[\pL\pN\pP\pS\pM]\z"

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) > MOST_IDS - 1:
            raise ValueError(f"{path} has ids above {MOST_IDS - 1:,}, which the file format does not hold")
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.characters = _byte_characters()
        self.apart = "\0" + self.characters[1:]
        self.words, self.pieces = Remembered(self.by_pieces), Remembered(self.by_model)

    def by_model(self, pieces: pa.Array) -> Ragged:
        """The model names ids for a list of pieces as a whole; how many characters they stand for tells where one ends."""
        pieces = pieces.to_pylist()
        if any("\0" in p for p in pieces):
            written = [p.encode().decode("latin-1").translate(self.characters) for p in pieces]
        else:
            written = "\0".join(pieces).encode().decode("latin-1").translate(self.apart).split("\0")
        lists = [written[i : i + LISTED] for i in range(0, len(written), LISTED)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in self.model.encode_batch_fast(lists, is_pretokenized=True, add_special_tokens=False)])
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(np.fromiter(map(len, written), np.int64, len(written)))) + 1
        return Ragged(ids.astype("<u2"), np.diff(ends, prepend=0))

    def by_library(self, texts: pa.Array) -> Ragged:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return Ragged(np.array([i for x in ids for i in x], "<u2"), np.fromiter(map(len, ids), np.int64, len(ids)))

    def by_pieces(self, texts: pa.Array) -> Ragged:
        far = pc.match_substring_regex(texts, r"[^\x{0}-\x{24F}]").to_numpy(zero_copy_only=False)
        spaced = pc.match_substring_regex(texts, self._apart).to_numpy(zero_copy_only=False)
        which = [np.flatnonzero(x) for x in (spaced & ~far, ~spaced & ~far, far)]
        of = [texts.take(pa.array(w)) for w in which]
        pieces, at = [], np.zeros(1, np.int64)
        if len(which[0]):  # no run of white space reaches from one to the next, so all are cut in one go
            pieces = self.pattern.findall("".join(of[0].to_pylist()))
            at = np.r_[0, np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.cumsum(pc.utf8_length(of[0]))) + 1]
        size = list(np.diff(at))
        for text in of[1].to_pylist():
            own = self.pattern.findall(text)
            pieces += own
            size.append(len(own))
        size, cut = np.array(size, np.int64), pa.array(pieces, pa.string())
        coded = cut.dictionary_encode()
        known, at = self.pieces(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        ends, to = np.r_[0, np.cumsum(known.n[at])], np.cumsum(size)
        near = Ragged(known.take(at), ends[to] - ends[to - size])
        both = near.plus(self.by_library(of[2])) if len(which[2]) else near
        back = np.empty(len(texts), np.int64)
        back[np.concatenate(which)] = np.arange(len(texts))
        return Ragged(both.pool, both.n[back], both.start[back])

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """Each text cut before spaces that follow something else than white space, without those spaces."""
        lists = pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(texts, self._odd).to_numpy(zero_copy_only=False))
        if len(odd):
            cut = pa.array([self._cut.split(t) for t in texts.take(pa.array(odd)).to_pylist()], lists.type)
            place = np.arange(len(texts))
            place[odd] = len(texts) + np.arange(len(odd))
            lists = pa.concat_arrays([lists, cut]).take(pa.array(place))
        return lists

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids (null: an empty text), each text's followed by the end id, and how many each has with it. Texts
        that spell out an added token of the vocabulary, which the library takes for that token, go through the library
        as a whole."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        spelt = np.zeros(len(texts), bool)
        for token in self.added:
            spelt |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not spelt.any():
            return self.by_words(texts)
        ids, n = self.by_words(pc.if_else(pa.array(spelt), "", texts))
        both, which = Ragged(ids, n), np.flatnonzero(spelt)
        whole = self.by_library(texts.take(pa.array(which)))
        ends = np.cumsum(whole.n)
        whole = Ragged(np.insert(whole.pool, ends, END).astype("<u2"), whole.n + 1)
        both.start[which], both.n[which] = len(ids) + whole.start, whole.n
        both.pool = np.r_[both.pool, whole.pool]
        return both.take(np.arange(len(texts))), both.n

    def by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() for texts without added tokens."""
        lists = self.lists(texts)
        flat, size = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = flat.dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        leads = flat.take(pa.array(first)).dictionary_encode()  # those have no space in front
        known = self.words(pa.concat_arrays([pc.binary_join_element_wise("", coded.dictionary, " "), leads.dictionary]))
        known = known.plus(Ragged(np.array([END], "<u2"), np.array([1])))
        word[first] = len(coded.dictionary) + leads.indices.to_numpy(zero_copy_only=False)
        word = np.insert(word, first + size, len(known.n) - 1)
        of_text = np.add.reduceat(known.n[word], first + np.arange(len(first))) if len(first) else np.zeros(0, np.int64)
        return known.take(word), of_text


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per Python worker, which serves many tasks."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def packed(block: dict) -> bytes:
    """Sizes, each span's step, place, checksum and lane states, words."""
    marks = b"".join(struct.pack("<III", t, p, crc) + s.astype("<i8").tobytes() for (t, p, s), crc in zip(block["marks"], block["crcs"], strict=True))
    return struct.pack("<IIIII", block["n"], block["lanes"], block["every"], len(block["marks"]), len(block["words"])) + marks + block["words"].astype("<u4").tobytes()


def unpacked(data: bytes) -> dict:
    n, lanes, every, n_marks, n_words = struct.unpack_from("<IIIII", data)
    at, marks, crcs = 20, [], []
    for _ in range(n_marks):
        t, p, crc = struct.unpack_from("<III", data, at)
        marks.append((t, p, np.frombuffer(data, "<i8", lanes, at + 12)))
        crcs.append(crc)
        at += 12 + 8 * lanes
    return {"n": n, "lanes": lanes, "every": every, "marks": marks, "crcs": crcs, "words": np.frombuffer(data, "<u4", n_words, at)}


def _cuts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents that end with the one that brings them to so many tokens."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        end = min(len(lengths), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1)
        yield at, end
        at = end


def segment(part: int, number: int, ids: pa.Array, lengths: np.ndarray, symbols: np.ndarray, block_tokens: int) -> pa.RecordBatch:
    """One row of the file from documents' ids (which may be null), their lengths and all their tokens."""
    freq = rans.table(np.bincount(symbols))
    codec = rans.Codec(freq)
    ends, blocks = np.cumsum(lengths), []
    known = np.asarray(ids.is_valid()).astype(np.uint8)
    numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8")
    for a, b in _cuts(lengths, block_tokens):
        own = symbols[ends[a] - lengths[a] : ends[b - 1]]
        lanes = max(1, min(LANES, len(own) // 64))
        steps = -(-len(own) // lanes)
        every = -(-steps // max(SPANS, -(-len(own) // SPAN_TOKENS)))
        squeezed = lambda *x: zlib.compress(b"".join(y.tobytes() for y in x), 1)
        blocks.append({"n": len(own), "doc_ids": squeezed(known[a:b], numbers[a:b]), "lengths": squeezed(lengths[a:b].astype("<u4")), "data": packed(codec.encode(own, lanes, every))})
    kind = pa.list_(pa.struct([("n", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())]))
    row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([zlib.compress(freq.astype("<u4").tobytes(), 1)], pa.binary()), pa.array([blocks], kind)]
    return pa.RecordBatch.from_arrays(row, ["part", "segment", "frequencies", "blocks"])


def _write(path: str, segment_tokens: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = tokens(path), TaskContext.get().partitionId(), 0
        ids, lengths, symbols = pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, "<u2")
        for batch in sliced_by_bytes(batches, 1, ENCODED_BYTES):
            more, of_text = encoder.encode(batch.column(1))
            ids, lengths, symbols = pa.concat_arrays([ids, batch.column(0)]), np.r_[lengths, of_text], np.r_[symbols, more]
            for a, b in list(_cuts(lengths, segment_tokens)):
                n = int(lengths[: b - a].sum())
                if n < segment_tokens:
                    break
                yield segment(part, number, ids[: b - a], lengths[: b - a], symbols[:n], block_tokens)
                ids, lengths, symbols, number = ids[b - a :], lengths[b - a :], symbols[n:], number + 1
        if len(lengths):
            yield segment(part, number, ids, lengths, symbols, block_tokens)

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str, segment_tokens: int = SEGMENT_TOKENS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text (null: empty) of documents (doc_id, text; other columns are ignored) with the tokenizers
    library, end each with id 0, and write the segments to path in ascending doc_id order, nulls first; rows that share
    a doc_id, or have none, follow each other in the order of the table and may be dealt to several tasks. An empty
    table writes no segment. Vocabularies above 65,536 ids raise."""
    rows = documents.select("doc_id", "text").withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    rows.mapInArrow(_write(tokenizer, segment_tokens, block_tokens), SCHEMA).write.parquet(path)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of, codec = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, frequencies, place, doc_ids, lengths, data = (c[i].as_py() for c in batch.columns)
                if frequencies != table_of:
                    table_of, codec = frequencies, rans.Codec(np.frombuffer(zlib.decompress(frequencies), "<u4"))
                ids = codec.decode(unpacked(data)).astype("<u4", copy=False)
                lengths = np.frombuffer(zlib.decompress(lengths), "<u4").astype(np.int64)
                stored, n = zlib.decompress(doc_ids), len(lengths)
                known, numbers = np.frombuffer(stored, np.uint8, n).astype(bool), np.frombuffer(stored, "<i8", n, n)
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                at = [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(view[a:b]) for a, b in zip(at, at[1:], strict=False)]
                whole = lambda x, kind=pa.int32(): pa.array(np.full(n, x), kind)
                columns = [pa.array(numbers, pa.int64(), mask=~known), whole(part), whole(number), whole(place), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "segment", "block", "offset", "n_tokens", "ids_crc32"]
                if not with_ids:
                    yield pa.RecordBatch.from_arrays(columns, names)
                    continue
                for k in range(0, n, 1000):
                    texts = pa.array([view[a:b].tobytes() for a, b in zip(at[k : k + 1000], at[k + 1 : k + 1001], strict=False)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(c[k : k + 1000] for c in columns), texts], [*names, "ids"])

    return run


def _starts(file: DataFrame) -> DataFrame:
    """part, segment, block, block_start: ids of all blocks before each."""
    sizes = file.select("part", "segment", F.posexplode("blocks.n").alias("block", "n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("part_start"))
    within = sizes.withColumn("within", before(Window.partitionBy("part").orderBy("segment", "block")))
    return within.join(parts, "part").select("part", "segment", "block", "n", (F.col("part_start") + F.col("within")).alias("block_start"))


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The documents of a token file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if
    asked for, ids (little-endian unsigned 32-bit). A row per block is decoded, each span held against its checksum."""
    file = spark.read.schema(SCHEMA).parquet(path)
    blocks = file.select("part", "segment", "frequencies", F.posexplode("blocks").alias("block", "b")).select("part", "segment", "frequencies", "block", "b.doc_ids", "b.lengths", "b.data")
    rows = blocks.mapInArrow(_read(ids), "doc_id long, part int, segment int, block int, offset long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    out = rows.join(_starts(file), ["part", "segment", "block"])
    return out.select("doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def _spans(start: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                frequencies, data, at = (c[i].as_py() for c in batch.columns)
                block = unpacked(data)
                size = block["every"] * block["lanes"]
                a, b = max(0, start - at), min(block["n"], end - at)
                first, last = a // size, -(-b // size)
                ids = rans.Codec(np.frombuffer(zlib.decompress(frequencies), "<u4")).decode(block, range(first, last))
                yield pa.RecordBatch.from_arrays([pa.array([at + a], pa.int64()), pa.array([ids[a - first * size : b - first * size].astype("<u4").tobytes()], pa.binary())], ["start", "ids"])

    return run


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """start, ids (little-endian unsigned 32-bit): the ids from place start to end (exclusive) of the whole file, a row
    per block that has some. Only the spans that hold them are decoded."""
    file = spark.read.schema(SCHEMA).parquet(path)
    wanted = _starts(file).where((F.col("block_start") < end) & (F.col("block_start") + F.col("n") > start)).select("part", "segment", "block", "block_start")
    blocks = file.select("part", "segment", "frequencies", F.posexplode("blocks").alias("block", "b")).join(wanted, ["part", "segment", "block"])
    return blocks.select("frequencies", "b.data", "block_start").mapInArrow(_spans(start, end), "start long, ids binary")


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Write documents as a token file in the shared folder and read it back, without the ids themselves."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/tidemark-tokens-{uuid.uuid4().hex}"
    write_tokens(documents, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, ids=False)
