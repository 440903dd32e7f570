"""Near-duplicate documents by SimHash fingerprints: a segment-popcount embedding, met in a grid, verified exactly.

A fingerprint's 64 bits are cut into segments, and the bits set in each segment are its coordinates. Two fingerprints
that differ in r bits have coordinates at a Manhattan distance of r at most, so a range join of the coordinates loses no
pair. Coordinates are kept in unary, each segment's bits sorted, which makes their Manhattan distance the bits that
differ. Segments of two bits keep 45 of 64 bits in the sense of chance meetings; wider ones keep less (segments of eight: 19).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_skewed, sliced_by_bytes, small, stored, table
from .components import components

WIDTH, SEED = 4, 42
#: Bits in which linked fingerprints may differ.
RADIUS = 4
SEGMENTS = 32
#: Chance that two random segments of two bits have as many bits set.
ALIKE = 0.375
#: Rows of a cell that one task compares at a time; larger cells are cut into tiles of two such blocks.
TILE = 512
#: Cells of so few rows are compared over a whole batch at once.
FEW = 4
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 14

_EVEN = 0x5555555555555555


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of a text's four-word shingles, repeats included; of all its words if they are fewer; none without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    data, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - WIDTH + 1)
    begins = np.r_[0, ends[: n - 1] + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(begins, ends[len(words) - n :].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero without any."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        votes += np.unpackbits(hashes[i : i + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced_by_bytes(batches, 1):
        found = np.array([fingerprint(shingle_hashes(t.as_py())) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (its bits as a long): a row per row of documents."""
    return documents.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fingerprint long")


def embedded(f):
    """The bits set in each segment, in unary, of an array of fingerprints."""
    even = np.uint64(_EVEN)
    low, high = f & even, f >> np.uint64(1) & even
    return (low | high) | (low & high) << np.uint64(1)


def groups_for(n: int) -> int:
    """Groups of segments that make the grid of n fingerprints: the number with the fewest rows and chance meetings in
    its cells. The result is the same with any."""
    kept = lambda g: SEGMENTS * (g - RADIUS) / g
    return min(range(RADIUS + 1, 13), key=lambda g: comb(g, RADIUS) * (n + n * n / 2 * ALIKE ** kept(g)))


@cache
def grid(groups: int) -> tuple[list[int], list[list[int]]]:
    """Of each family of cells, the bits whose coordinates name the cell, and the groups of bits that must differ for a
    pair to belong to this family before all others.

    Of `groups` groups of segments, two points at a distance of RADIUS at most agree in all but RADIUS; the families
    are the choices of groups to agree in. A pair belongs to the first groups in which it agrees.
    """
    own = [sum(3 << 2 * int(s) for s in part) for part in np.array_split(np.arange(SEGMENTS), groups)]
    families = list(combinations(range(groups), groups - RADIUS))
    return [sum(own[g] for g in family) for family in families], [[own[g] for g in range(max(family)) if g not in family] for family in families]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(classes: DataFrame, groups: int) -> DataFrame:
    """family, cell, fingerprint, rep: a row for each cell of the grid that a fingerprint is in."""
    f = F.col("fingerprint")
    low, high = f.bitwiseAND(_EVEN), F.shiftrightunsigned(f, 1).bitwiseAND(_EVEN)
    unary = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in grid(groups)[0]])
    rows = classes.select("fingerprint", "rep", unary.alias("unary"), F.posexplode(masks).alias("family", "mask"))
    return rows.select("family", F.col("unary").bitwiseAND(F.col("mask")).alias("cell"), "fingerprint", "rep")


def tiled(rows: DataFrame) -> DataFrame:
    """Add block, first, second: cells of more than TILE rows are dealt into blocks, and a row goes to each tile of its
    block with another or itself; smaller cells are one tile."""
    large = stored(rows.groupBy(F.struct("family", "cell").alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")))
    keyed = rows.withColumn("key", F.struct("family", "cell"))
    if large.limit(1).count():
        keyed = join_skewed(keyed, large, "key", "left")
    else:
        keyed = keyed.withColumn("blocks", F.lit(None).cast("int"))
    block = F.pmod(F.xxhash64("fingerprint"), F.coalesce("blocks", F.lit(1))).cast("int")
    keyed = keyed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return keyed.select("family", "cell", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "fingerprint", "rep")


def _forest(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what a symmetric matrix joins, without circles."""
    left = near.any(axis=1)
    while left.any():
        front = np.array([left.argmax()])
        left[front] = False
        while len(front):
            met = near[front] & left
            new = np.flatnonzero(met.any(axis=0))
            yield front[met[:, new].argmax(axis=0)], new
            left[new] = False
            front = new


def _linked(groups: int):
    """Pairs of a sorted table of tiles that are linked, or enough of them to join all that are: in tiles of more than
    FEW rows a spanning forest of the pairs that belong there."""
    masks, before = grid(groups)
    most = max(1, max(map(len, before)))
    differ = np.full((len(masks), most), 0, np.uint64)
    for k, own in enumerate(before):
        differ[k, : len(own)] = own

    def close(f, u, block, family, same, a, b):
        """Whether pairs of rows are linked, and belong here."""
        x = u[a] ^ u[b]
        on = (np.bitwise_count(x) <= RADIUS) & (same[a] | (block[a] != block[b]))
        at = np.flatnonzero(on)
        a, x = a[at], x[at]
        sure = np.bitwise_count(f[a] ^ f[b[at]]) <= RADIUS
        for k in range(most):
            must = differ[family[a], k]
            sure &= (must == 0) | (x & must != 0)
        on[at] = sure
        return on

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        family, cell, first, second, block, f, rep = columns
        f = f.view(np.uint64)
        u, same = embedded(f), first == second
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in (family, cell, first, second)], axis=0)]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(f)])
        ends = np.repeat(begin + size, size)
        a_all, b_all = [], []
        few = np.repeat(size <= FEW, size)
        for d in range(1, FEW):
            a = np.flatnonzero(few & (np.arange(len(f)) + d < ends))
            on = close(f, u, block, family, same, a, a + d)
            a_all.append(a[on])
            b_all.append(a[on] + d)
        for at, n in zip(begin[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            x, y = np.nonzero(np.triu(np.bitwise_count(u[at : at + n, None] ^ u[None, at : at + n]) <= RADIUS, 1))
            on = close(f, u, block, family, same, at + x, at + y)
            near = np.zeros((n, n), bool)
            near[x[on], y[on]] = near[y[on], x[on]] = True
            for a, b in _forest(near):
                a_all.append(at + a)
                b_all.append(at + b)
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.r_[x, y] for x, y in zip(rest, columns, strict=True)]
            # the last tile may go on in the next batch
            last = np.all([c == c[-1] for c in columns[:4]], axis=0) if len(columns[0]) else np.zeros(0, bool)
            cut = len(last) - int(last.sum())
            rest = [c[cut:] for c in columns]
            if cut:
                yield pairs([c[:cut] for c in columns])
        if rest is not None and len(rest[0]):
            yield pairs(rest)

    return run


def links(classes: DataFrame) -> DataFrame:
    """a, b (reps): links within RADIUS bits between the fingerprints of classes (fingerprint, rep; a stored table of
    distinct fingerprints), or enough of them to connect all that are."""
    groups = groups_for(classes.count())
    tiles = ["family", "cell", "first", "second"]
    rows = tiled(cells(classes, groups)).repartition(*tiles).sortWithinPartitions(*tiles)
    return rows.mapInArrow(_linked(groups), "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: a row per row of documents (doc_id long, text; others
    are ignored).

    Documents are linked if their fingerprints differ in RADIUS bits at most; component_id is the smallest doc_id that
    links lead to. Equal fingerprints are one class, whose members need no pairs. Null, empty and blank texts have the
    fingerprint zero and are linked like any others. Rows that share a doc_id are one node, linked by any of their texts.
    Rows without a doc_id cannot be pointed at and link nothing: their component_id is null. An empty table gives no rows.
    """
    rows = stored(fingerprints(documents))
    known = rows.where("doc_id is not null")
    classes = stored(known.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    found = stored(links(classes))
    several = stored(known.groupBy("doc_id").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).where("low < high").select("doc_id"))
    edges = found
    if several.limit(1).count():
        own = known.join(small(several), "doc_id", "left_semi").distinct().join(classes, "fingerprint")
        edges = edges.union(stored(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    labels = components(edges)
    named = stored(classes.join(small(labels), F.col("rep") == F.col("node"), "left").select("fingerprint", F.coalesce("label", "rep").alias("component")))
    for df in (classes, found, several, labels):
        forget(df)
    out = join_skewed(rows, named, "fingerprint", "left")
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return out.select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
