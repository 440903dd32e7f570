"""Near-duplicate documents by SetSketch registers: banded for candidates, compared by likelihood, then verified.

A register keeps floor(1 - log_b(x)), x being the smallest of a set's hashes under one hash function read as an
exponential variate: minima at exponentially spaced, truncated levels. Registers of a union are the larger of both, and
two sets agree in a register about as often as their Jaccard similarity says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import BROADCAST_ROWS, forget, join_skewed, sliced, sliced_by_bytes, small, small_batches, stored, table
from .components import components
from .shingles import mixed, shingle_sets

BASE = 1.001
RATE = 20.0
TOP = 65534
ROWS = 8
BANDS = 48
REGISTERS = ROWS * BANDS
#: Largest probability that a pair at the threshold shares no band.
MISSED = 3e-7

#: A pair goes on to verification unless its estimate lies this far below the threshold: eight standard errors.
MARGIN = 0.2

#: Sets that are sketched together, and points made at a time once few hashes are left.
SKETCHED, POINTS = 256, 1 << 15
#: Pairs whose similarity is estimated together.
ESTIMATED = 512
#: Members of a hub, or rows of an element, that one task may meet.
SPLIT_ROWS = 1024


def sketch_all(sets: list[np.ndarray]) -> np.ndarray:
    """The SetSketches of sets of 64-bit hashes: a row of REGISTERS values from 0 to TOP as uint16 for each; the empty
    set has zeros.

    The points of a hash are a Poisson process in ascending order, each dealt to a register at random, so that a
    register's least point is exponential and independent of the other registers'. A hash is done once its points are
    above all the minima of its set, which is soon the case: about n + REGISTERS * log(REGISTERS) points in all.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate([*sets, np.zeros(0, np.uint64)])
    least = np.full(len(sets) * REGISTERS, np.inf)
    x, k = np.zeros(len(h)), 0
    while len(h):
        many = min(512, max(1, POINTS // len(h)))  # points of each hash in this round
        step = (np.arange(k + 1, k + many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        r = mixed(h[:, None] + step)
        gaps = np.log1p(-((r >> np.uint64(24)).astype(np.float64) + 0.5) / 2.0**40)
        points = x[:, None] - (gaps.cumsum(axis=1) if many > 1 else gaps) / REGISTERS
        # the lowest 24 bits choose the register
        cell = (owner * REGISTERS)[:, None] + ((r & np.uint64(0xFFFFFF)) * np.uint64(REGISTERS) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(least, cell.reshape(-1), points.reshape(-1))
        x, k = points[:, -1], k + many
        some = np.flatnonzero(np.bincount(owner, minlength=len(sets)))
        top = np.zeros(len(sets))
        top[some] = least.reshape(-1, REGISTERS)[some].max(axis=1)
        on = x < top[owner]
        h, x, owner = h[on], x[on], owner[on]
    with np.errstate(divide="ignore"):
        values = np.clip(np.floor(1 - np.log(least / RATE) / np.log(BASE)), 0, TOP)
    return np.where(np.isinf(least), 0, values).astype(np.uint16).reshape(-1, REGISTERS)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of one set."""
    return sketch_all([shingles])[0]


def banding(percent: int) -> tuple[int, int]:
    """Rows of a band and number of bands, BANDS at least: the longest bands (of up to ROWS) that miss a pair at the
    threshold with a probability of MISSED at most; all registers one by one where none do."""
    for rows in range(ROWS, 0, -1):
        agree = min(max(percent / 100, 0.0), 1.0) ** rows
        need = math.ceil(math.log(MISSED) / math.log1p(-agree)) if 0 < agree < 1 else 1 if agree else REGISTERS + 1
        if rows * max(need, BANDS) <= REGISTERS:
            return rows, max(need, BANDS)
    return 1, REGISTERS


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from their registers (rows of a and b) and their set sizes.

    The numbers of registers where either is larger, or none, are multinomial; their probabilities follow from the
    similarity and the relative sizes.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u = n_a / np.maximum(n_a + n_b, 1)
    v = 1 - u
    grid = np.linspace(0, 1, 201)[:, None] * np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)

    def larger(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = larger(u - v * grid), larger(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0)
        fit = log(above, p) + log(below, q) + log(same, 1 - p - q)
    return np.take_along_axis(grid, fit.argmax(axis=0)[None], axis=0)[0]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced_by_bytes(batches, 1):
        sets = list(shingle_sets(batch.column(1)))
        keys = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
        rows = [r.tobytes() for i in range(0, len(sets), SKETCHED) for r in sketch_all(sets[i : i + SKETCHED])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "key", "registers"])


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (a 128-bit digest of the whole set), registers; a row per row of documents."""
    return documents.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, n_shingles long, key binary, registers binary")


def _buckets(size: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.empty((batch.num_rows, bands), np.uint64)
            for i, r in enumerate(batch.column(2).to_pylist()):
                for k in range(bands):
                    found[i, k] = xxhash.xxh64_intdigest(r[k * size * 2 : (k + 1) * size * 2], seed=k)
            repeat = lambda x: pa.array(np.repeat(x.to_numpy(zero_copy_only=False), bands))
            yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1).view(np.int64)), repeat(batch.column(0)), repeat(batch.column(1))], ["bucket", "doc", "n"])

    return run


def buckets(sketched: DataFrame, percent: int = 85) -> DataFrame:
    """bucket, doc, n: the rows of bands that at least two different sets share. A set stands there once, under the least
    doc_id of its copies; a doc_id of several texts has the rows of each set that it stands for."""
    one = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min_by(F.struct("doc_id", "n_shingles", "registers"), "doc_id").alias("one"))
    rows = one.select("one.*").mapInArrow(_buckets(*banding(percent)), "bucket long, doc long, n long")
    shared = rows.groupBy("bucket").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("bucket")
    return rows.join(shared, "bucket", "left_semi")


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    rows = lambda x: np.frombuffer(b"".join(x), np.uint16).reshape(len(x), REGISTERS)
    out = np.empty(len(a))
    for i in range(0, len(a), ESTIMATED):
        k = slice(i, i + ESTIMATED)
        out[k] = likely_jaccard(rows(a[k]), rows(b[k]), n_a[k].to_numpy(float), n_b[k].to_numpy(float))
    return pd.Series(out)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced_by_bytes(batches, 1):
        sets = list(shingle_sets(batch.column(1)))
        v = [xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc", "v", "n", "shingles"])


def _sets(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, v (tells a doc_id's texts apart), n, shingles (sorted 64-bit hashes) of the documents in rows."""
    ids = stored(rows.select(F.col("doc").alias("doc_id")).distinct())
    texts = documents.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")
    return stored(texts.mapInArrow(_packed, "doc long, v long, n long, shingles binary").where("n > 0").dropDuplicates(["doc", "v"]))


#: Longs of a delta's parity: 64 bits each.
PARITY = 8
DELTAS = "hub long, doc long, v long, comp long, n long, n_hub long, m long, delta binary, " + ", ".join(f"p{k} long" for k in range(PARITY))


def parity(delta: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITY classes of elements: whether their number is odd. Two deltas have as many unshared
    elements as there are bits in which their parities differ, at least."""
    odd = np.bincount((delta % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by hub and salt, each hub's own set in front: what every member's set and the hub's do not share."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in sliced_by_bytes(batches, 7):
        out = []
        for h, first, doc, v, comp, n, shingles in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 7)), strict=True):
            found = np.frombuffer(shingles, np.uint64)
            if first == 0:
                hub, own = h, found
            else:
                assert h == hub
                delta = np.setxor1d(found, own, assume_unique=True)
                out.append((h, doc, v, comp, n, len(own), len(delta), delta.tobytes(), *parity(delta).tolist()))
        if out:
            kinds = [pa.int64()] * 7 + [pa.binary()] + [pa.int64()] * PARITY
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in DELTAS.split(", ")])


def against(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """DELTAS of pairs (hub, doc, comp; a stored table): how a document's set differs from one set of the hub. The members
    of a hub are dealt to as many tasks as they need, and the hub's set goes to each of these once."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SPLIT_ROWS).cast("int").alias("parts"))
    sizes = stored(sizes)
    salted = join_skewed(pairs, sizes, "hub").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    members = salted.join(sets, "doc").select("hub", "salt", F.lit(1).alias("member"), "doc", "v", "comp", "n", "shingles")
    one = sets.join(sizes.select(F.col("hub").alias("doc")), "doc", "left_semi").groupBy("doc").agg(F.min_by(F.struct("v", "n", "shingles"), "v").alias("x"))
    hubs = sizes.join(one, F.col("hub") == F.col("doc")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hubs = hubs.select("hub", "salt", F.lit(0).alias("member"), "doc", "x.v", F.lit(None).cast("long").alias("comp"), "x.n", "x.shingles")
    return members.union(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(_differ, DELTAS)


def _linked(m: str, n: str, percent: int) -> str:
    """Whether sets of n shingles together, of which m are not shared, have 100 * intersection >= percent * union."""
    return f"100 * ({n} - {m}) >= {percent} * ({n} + {m})"


def hub_links(deltas: DataFrame, percent: int) -> DataFrame:
    return deltas.where("doc <> hub").where(_linked("m", "(n + n_hub)", percent)).select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()


def likely(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose similarity, estimated from registers, is not far below the threshold."""
    k = sketched.select("doc_id", "n_shingles", "registers")
    near = pairs.join(k.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a")), "a")
    near = join_skewed(stored(near), k.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b")), "b", limit=0)
    return near.where(_estimate("r_a", "r_b", "n_a", "n_b") >= percent / 100 - MARGIN).select("a", "b").distinct()


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component so far, with each row's component."""
    known = join_skewed(rows, stored(labels.select(F.col("node").alias("doc"), "label")), "doc", "left").select("bucket", "doc", "n", F.coalesce("label", "doc").alias("comp"))
    known = stored(known)
    unsettled = stored(known.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket"))
    return stored(join_skewed(known, unsettled, "bucket", "left_semi"))


def _star(rows: DataFrame, percent: int) -> DataFrame:
    """Each row's document with the document that is first most often in its buckets (of other components)."""
    first = stored(rows.groupBy("bucket").agg(F.min_by(F.struct("doc", "comp", "n"), "doc").alias("first")))
    met = join_skewed(rows, first, "bucket").where(f"first.comp <> comp and 100 * least(n, first.n) >= {percent} * greatest(n, first.n)")
    votes = met.groupBy("doc", F.col("first.doc").alias("first")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("doc").agg(F.max_by("first", F.struct("votes", -F.col("first"))).alias("b")).select(F.col("doc").alias("a"), "b")


def _elements(percent: int):
    """hub, doc, v, comp, n, m and an element of the delta each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, 6):
            m = batch.column(5).to_numpy(zero_copy_only=False)
            repeat = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), m)) for k in range(6)]
            element = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([*repeat, pa.array(element)], ["hub", "doc", "v", "comp", "n", "m", "element"])

    return run


def fronts(deltas: DataFrame, percent: int) -> DataFrame:
    """The elements by which deltas of one hub can meet, with their place i in the delta, rarest elements first.

    Sets that differ in s places at most have deltas that do so too: of m_a and m_b elements they share
    (m_a + m_b - s) / 2, so the first one they share has nearly all of the others behind it. A set's own size bounds s.
    What a set lacks of its hub is told apart like what it has besides, so pages of one template meet only if they
    depart from it in the same places.
    """
    each = stored(deltas.select("hub", "doc", "v", "comp", "n", "m", "delta").mapInArrow(_elements(percent), "hub long, doc long, v long, comp long, n long, m long, element long"))
    common = stored(each.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    there = each.join(small(common), ["hub", "element"], "left")
    place = F.row_number().over(Window.partitionBy("hub", "doc", "v").orderBy(F.coalesce("df", F.lit(1)), "element")) - 1
    front = there.withColumn("i", place).where(f"df is not null and {percent} * i <= {100 - percent} * n").drop("df")
    return stored(front.join(deltas.select("hub", "doc", "v", *[f"p{k}" for k in range(PARITY)]), ["hub", "doc", "v"]))


#: What a join of elements knows of a document.
MET = ("hub", "doc", "v", "comp", "n", "m", "i", *(f"p{k}" for k in range(PARITY)))


def _may_link(x: str, y: str, percent: int) -> str:
    """Whether the places where two deltas first meet leave room for a link, and their parities do."""
    n, p = f"({x}.n + {y}.n)", percent
    free = f"floor({n} * {100 - p} / {100 + p})"
    apart = " + ".join(f"bit_count({x}.p{k} ^ {y}.p{k})" for k in range(PARITY))
    return f"{apart} <= {free} and 100 * least({x}.n, {y}.n) >= {p} * greatest({x}.n, {y}.n) and {x}.m + {y}.m - {free} <= 2 * least({x}.m - {x}.i, {y}.m - {y}.i) and abs({x}.m - {y}.m) <= {free}"


def _once(met: DataFrame) -> DataFrame:
    """Pairs (hub, a, b) of the met x and y, once each: documents that meet under several hubs are as far apart under each."""
    x, y = F.struct("x.doc", "x.v"), F.struct("y.doc", "y.v")
    return met.select(F.col("x.hub").alias("hub"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).groupBy("a", "b").agg(F.min("hub").alias("hub"))


def _first_met(front: DataFrame, percent: int) -> DataFrame:
    """Pairs of each document with the first that has the same element, in another component."""
    first = front.groupBy("hub", "element").agg(F.min_by(F.struct(*MET[1:]), F.struct("doc", "v")).alias("y"))
    key = F.struct("hub", "element").alias("key")
    both = join_skewed(front.select(key, F.struct(*MET).alias("x")), stored(first.select(key, "y")), "key", limit=BROADCAST_ROWS // 8)  # rows of many longs
    met = both.where(f"x.comp <> y.comp and {_may_link('x', 'y', percent)}")
    return _once(met)


def _rest(front: DataFrame, percent: int) -> DataFrame:
    """All pairs of documents of different components that may link. Within an element the component with most rows is
    never met with itself, and a hot element is dealt to many tasks. Rows that stand too far back in their delta to link even
    with the smallest delta and the largest set of the element are left out."""
    counts = front.groupBy("hub", "element", "comp").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("m"), F.max("n").alias("n")).groupBy("hub", "element")
    met = counts.agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.sum("k").alias("rows"), F.count(F.lit(1)).alias("comps"), F.min("m").alias("least"), F.max("n").alias("most")).where("comps > 1")
    met = stored(met.select(F.struct("hub", "element").alias("key"), "major", "least", "most", F.ceil(F.col("rows") / SPLIT_ROWS).cast("int").alias("parts")))
    rows = front.select(F.struct("hub", "element").alias("key"), F.struct(*MET).alias("x"))
    near = f"x.m + least - floor((x.n + most) * {100 - percent} / {100 + percent}) <= 2 * (x.m - x.i)"
    marked = stored(join_skewed(rows, met, "key").where(near).withColumn("minor", F.col("x.comp") != F.col("major")).drop("least", "most"))
    own = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("x.doc"), F.col("parts")).cast("int"))
    every = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = every(marked.where("minor")).select("key", "salt", "x", "minor")
    b = own(marked).select("key", "salt", F.col("x").alias("y"), F.col("minor").alias("also"))
    both = a.join(b, ["key", "salt"]).where(f"x.comp <> y.comp and (not also or x.doc < y.doc) and {_may_link('x', 'y', percent)}")
    return _once(both)


def _unshared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced_by_bytes(batches, 3):
        x, y = ([np.frombuffer(d, np.uint64) for d in batch.column(k).to_pylist()] for k in (3, 4))
        m = [len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(m, pa.int64())], ["a", "b", "n", "m"])


def delta_links(pairs: DataFrame, deltas: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (hub, a, b; each a document and its v) of one hub, those that link: two sets differ where their deltas
    do. A document that many pairs have is no task of its own."""
    for side in ("a", "b"):
        known = deltas.select(F.struct("hub", F.struct("doc", "v").alias("x")).alias("key"), F.struct("n", "delta").alias(f"d_{side}"))
        pairs = join_skewed(pairs.withColumn("key", F.struct("hub", F.col(side).alias("x"))), known, "key", limit=0).drop("key")
    both = pairs.select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b"), (F.col("d_a.n") + F.col("d_b.n")).alias("n"), F.col("d_a.delta").alias("x"), F.col("d_b.delta").alias("y"))
    sure = both.mapInArrow(_unshared, "a long, b long, n long, m long")
    return stored(sure.where(_linked("m", "n", percent)).select("a", "b").distinct())


def _by_deltas(unsettled: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """All links that are missing between components that share a bucket, or enough of them: documents of a bucket have its
    first document for a hub, and meet by their deltas to it, first those of an element with its first document, then,
    of components that are still apart, all that may link."""
    first = stored(unsettled.groupBy("bucket").agg(F.min("doc").alias("hub")))
    groups = stored(join_skewed(unsettled.select("bucket", "doc", "comp"), first, "bucket").select("hub", "doc", "comp").distinct())
    deltas = stored(against(groups, sets))
    found = stored(hub_links(deltas, percent))
    front = fronts(deltas, percent)
    more = delta_links(stored(_first_met(front, percent)), deltas, percent)
    labels = stored(components(links.union(found).union(more)).select(F.col("node").alias("doc"), "label"))
    later = join_skewed(front, labels, "doc", "left").withColumn("comp", F.coalesce("label", "doc")).drop("label")
    last = delta_links(stored(_rest(stored(later), percent)), deltas, percent)
    for df in (groups, front):
        forget(df)
    return stored(found.union(more).union(last))


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of documents (doc_id long, text; others are ignored).

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct five-word shingles;
    component_id is the smallest doc_id that links lead to, kept is true where that is the row's own. Sets that are
    equal are one class, whose members need no pairs. Candidates share all registers of a band. Components first grow
    by pairing each document with the one that most often comes first in its buckets; documents of components that
    still share a bucket then meet by what they do not share with the first document of the bucket, which loses no link
    and pairs up no pages that merely share a template.

    Null, empty and blank texts have no shingles and no links. Rows without a doc_id cannot be pointed at: their
    component_id is null and they are kept. Rows that share a doc_id are one node, linked by any of their texts. An
    empty table gives no rows.
    """
    with small_batches(documents.sparkSession):
        return _near_duplicates(documents.select("doc_id", "text"), percent)


def _near_duplicates(documents: DataFrame, percent: int) -> DataFrame:
    sketched = stored(sketches(documents))
    rows = stored(buckets(sketched, percent))
    sets = _sets(rows, documents)
    unsettled, links, done = rows.withColumn("comp", F.col("doc")), None, [rows, sets]
    for _ in range(2):
        pairs = stored(likely(stored(_star(unsettled, percent)), sketched, percent))
        found = against(pairs.select(F.col("b").alias("hub"), F.col("a").alias("doc"), F.lit(None).cast("long").alias("comp")), sets)
        found = stored(hub_links(found, percent))
        links = found if links is None else links.union(found)
        unsettled = _open(rows, components(links))
        done += [pairs, unsettled]
    if unsettled.limit(1).count():
        links = links.union(_by_deltas(unsettled, sets, links, percent))
    whole = sketched.where("n_shingles > 0 and doc_id is not null").select("doc_id", "key")
    one = stored(whole.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"))
    copies = join_skewed(whole, one, "key").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    labels = components(links.union(copies)).select(F.col("node").alias("doc_id"), "label")
    for df in (*done, one):
        forget(df)
    component = F.coalesce("label", "doc_id")
    rows = join_skewed(sketched.select("doc_id", "n_shingles"), labels, "doc_id", "left")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op8_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op8_near_dup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d),
cls AS (SELECT list_sort(sh) AS k, min(doc_id) AS rep, any_value(len(sh)) AS n FROM s GROUP BY 1),
post AS (SELECT rep, n, unnest(k) AS g FROM cls),
pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM post a JOIN post b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
sym AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, e.y FROM reach r JOIN sym e ON r.y = e.x),
best AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
  CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE coalesce(least(cls.rep, best.y), cls.rep) END AS component_id,
  s.doc_id = CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE coalesce(least(cls.rep, best.y), cls.rep) END AS kept
FROM s JOIN cls ON list_sort(s.sh) = cls.k LEFT JOIN best ON best.x = cls.rep
"""
}
