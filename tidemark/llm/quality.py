"""Quality classifier with hierarchical empirical Bayes: a document's own evidence, shifted by what its host and path
show, sparse sites being shrunk toward the levels above them.

Two heads share the machinery: low quality (from the shape of the text) and toxic (from its words). A logistic
regression is fitted for each on a bounded sample of labelled documents; everything after that covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, join_skewed, sliced, small, stored, table

#: Labelled documents that the classifier is fitted on: those whose ids hash lowest.
MAX_TRAIN = 4_000
WORD_SLOTS = 1 << 18
#: Words count for the toxic head if their labels differ from the average by so much (one degree of freedom).
MIN_CHI2 = 40.0
SHAPES = 9
HEADS = ("bad", "toxic")

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Slots(Memo):
    """Slot of a word: its hash once lower-cased and freed of punctuation at its ends."""

    def solve(self, word: str) -> int:
        return xxhash.xxh32_intdigest(word.lower().strip(_EDGES).encode()) % WORD_SLOTS


def features(text: str | None, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """The shape of a text (shares of symbols, exclamation marks, capitals, digits, repeated neighbours, repeated words,
    repeated lines, and length) and the distinct slots of its words. Null is an empty text."""
    text = text or ""
    words = text.split()
    byte = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size, n = max(1, int(byte.sum())), len(words)
    found = np.fromiter(map(slots.__getitem__, words), np.int64, n)
    distinct = np.unique(found)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, int(byte[65:91].sum() + byte[97:123].sum()))
    shape = np.array([
        byte[_SYMBOLS].sum() / size, byte[33] / size, byte[65:91].sum() / letters, byte[48:58].sum() / size,
        np.count_nonzero(found[1:] == found[:-1]) / max(1, n), 1 - len(distinct) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), 1 / (1 + n), min(np.log1p(n), 8) / 8,
    ])
    return np.sqrt(shape), distinct


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = Slots()
    for batch in sliced(batches):
        both = [features(t, slots) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s, _ in both], pa.binary()), pa.array([w.astype("<u4").tobytes() for _, w in both], pa.binary())], ["doc_id", "shape", "words"])


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam on the whole sample."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(sample: pd.DataFrame) -> dict:
    """Weights of both heads from rows of shape, words (bytes), bad, toxic (0/1). Without rows, or with one class only,
    a head gives everything the share of its class (one half without rows)."""
    model: dict = {"mean": np.zeros(SHAPES), "scale": np.ones(SHAPES)}
    prior = lambda y: float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    y = {h: sample[h].to_numpy(float) for h in HEADS}
    model |= {"bad": np.r_[np.zeros(SHAPES), prior(y["bad"])], "toxic": np.zeros(WORD_SLOTS, np.float32), "toxic_bias": prior(y["toxic"])}
    if 0 < y["bad"].sum() < len(sample):
        x = np.stack([np.frombuffer(s) for s in sample["shape"]])
        model |= {"mean": x.mean(axis=0), "scale": np.maximum(x.std(axis=0), 1e-3)}
        x = np.c_[(x - model["mean"]) / model["scale"], np.ones(len(x))]
        slope = lambda w: x.T @ (_sigmoid(x @ w) - y["bad"]) / len(x) + 1e-4 * np.r_[w[:-1], 0]
        model["bad"] = _descend(slope, SHAPES + 1, 600, 0.05)
    if 0 < y["toxic"].sum() < len(sample):
        once = ~sample["words"].duplicated().to_numpy()  # copies of a text would vouch for each of its words
        toxic = y["toxic"][once]
        words = [np.frombuffer(w, "<u4") for w in sample["words"][once]]
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        slot, at, n = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        hits, share = np.bincount(at, toxic[row]), toxic.mean()
        telling = (hits - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-12) > MIN_CHI2
        keep = telling[at]
        row, at, slot = row[keep], (np.cumsum(telling) - 1)[at[keep]], slot[telling]

        def slope(w):
            err = _sigmoid(np.bincount(row, w[at], len(words)) + w[-1]) - toxic
            return np.r_[np.bincount(at, err[row], len(slot)) / len(words) + 2e-5 * w[:-1], err.mean()]

        w = _descend(slope, len(slot) + 1, 1000, 0.1)
        model["toxic"][slot] = w[:-1]
        model["toxic_bias"] = float(w[-1])
    return model


def _scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in sliced(batches):
            out = np.empty((2, batch.num_rows))
            for i, t in enumerate(batch.column(1).to_pylist()):
                shape, words = features(t, slots)
                out[0, i] = (shape - model["mean"]) / model["scale"] @ model["bad"][:-1] + model["bad"][-1]
                out[1, i] = model["toxic"][words].sum() + model["toxic_bias"]
            p = np.clip(_sigmoid(out), 1e-4, 1 - 1e-4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(p[0]), pa.array(p[1])], ["doc_id", "host", "path", "doc_bad", "doc_toxic"])

    return run


def judged(labels: DataFrame) -> DataFrame:
    """doc_id, bad, toxic (0/1) from labels (doc_id, quality, toxic): repeated labels are bad or toxic if one is; rows
    with a null are ignored."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return rows.groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("bad"), F.max("toxic").cast("int").alias("toxic"))


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """Fit on at most max_train labelled documents."""
    chosen = judged(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = documents.select("doc_id", "text").join(small(stored(chosen), max_train), "doc_id")
    got = rows.select("doc_id", "text").mapInArrow(_featurize, "doc_id long, shape binary, words binary").join(chosen, "doc_id")
    return fit(got.limit(max_train).toPandas())


def site_posteriors(paths: DataFrame) -> DataFrame:
    """head, host, path, prior, host_posterior, path_n, path_sum, path_strength, from paths: host, path, n and a sum of
    each head (values from 0 to 1) under its name.

    Counts are soft: labels where there are some, otherwise the classifier's probability. The strength of a level's
    prior comes from how far sites spread around the level above (method of moments): the less they differ, the more
    they are shrunk. Both heads go through the same few aggregations.
    """
    each = paths.select("host", "path", "n", F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("s")) for h in HEADS])).alias("x"))
    each = each.select("x.head", "host", "path", "n", "x.s")
    hosts = stored(each.groupBy("head", "host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")))
    priors = hosts.groupBy("head").agg((F.sum("host_s") / F.greatest(F.sum("host_n"), F.lit(1))).alias("prior"))  # a row per head
    hosts = hosts.join(F.broadcast(priors), "head")

    def strength(mean, centre, n):
        """Sites spread around their centre by chance (centre * (1 - centre) / n) and by themselves."""
        chance = F.sum(centre * (1 - centre))
        own = F.sum(n * F.pow(mean - centre, 2)) - chance
        spread = F.greatest(F.try_divide(own, F.sum(n)), F.lit(1e-6))
        return F.least(F.greatest(F.avg(centre * (1 - centre)) / spread - 1, F.lit(1.0)), F.lit(1e4))

    of_hosts = hosts.groupBy("head").agg(strength(F.col("host_s") / F.col("host_n"), F.col("prior"), F.col("host_n")).alias("k"))
    posterior = (F.col("host_s") + F.col("k") * F.col("prior")) / (F.col("host_n") + F.col("k"))
    hosts = hosts.join(F.broadcast(of_hosts), "head").select("head", "host", "prior", posterior.alias("host_posterior"))
    both = each.alias("p").join(hosts.alias("h"), (F.col("p.head") == F.col("h.head")) & F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "prior", "host_posterior")
    both = stored(both)
    of_paths = both.groupBy("head").agg(strength(F.col("s") / F.col("n"), F.col("host_posterior"), F.col("n")).alias("path_strength"))
    return both.join(F.broadcast(of_paths), "head").withColumnsRenamed({"n": "path_n", "s": "path_sum"})


def classify(documents: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", model: dict | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_bad, p_toxic, kept: a row per row of documents (doc_id, text and the host and path columns).

    A document's log-odds are the classifier's, plus those of its path's posterior (without the document itself) over
    those of the global prior. It is kept if neither probability reaches the threshold. Null hosts and paths are sites
    of their own; a null text is empty; rows that share a doc_id share its labels; without labels nothing is known and
    everything is kept. An empty table gives no rows.
    """
    model = model or train(documents, labels)
    if not np.any(model["bad"]) and not np.any(model["toxic"]):
        threshold = 2.0
    rows = documents.select("doc_id", "text", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, host string, path string, doc_bad double, doc_toxic double")
    marks = small(stored(judged(labels)))
    known = scored.join(marks, "doc_id", "left").select(
        "doc_id", F.to_json(F.struct("host", "path")).alias("site"), "host", "path", "doc_bad", "doc_toxic", *[F.coalesce(F.col(h).cast("double"), F.col(f"doc_{h}")).alias(h) for h in HEADS]
    )
    known = stored(known)
    logit = lambda p: F.log(p / (1 - p))
    paths = stored(known.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(h) for h in HEADS]))
    of_head = F.map_from_entries(F.collect_list(F.struct("head", F.struct("prior", "host_posterior", "path_n", "path_sum", "path_strength"))))
    sites = stored(site_posteriors(paths).groupBy(F.to_json(F.struct("host", "path")).alias("site")).agg(of_head.alias("heads")))
    both = join_skewed(known, sites, "site")
    out = {}
    for h in HEADS:
        of = lambda c, h=h: F.col("heads")[h][c]
        posterior = (of("path_sum") - F.col(h) + of("path_strength") * of("host_posterior")) / (of("path_n") - 1 + of("path_strength"))
        inside = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
        odds = logit(F.col(f"doc_{h}")) + logit(inside(posterior)) - logit(inside(of("prior")))
        out[f"p_{h}"] = 1 / (1 + F.exp(-odds))
    kept = (F.col("p_bad") < threshold) & (F.col("p_toxic") < threshold)
    return both.withColumns(out).select("doc_id", "p_bad", "p_toxic", kept.alias("kept"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
