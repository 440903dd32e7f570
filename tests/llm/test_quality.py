import numpy as np

from pyspark.sql import functions as F

from tidemark.llm import quality as q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("doc_id % 4 = 0")
    rows = q.classify(docs.join(held, "doc_id", "left_semi"), labels.where("doc_id % 4 <> 0"), model=q.train(docs, labels.where("doc_id % 4 <> 0"))).join(held, "doc_id").collect()
    share = lambda keep, of: np.mean([keep(r) for r in rows if of(r)])
    assert share(lambda r: r.p_bad >= 0.5, lambda r: r.quality == 0) > 0.97
    assert share(lambda r: r.kept, lambda r: r.quality == 1 and r.toxic == 0) > 0.97
    assert share(lambda r: r.p_toxic >= 0.5, lambda r: r.toxic == 1 and r.quality == 1) > 0.75


def test_site_posteriors(spark):
    """Shrinking, held against the formulas on plain numbers."""
    paths = [("a", "x", 40, 30.0), ("a", "y", 10, 2.0), ("b", "x", 100, 10.0), (None, None, 1, 1.0)]
    got = {(r.host, r.path): r for r in q.site_posteriors(spark.createDataFrame([(*p, 0.5) for p in paths], "host string, path string, n long, bad double, toxic double")).where("head = 'bad'").collect()}
    prior = 43 / 151
    hosts = {"a": (50, 32.0), "b": (100, 10.0), None: (1, 1.0)}
    spread = max((sum(n * (s / n - prior) ** 2 for n, s in hosts.values()) - 3 * prior * (1 - prior)) / 151, 1e-6)
    strength = min(max(prior * (1 - prior) / spread - 1, 1.0), 1e4)
    for (h, p), r in got.items():
        n, s = hosts[h]
        assert np.isclose(r.prior, prior) and np.isclose(r.host_posterior, (s + strength * prior) / (n + strength))
    assert len(got) == 4 and 1.0 <= got["a", "x"].path_strength <= 1e4


def by_hand(rows, marks, model, threshold=0.5):
    """(doc_id, p_bad, p_toxic, kept) of rows (doc_id, text, host, path) by plain loops."""
    logit, sigmoid = (lambda p: np.log(p / (1 - p))), (lambda x: 1 / (1 + np.exp(-x)))
    inside = lambda p: min(max(p, 1e-4), 1 - 1e-4)
    slots = q.Slots()
    own = []
    for _, text, _, _ in rows:
        shape, words = q.features(text, slots)
        x = ((shape - model["mean"]) / model["scale"] @ model["bad"][:-1] + model["bad"][-1], model["toxic"][words].sum() + model["toxic_bias"])
        own.append([inside(sigmoid(np.clip(v, -30, 30))) for v in x])
    out = [[r[0]] for r in rows]
    for h, head in enumerate(q.HEADS):
        soft = [float(marks[r[0]][h]) if r[0] in marks else p[h] for r, p in zip(rows, own, strict=True)]
        prior = sum(soft) / len(soft)
        group = lambda key: {k: (sum(key(r) == k for r in rows), sum(s for r, s in zip(rows, soft, strict=True) if key(r) == k)) for k in {key(r) for r in rows}}

        def strength(sites, centre):
            chance = sum(centre(k) * (1 - centre(k)) for k in sites)
            spread = max((sum(n * (s / n - centre(k)) ** 2 for k, (n, s) in sites.items()) - chance) / sum(n for n, _ in sites.values()), 1e-6)
            return min(max(chance / len(sites) / spread - 1, 1.0), 1e4)

        hosts, paths = group(lambda r: r[2]), group(lambda r: (r[2], r[3]))
        k = strength(hosts, lambda _: prior)  # noqa: B023
        of_host = {host: (s + k * prior) / (n + k) for host, (n, s) in hosts.items()}
        k = strength(paths, lambda p: of_host[p[0]])  # noqa: B023
        for r, s, p, o in zip(rows, soft, own, out, strict=True):
            n, total = paths[r[2], r[3]]
            posterior = (total - s + k * of_host[r[2]]) / (n - 1 + k)
            o.append(float(sigmoid(logit(p[h]) + logit(inside(posterior)) - logit(inside(prior)))))
    return [(d, a, b, a < threshold and b < threshold) for d, a, b in out]


def test_query_equals_brute_force(spark):
    """Every row of the table, with labels of some, repeated ids and empty columns added."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang"), spark.read.parquet(f"{sf}/labels.parquet")
    more = spark.createDataFrame([(None, None, None, None), (3, "again", None, "en"), (3, "again", None, "en"), (10**9, "", "rare site", None)], docs.schema)
    docs = docs.union(more).withColumn("site", F.lit("clash")).withColumn("p_bad", F.lit(1)).withColumn("bad", F.lit(0))
    model = q.train(docs, labels)
    marks = {}
    for r in labels.collect():
        bad, toxic = marks.get(r.doc_id, (0, 0))
        marks[r.doc_id] = (max(bad, 1 - r.quality), max(toxic, r.toxic))
    key = lambda r: (str(r[0]), *map(float, r[1:3]))
    want = sorted(by_hand([(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], marks, model), key=key)
    got = sorted(map(tuple, q.classify(docs, labels, model=model).collect()), key=key)
    assert len(got) == len(want) and sum(not g[3] for g in got) > 10
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and np.allclose(g[1:3], w[1:3], atol=1e-9) and (g[3] == w[3] or min(abs(w[1] - 0.5), abs(w[2] - 0.5)) < 1e-9)


def test_bad_site_shifts_and_awkward_rows(spark):
    good = "the quiet river ran under the old bridge and nobody in the village looked up at all that day "
    rows = [(i, good + str(i), "s", "p", 1) for i in range(30)] + [(100, None, None, None, 2), (None, "", "s", None, 3), (5, good, "s", "p", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.classify(docs, none).collect()
    assert len(got) == 33 and all(r.kept for r in got)
    labels = spark.createDataFrame([(i, 0, 0) for i in range(10)] + [(None, 1, 1), (4, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert q.classify(docs, labels).count() == 33
    assert q.classify(docs.limit(0), labels).count() == 0
    assert {r.doc_id: (r.bad, r.toxic) for r in q.judged(labels).collect()}[3] == (1, 1)


def test_features():
    shape, words = q.features("BIG NEWS!! %%% big news!!", q.Slots())
    assert len(words) == 3 and shape[0] > 0 and shape[1] > 0
    assert (q.features(None, q.Slots())[0] == q.features("", q.Slots())[0]).all()
    assert F is not None
