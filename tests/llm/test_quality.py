import math
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from sealframe.llm import quality


def data(seed=2, n=600):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choices("aeioutrnsl", k=r.randrange(2, 8))) for _ in range(r.randrange(30, 120))]
        kind = r.random()
        if kind < 0.15:
            words = [w.upper() + "!!" for w in words]
        elif kind < 0.3:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["zvile", "zcruel", "zhateful"])
        docs.append((i, " ".join(words), f"s{i % 7}", "en"))
        labels.append((i, 0 if kind < 0.15 else 1, 1 if 0.15 <= kind < 0.3 else 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = data()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(d, known, F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    assert len(got) == 600
    wrong = sum(got[i].keep != (q == 1 and t == 0) for i, q, t in labels[400:])
    assert wrong <= 10


def plain_features(s):
    words = s.lower().split()
    n, chars, lines = max(1, len(words)), max(1, len(s)), [x for x in s.split("\n") if x]
    bare = {w.strip(quality._EDGE) for w in words}
    names = bare | {"^" + w[:4] for w in bare if len(w) > 4} | {"^" + w[:5] for w in bare if len(w) > 5}
    shape = [
        sum(c.isupper() for c in s) / chars, sum(not c.isalnum() and not c.isspace() for c in s) / chars, sum(c.isdigit() for c in s) / chars,
        len(set(words)) / n, len(set(lines)) / max(1, len(lines)), min(1, chars / n / 20), min(1, math.log2(n + 1) / 16),
        sum(w[-1] in "!*%$&" for w in words) / n,
    ]
    hashed = {quality.SHAPES + crc32(x.encode()) % (quality.BUCKETS - quality.SHAPES) for x in names}
    return sorted(hashed | {21 * i + int(20 * v) for i, v in enumerate(shape)})


@pytest.mark.parametrize("s", ["", "  \n\n", "...", "a b a", "Loud! LOUD!! 5% $", "\u00c9 \u00dcn\u00ef \x1c x\x85y \u00bd\u00b2", "\u0391\u03a3 \u03a3! abcd abcde abcdef", "x" * 100 + "! " + "ab\n" * 9000])
def test_features_equal_plain_ones(s):
    assert quality.features(s).tolist() == plain_features(s) == quality.features(s).tolist()


def test_sparse_sites_are_shrunk(spark):
    groups = spark.createDataFrame([(2, 1.0)] * 50 + [(2, 0.0)] * 50, "n long, t double")
    assert quality._strength(groups, "n", "t", 0.25) > 2


def test_posteriors_match_plain_sums(spark):
    """Site priors and probabilities from the classifier's log odds, by plain Python."""
    docs, labels = data(5, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    path = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.concat("source", F.lit("/x")))
    got = {r.doc_id: r for r in quality.score(d, known, F.col("source"), path).collect()}
    model = quality.train(d, known)
    dense = model.dense()
    z = {i: model.logits([quality.features(t)], dense)[0] for i, t, _, _ in docs}
    site = {i: (s, None if i % 5 == 0 else s + "/x") for i, _, s, _ in docs}
    for k, t in enumerate(quality.TARGETS):
        p = {i: 1 / (1 + math.exp(-z[i][k])) for i in z}
        prior = sum(p.values()) / len(p)

        def strength(groups):
            rows = [[p[i] for i in z if groups(i) == g] for g in {groups(i) for i in z}]
            rows = [r for r in rows if len(r) > 1]
            spread = sum((sum(r) / len(r) - prior) ** 2 for r in rows) / len(rows)
            chance = sum(prior * (1 - prior) / len(r) for r in rows) / len(rows)
            return min(1e6, max(2.0, prior * (1 - prior) / max(spread - chance, 1e-9) - 1))

        k_host, k_path = strength(lambda i: site[i][0]), strength(lambda i: site[i])
        for i in list(z)[:60]:
            host = [p[j] for j in z if j != i and site[j][0] == site[i][0]]
            own = [p[j] for j in z if j != i and site[j] == site[i]]
            theta = (sum(own) + k_path * (sum(host) + k_host * prior) / (len(host) + k_host)) / (len(own) + k_path)
            logit = lambda q: math.log(min(1 - 1e-9, max(1e-9, q)) / (1 - min(1 - 1e-9, max(1e-9, q))))
            assert got[i][f"site_{t}"] == pytest.approx(theta, rel=1e-6, abs=1e-9)
            assert got[i][f"p_{t}"] == pytest.approx(1 / (1 + math.exp(-(z[i][k] + logit(theta) - logit(prior)))), rel=1e-6, abs=1e-9)


def test_sample_is_bounded_however_often_an_id_repeats(spark):
    d = spark.createDataFrame([(1, f"text {i}") for i in range(300)], "doc_id long, text string")
    known = spark.createDataFrame([(1, 0, 0)] * 5, "doc_id long, quality int, toxic int")
    sets = []
    real = quality.fit
    quality.fit = lambda s, y: sets.append(s) or real(s, y)
    try:
        quality.train(d, known, rows=20)
    finally:
        quality.fit = real
    assert len(sets[0]) <= 20


def test_large_sites_meet_all_rows(spark, monkeypatch):
    from sealframe.llm import common

    monkeypatch.setattr(common, "LARGE_SITE", 5)
    rows = spark.createDataFrame([(i, "a" if i < 20 else f"s{i % 7}") for i in range(50)], "x long, site string")
    sites = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
    want = {(r.x, r.site, r.n, r.total) for r in rows.join(sites, "site").collect()}
    assert {(r.x, r.site, r.n, r.total) for r in common.joined_by_site(rows, sites, ["site"], "n").collect()} == want


def test_odd_rows(spark):
    rows = [(1, None, None, None), (None, "a b", "s", "en"), (2, "", "s", None), (2, "", "s", None), (3, "x " * 5000, "s", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("host", F.lit(1)).withColumn("n_path", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score(d, none, F.col("source"), F.concat_ws("/", "source", "lang"))
    assert out.count() == 5 and out.filter("keep").count() == 5
    some = spark.createDataFrame([(1, None, None), (2, 1, 0), (9, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(d, some, F.col("source"), F.concat_ws("/", "source", "lang")).count() == 5
    assert quality.score(d.limit(0), some, F.col("source"), F.col("lang")).count() == 0


def test_url_sites(spark):
    r = spark.createDataFrame([("https://A.example/x/y?q=1",)], "u string").select(quality.url_host(F.col("u")), quality.url_path(F.col("u"))).first()
    assert tuple(r) == ("a.example", "a.example/x")
