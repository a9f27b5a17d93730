import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealframe.llm import katz


def brute(docs):
    """Scores of (id, train, text) rows by plain dictionaries; also the conditional model."""
    toks = [(i, t, (x or "").encode().lower().split() + [b"\n"]) for i, t, x in docs]
    uni, bi, ctx = Counter(), Counter(), defaultdict(set)
    for _, t, w in toks:
        if t:
            uni.update(w)
            for a, b in zip([b" ", *w], w):
                bi[a, b] += 1
                ctx[a].add(b)
    n, v = sum(uni.values()), len(uni)
    coc = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, katz.K + 2)]
    d1, d2 = katz.discounts(coc(uni)), katz.discounts(coc(bi))
    disc = lambda c, d: c * (d[c] if c <= katz.K else 1.0)
    lost = sum(c - disc(c, d1) for c in uni.values())
    whole, unk = (n, lost / n) if lost > 0 else (n + 1, 1 / (n + 1))
    p1 = lambda w: disc(uni[w], d1) / whole if uni[w] else unk

    def p2(h, w):
        if h not in ctx:
            return p1(w)
        total = sum(bi[h, x] for x in ctx[h])
        left = sum(bi[h, x] - disc(bi[h, x], d2) for x in ctx[h])
        if left <= 1e-12:
            total, left = total + 1, 1
        if bi[h, w]:
            return disc(bi[h, w], d2) / total
        return left / total / (1 - sum(p1(x) for x in ctx[h])) * p1(w)

    scores = {}
    for i, t, w in toks:
        scores[i] = (len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p2(a, b)) for a, b in zip([b" ", *w], w)))
    return scores, p2, uni, ctx


def docs(seed=1, rows=60):
    r = random.Random(seed)
    vocab = ["The", "a", "b,", "é", *(f"w{i}" for i in range(40))]
    out = []
    for i in range(rows):
        text = " ".join(vocab[min(int(r.expovariate(0.25)), 43)] + (" " if r.random() < 0.1 else "") for _ in range(r.randrange(0, 80)))
        out.append((i, i % 4 != 2, text if i else None))
    return out + [(1000, False, "never seen words here"), (1001, True, "")]


@pytest.mark.parametrize("tokens", [200, 10**6])
def test_scores_match_brute_force(spark, monkeypatch, tokens):
    """Also with so many blocks and buckets that contexts are spread as hot."""
    monkeypatch.setattr(katz, "TOKENS", tokens)
    rows = docs()
    want, *_ = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, train boolean, text string").withColumn("kind", F.lit("x")).withColumn("block", F.lit(0))
    got, _ = katz.fit_and_score(df, F.col("train"))
    seen = {r.doc_id: r for r in got.collect()}
    assert set(seen) == set(want)
    for i, (n, known, total, base, score) in want.items():
        r = seen[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, not dict((a, b) for a, b, _ in rows)[i])
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, abs=1e-9)


def test_model_is_normalised():
    _, p2, uni, ctx = brute(docs())
    for h in [*ctx, b"unseen"]:
        assert sum(p2(h, w) for w in uni) + p2(h, b"\0unknown") == pytest.approx(1, abs=1e-9)


def test_good_turing_discounts():
    n = [1000, 400, 220, 140, 100, 75]
    d = katz.discounts(n)
    common = 6 * 75 / 1000
    assert d[1] == pytest.approx((2 * 400 / 1000 - common) / (1 - common)) and ((0 < d[1:]) & (d[1:] < 1)).all()
    assert ((0 < katz.discounts([3, 0, 0, 0, 0, 0])[1:]) & (katz.discounts([3, 0, 0, 0, 0, 0])[1:] < 1)).all()


def test_pack_round_trip():
    for a in (np.zeros(0, np.uint64), np.arange(1000, dtype=np.uint64) ** 5, np.array([1, 255], np.uint8)):
        assert (katz.unpack(katz.pack(a), a.dtype) == a).all()


def test_odd_rows(spark):
    rows = [(None, True, "a b"), (1, None, "a b"), (1, False, None), (1, True, "x " * 3000)]
    got, _ = katz.fit_and_score(spark.createDataFrame(rows, "doc_id long, train boolean, text string"), F.col("train"))
    out = got.collect()
    assert len(out) == 4 and all(math.isfinite(r.score) and r.train_tokens == 3004 for r in out)
    none, _ = katz.fit_and_score(spark.createDataFrame([(1, False, "a b")], "doc_id long, train boolean, text string"), F.col("train"))
    r = none.first()
    assert (r.score, r.base_score, r.n_known, r.train_tokens) == (0.0, 0.0, 0, 0)
    empty, _ = katz.fit_and_score(spark.createDataFrame([], "doc_id long, train boolean, text string"), F.col("train"))
    assert empty.count() == 0
