import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealframe.llm import common
from sealframe.llm import simhash_wide as W


def stored(bits):
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).view(np.int64)


def met(spark, bits):
    """Component of each row that the candidates' forests join."""
    rows = [(i, *map(int, f)) for i, f in enumerate(stored(bits))]
    df = spark.createDataFrame(rows, "rep long, " + W._FP_TYPES)
    return {r.node: r.component for r in common.components(W.candidates(df)).collect()}


def test_large_group_loses_no_pair(spark, monkeypatch):
    """Rows that agree in the bits of one table only, so all are in one group, which is split."""
    monkeypatch.setattr(W, "GROUP_ROWS", 8)
    g = np.random.default_rng(3)
    one = g.integers(0, 2, (100, W.BITS), np.uint8)
    one[:, W.KEYS[0]] = 1
    two = one.copy()
    for t in range(1, W.TABLES):
        free = [k for k in W.KEYS[t] if k not in set(W.KEYS[0].tolist())]
        two[:, free[0]] ^= 1
    got = met(spark, np.concatenate([one, two]))
    assert all(got[100 + i] == got[i] for i in range(100))


def test_like_pairs_join_what_all_pairs_join():
    r = random.Random(6)
    sets = []
    for _ in range(40):
        base = r.sample(range(10**6), r.randrange(1, 60))
        for _ in range(r.randrange(1, 5)):
            sets.append(np.unique(np.array([x if r.random() > 0.1 else r.randrange(10**6) for x in base], np.uint64)))
    sets += [np.zeros(0, np.uint64)] * 2
    a, b = W.like_pairs(sets, np.zeros((len(sets), W.WORDS), np.uint64), 0.8)
    got, want = W.parts_of(len(sets), np.array(a), np.array(b)), list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(set(x.tolist()) & set(y.tolist()))
            if both >= 0.8 * (len(x) + len(y) - both) and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = [lo if w == hi else w for w in want]
    assert got.tolist() == want and len(a) == len(sets) - len(set(want))


def test_trie_join_equals_all_pairs():
    g = np.random.default_rng(5)
    bits = g.integers(0, 2, (240, W.BITS), np.uint8)
    bits[120:] = bits[:120] ^ (g.random((120, W.BITS)) < 0.2)
    fps, group, part = stored(bits).view(np.uint64), g.integers(0, 5, 240), g.integers(0, 200, 240)
    group[120:] = group[:120]
    order = np.lexsort([*(fps[:, k] for k in range(W.WORDS - 1, -1, -1)), group])
    fps, group, part = fps[order], group[order], part[order]
    got = set(zip(*(x.tolist() for x in W.trie_pairs(group, fps, part))))
    want = {(i, j) for i in range(240) for j in range(i + 1, 240) if group[i] == group[j] and part[i] != part[j] and (np.bitwise_count(fps[i] ^ fps[j]).sum() <= W.BUDGET)}
    assert {tuple(sorted(p)) for p in got} == want and len(want) > 30


def test_recall_at_similarity_of_four_fifths(spark):
    """Pairs with each bit changed at the rate of similarity 0.8."""
    g = np.random.default_rng(4)
    one = g.integers(0, 2, (1500, W.BITS), np.uint8)
    got = met(spark, np.concatenate([one, one ^ (g.random((1500, W.BITS)) < 0.15)]))
    assert sum(got.get(1500 + i) == i for i in range(1500)) >= 0.9 * 1500


def corpus(n, seed=1):
    """Families of texts with edits at many rates, some near the limit of similarity."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijkl", k=5))
    docs = []
    for _ in range(n):
        base = [word() for _ in range(r.randrange(40, 200))]
        for _ in range(r.randrange(1, 6)):
            rate = r.choice([0, 0.005, 0.01, 0.02, 0.03, 0.06])
            docs.append(" ".join(word() if r.random() < rate else w for w in base))
    r.shuffle(docs)
    return docs


def brute(texts, like=W.LIKE):
    """Smallest place reachable over pairs of similarity `like` and more."""
    sets = [set(zip(*(t.lower().split()[i:] for i in range(5)))) or {t.lower()} for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= like * len(sets[i] | sets[j]) and up[i] != up[j]:
                lo, hi = sorted((up[i], up[j]))
                up = [lo if u == hi else u for u in up]
    return up


def test_components_match_brute_force(spark):
    texts = corpus(120)
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, classes, row = W.near_duplicates(df)
    got = {r.doc_id: r.component_id for r in classes.join(rows.select("doc_id", F.col(row).alias("row")), "row").collect()}
    together = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    found = [(i, j) for i, j in together if got[i] == got[j]]
    wrong = [(i, j) for i in range(len(texts)) for j in range(i) if got[i] == got[j] and want[i] != want[j]]
    assert not wrong and len(found) >= 0.97 * len(together) > 100


def test_copies_of_one_source_do_not_meet_pairwise(spark, monkeypatch):
    """Copies with an edit each are like their source and not like each other: links and checked pairs."""
    r = random.Random(31)
    word = lambda: "".join(r.choices("abcdefghijkl", k=5))
    base = [word() for _ in range(62)]
    texts = [" ".join(base)]
    for i in range(300):
        copy = list(base)
        copy[5 + r.randrange(52)] = word()
        texts.append(" ".join(copy))
    monkeypatch.setattr(W, "PART_ROWS", 90)
    real, edges = W.components, []
    monkeypatch.setattr(W, "components", lambda e: edges.append(e.count()) or real(e))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [x.doc_id for x in W.one_of_each(df).collect()] == [0]
    assert sum(edges) < 60 * len(texts)


def test_odd_rows_and_chains_over_null_ids(spark):
    r = random.Random(8)
    base = ["".join(r.choices("abcdefghijkl", k=5)) for _ in range(120)]
    middle, far = list(base), list(base)
    middle[20], far[20], far[70], far[100] = "x", "x", "y", "z"
    rows = [(7, " ".join(base)), (None, " ".join(middle)), (3, " ".join(far)), (None, None), (None, ""), (9, " \n"), (5, "alone " * 20000), (5, "alone " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_number", F.lit(1)).withColumn("ROW_number_", F.lit(2)).withColumn("rep", F.lit(3))
    out = W.one_of_each(df)
    assert out.columns == df.columns
    got = [(x.doc_id, (x.text or "")[:5]) for x in out.collect()]
    assert sorted(got, key=str) == sorted([(3, " ".join(far)[:5]), (9, " \n"), (5, "alone")], key=str)
    assert W.one_of_each(df.limit(0)).count() == 0


def test_hub_and_chain_components(spark, monkeypatch):
    monkeypatch.setattr(common, "_EDGES", 7)
    edges = [(1000, i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5), (3000, 2)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in [*range(1, 200), 1000, 3000]) and all(got[i] == 2000 for i in range(2000, 2061))


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn"])
def test_cluster_without_shared_folder_is_an_error(master):
    class Context:
        def __init__(self):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def texts_of_one_fingerprint():
    """Two texts that differ in a shingle and not in their fingerprint, and one that is like the second only."""
    for seed in range(200):
        r = random.Random(seed)
        words = ["".join(r.choices("abcdefghijkl", k=5)) for _ in range(4004)]
        one, two = (W.fingerprint(W.shingles(" ".join(w))) for w in (words[:-1], words))
        three = W.fingerprint(W.shingles(" ".join(words[800:])))
        if (one == two).all() and np.bitwise_count(two ^ three).sum() <= 36:
            return [" ".join(w) for w in (words[:-1], words, words[800:])]


def test_texts_of_one_fingerprint_each_have_their_own_links(spark):
    texts = texts_of_one_fingerprint()
    assert brute(texts) == [0, 0, 0] and brute(texts[::2]) == [0, 1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.doc_id for x in W.one_of_each(df).collect()] == [0]


def test_like_sets_of_a_part_are_linked_whatever_their_bits():
    """Short texts: four of five shingles, with more bits different than the budget."""
    sets = [np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64)]
    bits = np.zeros((2, W.BITS), np.uint8)
    bits[1, : W.BUDGET + 1] = 1
    assert W.like_pairs(sets, stored(bits).view(np.uint64), 0.8) == ([0], [1])
