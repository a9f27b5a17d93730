import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sealframe.llm import common, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    up = {n: n for n in nodes}
    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = up[a], up[b]
                if x != y:
                    for n in up:
                        if up[n] == max(x, y):
                            up[n] = min(x, y)
    return up


def clusters(seed, centres, copies):
    g = np.random.default_rng(seed)
    out = []
    for c in g.integers(0, 2**63, centres, dtype=np.uint64).tolist():
        for _ in range(copies):
            x = c
            for b in g.integers(0, 64, g.integers(0, 4)).tolist():
                x ^= 1 << b
            out.append(x)
    return out


def test_fingerprint_matches_brute_force():
    for t in ["", None, "One", "one two", "A b C d e f", "x " * 300, "é ü ñ ß 漢", "a\x0bb\x0cc\rd"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_trie_finds_every_pair():
    fps = np.unique(np.array(clusters(1, 12, 40), np.uint64))
    a, b = simhash.trie_links(fps, np.array([0]))
    d = np.bitwise_count(fps[:, None] ^ fps[None])
    want = set(zip(*map(np.ndarray.tolist, np.where(np.triu(d <= 2, 1)))))
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("group_rows", [2000, 8])
def test_components_match_brute_force(spark, monkeypatch, group_rows):
    """Also with groups so small that they are split by balanced bits."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    fps = {f - 2**64 if f >= 2**63 else f: f for f in clusters(2, 8, 25)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in common.components(simhash.links(df)).collect()}
    want = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert all(got.get(n, n) == c for n, c in want.items())


def test_rows_without_id_link_others(spark, monkeypatch):
    """Fingerprints 0, 3 and 15: the middle one has a null id."""
    prints = spark.createDataFrame([(1, 0), (None, 3), (2, 15), (None, 15 << 40)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: prints)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(prints).collect()}
    assert got == {(1, 0): 1, (None, 3): 1, (2, 15): 1, (None, 15 << 40): None}


def test_edge_cases(spark):
    rows = [(5, None), (7, ""), (3, " \n"), (9, "Same text here now"), (8, "same TEXT here now"), (None, "same text here now"), (9, "Same text here now"), (1, "quite other words than those above it " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("rep", F.lit(1))
    got = [tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (7, 3), (3, 3), (9, 8), (8, 8), (None, 8), (9, 8), (1, 1)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(500, x) for x in range(501, 560)] + [(700, 700)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 500 for x in range(500, 560)}}
