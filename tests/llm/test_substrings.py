import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sealframe.llm import substrings as S


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    fresh = lambda n: [word() for _ in range(n)]
    docs, line = [], fresh(14)
    passages = [fresh(r.randrange(51, 120)) for _ in range(6)]
    for i in range(90):
        body = fresh(r.randrange(0, 200))
        if i % 3 == 0:
            at = r.randrange(len(body) + 1)
            body[at:at] = passages[r.randrange(6)]
        if i % 2:
            body = line + body if i % 4 == 1 else body + line
        docs.append((i, " ".join(body).capitalize()))
    docs += [(200, docs[1][1]), (201, docs[1][1]), (202, None), (203, "")]
    return docs


def brute(docs):
    n = S.WIDTH + S.SHINGLE - 1
    grams = {i: {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} for i, t in docs if i is not None for w in [(t or "").lower().split()]}
    up = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if a != b and grams[a] & grams[b] and up[a] != up[b]:
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    return up


def test_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "_WORDS", 150)
    docs = corpus()
    df = spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("words", F.lit(1))
    rows = S.classes(df).collect()
    got = {r.doc_id: r.class_id for r in rows}
    want = brute(docs)
    assert {k: v for k, v in got.items() if k is not None} == want and got[None] is None
    assert {r.doc_id for r in rows if r.repeated_words} == {a for a in want if any(b < a for b in want if want[b] == want[a])}


def test_remove_keeps_first_copy_and_clean_texts(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.text for r in S.remove_repeats(df).collect()}
    want = brute(docs)
    for i, t in docs:
        if want[i] == i:
            assert out[i] == t
    assert 200 not in out or len(out[200].split()) < 51
    again = S.classes(spark.createDataFrame(list(out.items()), "doc_id long, text string")).filter("links > 0").count()
    assert again == 0
    assert out[202] is None and out[203] == ""


def test_near_copies_with_one_edit(spark):
    r = random.Random(9)
    fresh = lambda n: ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    docs = []
    for i in range(60):
        p = fresh(110)
        q = list(p)
        q[r.randrange(len(q))] = "edited"
        docs += [(2 * i, " ".join(fresh(60) + p + fresh(60))), (2 * i + 1, " ".join(fresh(60) + q + fresh(60)))]
    got = {x.doc_id: x.class_id for x in S.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(60)) >= 54


def test_sliding_minima_and_spans():
    g = np.random.default_rng(1)
    x = g.integers(0, 2**63, 200, dtype=np.uint64)
    for w in (1, 2, 5, 47):
        assert (S.sliding_minima(x, w) == np.array([x[i : i + w].min() for i in range(len(x) - w + 1)])).all()
        base = 0x9E3779B97F4A7C15
        want = [sum(int(v) * pow(base, j, 2**64) for j, v in enumerate(x[i : i + w])) % 2**64 for i in range(len(x) - w + 1)]
        assert S._spans(x, w).tolist() == want


def test_compact_windows_partition_all_sequences():
    """Every sequence of the least width belongs to the one window whose node has its least hash."""
    g = np.random.default_rng(7)
    for n, width, top in ((60, 5, 2**60), (40, 3, 4), (30, 4, 1), (9, 9, 2**60)):
        h = g.integers(0, top, 3 * n, dtype=np.uint64) << np.uint64(22)
        first = np.repeat(np.arange(3) * n, n)
        inside = first[: len(h) - width + 1] == first[width - 1 :]
        c, low, high = S.compact_windows(h, inside, first, first + n - 1, width)
        found = {}
        for node, a, b in zip(c.tolist(), low.tolist(), high.tolist()):
            for i in range(a, node + 1):
                for j in range(max(node, i + width - 1), b + 1):
                    assert (i, j) not in found
                    found[i, j] = node
        want = {(i, j): i + int(np.argmin(h[i : j + 1])) for d in range(3) for i in range(d * n, d * n + n) for j in range(i + width - 1, d * n + n)}
        assert found == want


def test_one_word_over_and_over(spark):
    docs = [(1, "again " * 3000), (2, "again " * 200), (3, "once " + "again " * 40)]
    got = {r.doc_id: r.class_id for r in S.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_empty(spark):
    assert S.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def fresh_words(r, n):
    return ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def test_shared_line_is_neither_linked_nor_cut(spark):
    """A line of 40 words is no passage; of a passage, nothing but its shared words is cut."""
    r = random.Random(5)
    line, passage = fresh_words(r, 40), fresh_words(r, 60)
    docs = [(i, " ".join(fresh_words(r, 60) + line + fresh_words(r, 60))) for i in range(60)]
    around = fresh_words(r, 80)
    docs += [(100, " ".join(fresh_words(r, 50) + passage)), (101, " ".join(around[:40] + passage + around[40:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id for x in S.classes(df).collect() if x.links} == {101}
    assert {x.doc_id: x.text for x in S.remove_repeats(df).collect()} == {**dict(docs), 101: " ".join(around)}


def test_rows_of_one_id_are_cut_each_by_its_own_words(spark):
    r = random.Random(6)
    passage, a, b = fresh_words(r, 60), fresh_words(r, 80), fresh_words(r, 90)
    docs = [(1, " ".join(passage)), (2, " ".join(a + passage)), (2, " ".join(passage + b))]
    got = {x.text for x in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {t.strip() for t in got} == {" ".join(passage), " ".join(a), " ".join(b)}


def windows(text):
    w = text.split()
    grams = [tuple(w[i : i + S.SHINGLE]) for i in range(len(w) - S.SHINGLE + 1)]
    return [set(grams[i : i + S.WIDTH]) for i in range(len(grams) - S.WIDTH + 1)]


def edited(r, words, places):
    out = list(words)
    for p in sorted(places, reverse=True):
        out[p : p + 1] = r.choice([["edited"], [], [out[p], "edited"]])
    return out


def test_like_windows_are_found_wherever_the_edit_is(spark):
    """Against brute force over all windows: 51 words with the middle one changed, edits of every
    kind at any place, and passages with an edit in every 26 words or more."""
    r = random.Random(12)
    docs = []
    for i in range(120):
        p = fresh_words(r, 51 if i < 40 else r.randrange(51, 140))
        q = p[:25] + ["edited"] + p[26:] if i < 40 else edited(r, p, [r.randrange(len(p))] if i < 80 else range(r.randrange(26), len(p), r.randrange(22, 46)))
        docs += [(2 * i, " ".join(fresh_words(r, 60) + p + fresh_words(r, 60))), (2 * i + 1, " ".join(fresh_words(r, 60) + q + fresh_words(r, 60)))]
    text = dict(docs)
    like = lambda x, y: any(len(a & b) >= S.LIKE * len(a | b) for a in windows(x) for b in windows(y))
    want = {2 * i + 1 for i in range(120) if like(text[2 * i], text[2 * i + 1])}
    got = {x.doc_id for x in S.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect() if x.links}
    assert got == want and len(want) >= 90 and {2 * i + 1 for i in range(40)} <= want


def test_rare_passages_within_a_frequent_line_are_linked(spark):
    """Passages that lie almost wholly within a line of 60 texts, so that all their keys are in large groups, with
    edits of every kind; against brute force over all windows. Each edit is at words of its own pair."""
    r = random.Random(14)
    line = fresh_words(r, 44)
    docs = [(i, " ".join(fresh_words(r, 60) + line + fresh_words(r, 60))) for i in range(60)]
    for i in range(60):
        at = r.randrange(1, 14)
        p = fresh_words(r, at) + line + fresh_words(r, 14 - at)
        q = p if i < 20 else edited(r, p, [r.randrange(len(p))])
        docs += [(100 + 2 * i, " ".join(fresh_words(r, 60) + p + fresh_words(r, 60))), (101 + 2 * i, " ".join(fresh_words(r, 60) + q + fresh_words(r, 60)))]
    found = {i: windows(t) for i, t in docs}
    like = lambda a, b: any(len(x & y) >= S.LIKE * len(x | y) for x in found[a] for y in found[b])
    want = {a for a in range(101, 220, 2) if like(a, a - 1)}
    rows = {x.doc_id: x for x in S.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert want <= {i for i, x in rows.items() if x.links} and len(want) >= 40
    assert all(rows[i].class_id == rows[i - 1].class_id for i in want)
    assert not any(rows[i].links for i in range(60))


def test_every_shared_word_of_a_large_group_counts(spark):
    """40 texts have 60 words in common; pairs of them have more, each its own."""
    r = random.Random(15)
    passage, docs = fresh_words(r, 60), []
    for i in range(20):
        more = fresh_words(r, 12)
        docs += [(2 * i, " ".join(fresh_words(r, 30) + passage + more + fresh_words(r, 30))), (2 * i + 1, " ".join(fresh_words(r, 20) + passage + more + fresh_words(r, 40)))]
    rows = {x.doc_id: x for x in S.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {x.class_id for x in rows.values()} == {0}
    assert [rows[i].repeated_words for i in range(40)] == [0, 72] + [60, 72] * 19


def test_like_rows_join_what_all_pairs_join():
    g = np.random.default_rng(1)
    for _ in range(10):
        n, c = 60, S.NEAR
        near = g.integers(1, 2**32, (n, 2 * c + 1), dtype=np.uint64)
        m = int(g.integers(20, 40))
        at = c - int(g.integers(m))
        near[:, at : at + m] = near[0, at : at + m]
        for i in range(20):
            at, m = c - int(g.integers(c + 1)), int(g.integers(42, 52))
            near[20 + i, at : at + m] = near[i, at : at + m]
            near[40 + i] = near[i]
            at = int(g.choice([x for x in range(10, 80) if not x <= c < x + S.SHINGLE]))
            near[40 + i, at : at + S.SHINGLE] += np.uint64(1)
        left, right = (np.where(g.random(n) < 0.2, g.integers(0, c, n), c) for _ in range(2))
        for i in range(n):
            near[i, : c - left[i]] = near[i, c + right[i] + 1 :] = 0
        same = lambda a, b, i: i >= c - min(left[a], left[b]) and i <= min(right[a], right[b]) and (near[a, i : i + S.WIDTH] == near[b, i : i + S.WIDTH]).sum() >= S.WIDTH - S.SHINGLE
        want = {(a, b) for a in range(n) for b in range(a) if any(same(a, b, i) for i in range(c + 1))}
        a, b, _ = S.like_rows(np.zeros(n, np.int64), np.arange(n), near, left, right)
        assert set(zip(a.tolist(), b.tolist())) <= want
        assert parts(n, zip(a.tolist(), b.tolist())) == parts(n, want) and len(want) > 10


def parts(n, pairs):
    up = list(range(n))
    for x, y in pairs:
        lo, hi = sorted((up[x], up[y]))
        up = [lo if u == hi else u for u in up]
    return up


def refined(docs):
    """Rows that _refine() makes of texts in one task."""
    rows = pa.record_batch([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    signed = pa.Table.from_batches(list(S._sign(iter([rows])))).sort_by([("key", "ascending"), ("doc_id", "ascending"), ("places", "ascending")])
    open_ = {}
    for x in pa.Table.from_batches(list(S._meet(iter(signed.combine_chunks().to_batches())))).to_pylist():
        if x["rep"] == S._OPEN:
            open_.setdefault(x["doc_id"], []).append({"key": x["rep_places"], "places": x["places"], "hash": x["hash"]})
    kind = pa.list_(pa.struct([("key", pa.int64()), ("places", pa.int64()), ("hash", pa.int32())]))
    asked = pa.record_batch([pa.array(list(open_)), pa.array([dict(docs)[i] for i in open_]), pa.array(list(open_.values()), kind)], names=["doc_id", "text", "open"])
    around = pa.Table.from_batches(list(S._around(iter([asked])))).sort_by([("key", "ascending"), ("doc_id", "ascending"), ("place", "ascending")])
    return sum(b.num_rows for b in S._refine(iter(around.combine_chunks().to_batches())))


def test_texts_of_one_line_over_and_over_meet_by_few_rows(spark):
    """Every word of the line that an earlier text has counts, and hits that add no words go no further."""
    r = random.Random(16)
    runs = [r.randrange(60, 300) for _ in range(60)]
    docs = [(i, " ".join(fresh_words(r, 60) + ["over", "again"] * n + fresh_words(r, 60))) for i, n in enumerate(runs)]
    rows = {x.doc_id: x for x in S.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {x.class_id for x in rows.values()} == {0}
    assert [rows[i].repeated_words for i in range(60)] == [0] + [2 * n for n in runs[1:]]
    assert refined(docs) < 60 * 40


def test_needed_hits_cover_what_all_cover():
    g = np.random.default_rng(2)
    for _ in range(200):
        n = int(g.integers(1, 60))
        text, pair, lo = g.integers(0, 3, n), g.integers(0, 6, n), g.integers(0, 150, n)
        pair += 6 * text
        hi = lo + g.integers(0, 40, n)
        need = np.stack([lo - g.integers(0, 3, n) * (g.random(n) < 0.2), hi + g.integers(0, 3, n) * (g.random(n) < 0.2)])
        none = g.random(n) < 0.1
        lo[none], hi[none] = 0, -1
        keep = S.needed(text, pair, np.stack([lo, hi]), need)
        cover = lambda some, ends: {(t, x) for t, a, b in zip(text[some].tolist(), ends[0][some].tolist(), ends[1][some].tolist()) for x in range(a, b + 1)}
        assert cover(~keep, need) <= cover(keep, np.stack([lo, hi]))
        assert keep[none].all() and set(pair[~none].tolist()) == set(pair[keep & ~none].tolist())


def near_rows(g, n):
    """Rows of one large group: some begin or end near the middle, parts of them are alike."""
    c = S.NEAR
    near = g.integers(1, 2**32, (n, 2 * c + 1), dtype=np.uint64)
    near[:, c - 12 : c + 12] = near[0, c - 12 : c + 12]
    for i in range(0, n - 1, 2):
        at = c - int(g.integers(c))
        near[i + 1, at : at + 50] = near[i, at : at + 50]
    left, right = (np.where(g.random(n) < 0.1, g.integers(0, c, n), c) for _ in range(2))
    return near, left, right


def test_like_rows_sort_few_keys(monkeypatch):
    """Keys are made for what rows can have in common: under 250 a row; sorting for every window took 630 here."""
    g, sorted_, same = np.random.default_rng(8), [], S._same
    monkeypatch.setattr(S, "_same", lambda key, code: sorted_.append(len(key)) or same(key, code))
    near, left, right = near_rows(g, 2000)
    S.like_rows(np.zeros(2000, np.int64), np.arange(2000), near, left, right)
    assert sum(sorted_) < 250 * 2000


def test_forks_are_where_rows_first_differ():
    g = np.random.default_rng(3)
    near = g.integers(0, 2, (60, 2 * S.NEAR + 1), dtype=np.uint64)
    near[30:, 40:60], near[:, S.NEAR], group = near[0, 40:60], 1, g.integers(0, 3, 60)
    want = np.zeros(near.shape, bool)
    for a in range(60):
        for b in np.flatnonzero((group == group[a]) & (np.arange(60) != a)):
            for places in (range(S.NEAR, 2 * S.NEAR + 1), range(S.NEAR, -1, -1)):
                differ = [p for p in places if near[a, p] != near[b, p]]
                want[a, differ[:1]] = True
    assert (S._forks(group, near) == want).all()


def test_words_are_hashed_by_their_bytes():
    texts = [b"One two  one", b"", b" \t\x0b ", b"a" * 64 + b" " + b"A" * 65 + b"\x0c" + b"a" * 65, "É é ONE".encode()]
    h, n = S.hashed_words(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert n.tolist() == [len(t.split()) for t in texts]
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))
    assert [x.tolist() for x in S.hashed_words([])] == [[], []]


def test_pairs_verified_together_give_what_each_gives_alone(monkeypatch):
    """Against brute force over the windows of a hit's diagonal: a word counts if a shared shingle of like windows has it."""
    r, pairs = random.Random(17), []
    for i in range(60):
        p = fresh_words(r, r.randrange(40, 130))
        q = edited(r, p, r.sample(range(len(p)), r.randrange(3)))
        x, y = r.randrange(30), r.randrange(30)
        a, b = (" ".join(fresh_words(r, k) + z + fresh_words(r, r.randrange(30))).encode() for k, z in ((x, p), (y, q)))
        pairs.append((*(S.hashed_words([t])[0] for t in (a, b)), [(y - x + s, x, x + len(p)) for s in range(-2, 3)]))
    monkeypatch.setattr(S, "_VERIFIED", 700)
    got = S.verify(pairs)
    assert got == [S.verify([p])[0] for p in pairs]
    for (a, b, hits), found in zip(pairs, got):
        sa, sb, want = S._spans(a, S.SHINGLE).tolist(), S._spans(b, S.SHINGLE).tolist(), set()
        for diagonal, low, high in hits:
            for i in range(max(0, low - S.WIDTH, -diagonal), min(high, len(sa) - S.WIDTH, len(sb) - S.WIDTH - diagonal) + 1):
                x, y = sa[i : i + S.WIDTH], sb[i + diagonal : i + diagonal + S.WIDTH]
                if len(set(x) & set(y)) >= S.LIKE * len(set(x) | set(y)):
                    want |= {w for k, z in enumerate(x) if z in y for w in range(i + k, i + k + S.SHINGLE)}
        assert {w for lo, hi in zip(found[::2], found[1::2]) for w in range(lo, hi)} == want
    assert sum(map(bool, got)) > 30


def test_a_place_of_a_large_group_is_one_row_whatever_functions_have_it():
    """Asked for under all functions, a place gives one row, under one key in all texts; so do places of a range."""
    common = [f"c{i}" for i in range(120)]
    docs = [(i, " ".join([f"u{i}", *common])) for i in range(3)]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("places", pa.int64()), ("hash", pa.int32())]))
    open_ = []
    for _, text in docs:
        span = S._spans(S.hashed_words([text.encode()])[0], S.SHINGLE)
        open_.append([{"key": int(S.mix(span[p : p + 1] + S._salt(k)).view(np.int64)[0]), "places": p << 32 | p, "hash": k} for k in range(S.HASHES) for p in (60, 61)])
    asked = pa.record_batch([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs]), pa.array(open_, kind)], names=["doc_id", "text", "open"])
    rows = pa.Table.from_batches(list(S._around(iter([asked])))).to_pylist()
    assert sorted((r["doc_id"], r["place"]) for r in rows) == [(i, p) for i in range(3) for p in (60, 61)]
    assert len({r["key"] for r in rows}) == 2
