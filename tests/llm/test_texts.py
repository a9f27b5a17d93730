"""BPE, GIF, language, chat and mixing operators on small and odd inputs."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealframe.llm import bpe, chat, gif, langid, mixing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


def odd_texts(n=400):
    r = random.Random(1)
    out = ["", "a<|endoftext|>b<|endoftext|>", "  \n\t x\x1c\x85z", "x" * 4000, "½²Ⅷ٣ 漢字 🎉", "I'll 's 't   end  "]
    for _ in range(n):
        points = (r.choice([r.randrange(32, 127), r.randrange(0, 0x3000), r.randrange(0x10000, 0x1F9FF), 32, 10]) for _ in range(50))
        out.append("".join(chr(p) for p in points if not 0xD800 <= p <= 0xDFFF))
    return out


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = odd_texts()
    df = spark.createDataFrame([*enumerate(texts), (None, None)], DOCS).withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(df.drop("ids"), PATH), PATH).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = library.encode(texts[r.doc_id] if r.doc_id is not None else "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_pieces_of_ascii_and_of_long_texts(monkeypatch):
    """Texts of ASCII and others, listed and streamed, give the library's ids."""
    from tokenizers import Tokenizer

    with open(PATH, encoding="utf-8") as f:
        tok = bpe.Tokenizer(f.read())
    library, r = Tokenizer.from_file(PATH), random.Random(2)
    texts = ["".join(r.choices([*map(chr, range(128)), *" \n\t'sdlremtv" * 8], k=60)) + end for end in ("", "\x85", " é") for _ in range(200)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [tok.encode(t) for t in texts] == want
    monkeypatch.setattr(bpe, "LISTED", 10)
    assert [tok.encode(t) for t in texts] == want


def test_bpe_rejects_unknown_ids():
    with open(PATH, encoding="utf-8") as f:
        tok = bpe.Tokenizer(f.read())
    with pytest.raises(ValueError):
        tok.decode(np.array([10**6], "<u4").tobytes())


def test_bpe_file_settings(spark):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for key, value in {"normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}.items():
        with pytest.raises(ValueError, match=key):
            bpe.check({**spec, key: value})
    with pytest.raises(ValueError, match="model"):
        bpe.check({**spec, "model": {**spec["model"], "ignore_merges": True}})
    empty = spark.createDataFrame([], DOCS)
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def plain_lzw(data, min_size):
    """Samples of a code stream by the textbook's table of strings."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    bits, have, feed, out = 0, 0, iter(data), b""
    table, size, last = {}, min_size + 1, None
    while True:
        while have < size:
            bits |= next(feed) << have
            have += 8
        code, bits, have = bits & ((1 << size) - 1), bits >> size, have - size
        if code == clear:
            table, size, last = {i: bytes([i]) for i in range(clear)}, min_size + 1, None
            continue
        if code == end:
            return out
        entry = table[code] if code in table else last + last[:1]
        out += entry
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = last + entry[:1]
            if len(table) + 2 == 1 << size and size < 12:
                size += 1
        last = entry


def test_encoder_makes_lzw_strings():
    r = random.Random(4)
    for n in (1, 2, 300, 60_000):
        for letters in (b"a", b"ab", bytes(range(256))):
            samples = bytes(r.choices(letters, k=n))
            stream = gif.lzw_stream(samples)
            assert plain_lzw(stream, 8) == samples == gif.lzw(stream, 8, n).tobytes()
    assert len(gif.encode(b"ab" * 96 * 100)) < 192 * 100 / 10


def test_gif_frames_of_the_store(spark):
    assert gif.read_back(gif.store_texts(spark.createDataFrame([], DOCS))).count() == 0
    assert gif.frames(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0
    size, frames = gif.decode(gif.encode(b"xy" * 96 * 5000))
    assert [f.disposal for f in frames] == [1, 2, 3] and all(f.transparent == 0 for f in frames)


def test_gif_round_trip(spark):
    texts = [*odd_texts(30), "word " * 100_000]
    df = spark.createDataFrame([*enumerate(texts), (None, None)], DOCS).withColumn("media", F.lit(1))
    rows = gif.read_back(gif.store_texts(df)).collect()
    for r in rows:
        raw = (texts[r.doc_id] if r.doc_id is not None else "").encode()
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert bytes(r.payload) == want and r.n_bytes == len(raw)
    frames = gif.frames(gif.store_texts(df)).filter(F.col("doc_id") == len(texts) - 1).orderBy("frame").collect()
    assert len(frames) == 2 and [f.start_ms for f in frames] == [0, 100] and sum(frames[0].red) == frames[0].width * frames[0].height


def lzw_encode(samples, min_size):
    """Plain LZW encoder with growing codes, for the decoder's test."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    table, size, bits, have, out = {bytes([i]): i for i in range(clear)}, min_size + 1, 0, 0, bytearray()

    def put(code):
        nonlocal bits, have
        bits |= code << have
        have += size
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    put(clear)
    word, following = b"", end + 1
    for s in samples:
        longer = word + bytes([s])
        if longer in table:
            word = longer
            continue
        put(table[word])
        if following < 4096:
            table[longer] = following
            following += 1
            if following > 1 << size and size < 12:
                size += 1
        else:
            put(clear)
            table, size, following = {bytes([i]): i for i in range(clear)}, min_size + 1, end + 1
        word = bytes([s])
    put(table[word])
    put(end)
    out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("min_size", [2, 5, 8])
def test_lzw_with_growing_codes(min_size):
    g = np.random.default_rng(min_size)
    samples = np.repeat(g.integers(0, 1 << min_size, 9000), g.integers(1, 5, 9000)).astype(np.uint8)
    assert (gif.lzw(lzw_encode(samples.tolist(), min_size), min_size, len(samples)) == samples).all()
    with pytest.raises(ValueError):
        gif.lzw(lzw_encode(samples[:100].tolist(), min_size), min_size, 9000)


def make_gif(frames, size=(2, 2)):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for samples, (x, y, w, h), disposal, transparent, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), 5, transparent or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 if interlaced else 0) + b"\x02" + gif._sub_blocks(lzw_encode(samples, 2))
    return out + b"\x3b"


def test_disposal_transparency_and_interlace():
    data = make_gif([([1, 1, 1, 1], (0, 0, 2, 2), 1, None, False), ([2, 3], (0, 0, 2, 1), 3, 3, False), ([0], (1, 1, 1, 1), 2, 3, False), ([3, 2], (0, 0, 1, 2), 0, None, False)])
    size, frames = gif.decode(data)
    shown = [c.copy() for c in gif.render(size, frames)]
    red, green, blue, black = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert shown[0].tolist() == [[red, red], [red, red]]
    assert shown[1].tolist() == [[green, red], [red, red]]
    assert shown[2].tolist() == [[red, red], [red, black]]
    assert shown[3].tolist() == [[blue, red], [green, black]]
    assert [f.delay_ms for f in frames] == [50] * 4
    _, (f,) = gif.decode(make_gif([([0, 1, 2, 3, 0, 1, 2, 3, 0, 1], (0, 0, 1, 10), 0, None, True)], (1, 10)))
    assert f.indices[:, 0].tolist() == [0, 1, 3, 2, 2, 3, 0, 0, 1, 1]


def test_damaged_gifs():
    good = gif.encode(b"a" * 192)
    for bad in (b"", b"GIF", good[:40], good[:-30], b"PNG" + good):
        with pytest.raises(ValueError):
            gif.decode(bad)


def sentences(lang, r):
    words = {"aa": ["kala", "mato", "sula", "pika"], "bb": ["strength", "growth", "prompt", "church"], "cc": ["öljy", "työ", "yö", "äiti"]}[lang]
    return " ".join(r.choice(words) for _ in range(r.randrange(3, 30)))


def test_language(spark):
    r = random.Random(3)
    rows = [(i, sentences(lang, r), lang) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(900, None, "aa"), (901, "12 !? ", "bb"), (902, "kala mato", None), (None, "growth", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(0))
    got = {x.doc_id: x for x in langid.identify(df, F.col("doc_id") % 4 != 2).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert sum(got[i].lang_pred == lang for i, _, lang in rows[:240]) >= 236 and all(0 <= x.score <= 1 for x in got.values())
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0
    assert {x.lang_pred for x in langid.identify(df, F.lit(False)).collect()} == {"und"}


def test_letters_decide_what_is_undetermined():
    assert not len(langid.grams("½² ⅷ ①٣ 12 \u0301")) and not len(langid.grams(None))
    assert len(langid.grams("a\u0301")) == len(langid.grams("ab"))


def test_all_rows_as_landmarks_equal_exact_kernel_ridge():
    """With every text a landmark, the map is exact: compare with ridge regression in the kernel itself."""
    r = random.Random(9)
    labels = [["aa", "bb", "cc"][i % 3] for i in range(60)]
    texts = [sentences(x, r) for x in labels]
    model = langid.fit(texts, labels, landmarks=60)
    sets = [set(langid.grams(t).tolist()) for t in texts]
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    y = np.array([[1.0 if t == n else -1.0 for n in ("aa", "bb", "cc")] for t in labels])
    # min sum (k w + b - y)^2 + ridge w' k w, with a nearly free b
    n = len(texts)
    top = np.hstack([k @ k + langid.RIDGE * k + 1e-9 * np.eye(n), k.sum(axis=0)[:, None]])
    solved = np.linalg.lstsq(np.vstack([top, np.append(k.sum(axis=0), n + 1e-6)]), np.vstack([k @ y, y.sum(axis=0)]), rcond=None)[0]
    want = k @ solved[:-1] + solved[-1]
    got = model.kernel([langid.grams(t) for t in texts], model.landmarks.astype(np.float32)) @ model.weights + model.bias
    assert np.allclose(got, want, atol=2e-2) and (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 3)
    r = random.Random(5)
    odd = ["", "<|im_end|>", "<|im_sep|>x", "\\", "<\\|", "<", "|im_end|>\n", "a\nb", "<|", "\\<|\\", None, "<\\\\|", "é🎉"]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "a\nb<|", None]), r.choice(odd) if r.random() < 0.8 else r.choice(odd[:5]) + r.choice(odd[5:9])) for c in [*range(60), None] for t in range(r.randrange(1, 9))]
    rows += [(7, 2, "assistant", "twice"), (7, 2, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    out = chat.format_conversations(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(out) == 61
    for x in out:
        want = sorted((t, role or "", text or "") for c, t, role, text in rows if c == x.conv_id)
        assert [(t.role, t.text) for t in x.turns] == [w[1:] for w in want]
        assert x.loss == "".join(t for _, role, t in want if role == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_adjacent_turns_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), ["a", "b", "c", "d", None][min(4, int(r.expovariate(0.8)))]) for i in range(3000)]
    rows += [(5000, None, "a"), (None, "x y", "b"), (None, "x y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(0)).withColumn("target", F.lit(0))
    out = mixing.mix(df, F.col("rank") % 3 + 1).collect()
    again = mixing.mix(df.repartition(7), F.col("rank") % 3 + 1).collect()
    key = lambda x: (str(x.doc_id), x.size, x.taken)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    targets = {x.source: (x.target, x.source_size) for x in out}
    assert sum(t for t, _ in targets.values()) == pytest.approx(sum(s for _, s in targets.values()))
    for s, (target, size) in targets.items():
        taken = sum(x.taken for x in out if x.source == s)
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 40
    assert all(x.taken <= 3 * x.size for x in out)
    below = {s: t / w for w, s in zip([1, 2, 3, 1, 2], ["a", "b", "c", "d", None]) for t in [targets[s][0]] if t < 3 * targets[s][1] - 1e-6}
    assert max(below.values()) == pytest.approx(min(below.values()))
    assert mixing.mix(df.limit(0), F.lit(1)).count() == 0
    kept = mixing.mix(df.withColumn("row", F.lit(1)).withColumn("kept", F.lit(2)), F.lit(1), keep=("text", "row", "kept", "source"))
    assert kept.select("kept.*").columns == ["text", "row", "kept", "source"] and kept.count() == len(rows)
    assert mixing.mix(df, F.lit(1), keep=("text",)).filter("size <> 0 and kept.text is null").count() == 0


def test_quality_weights_come_earlier(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("s").alias("source"))
    q = df.select("doc_id", (F.col("doc_id") % 2 * 9 + 1).alias("quality"))
    odd = q.limit(0).unionByName(spark.createDataFrame([(1, None), (1, 10.0), (None, 5.0), (3, -1.0)], "doc_id long, quality double"))
    out = mixing.mix(df, F.lit(1), qualities=q.filter("doc_id > 3").unionByName(odd), budget=F.lit(1000))
    share = out.filter("copies > 0").agg(F.avg(F.col("doc_id") % 2)).first()[0]
    assert out.agg(F.sum("taken")).first()[0] == 1000 and share > 0.8


