"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = 51


def word(r):
    return "".join(r.choices("abcdefghijklm", k=6))


def corpus():
    r = random.Random(21)
    texts = [" ".join(word(r) for _ in range(r.randrange(40, 160))) for _ in range(120)]
    passage = " ".join(word(r) for _ in range(70))
    for i in range(0, 30):
        copy = texts[i].split()
        if i % 2:
            copy[r.randrange(len(copy))] = "edited"
        texts.append(" ".join(copy))
    for i in range(40, 50):
        texts[i] += " " + passage
    texts += [" ".join(word(r).upper() + "!!" for _ in range(60)) for _ in range(30)]
    texts += [" ".join([word(r) for _ in range(40)] + ["zvile", "zcruel", "zhateful"] * 4) for _ in range(30)]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)]
    labels = [(i, 0 if 150 <= i < 180 else 1, 1 if i >= 180 else 0) for i in range(len(texts)) if i % 3]
    return rows, labels


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows, labels = corpus()
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_run_keeps_what_it_should(spark, sf):
    rows, _ = corpus()
    out = corpus_pipeline.run(spark, sf).collect()
    assert all(r.round_trip for r in out)
    stages = {}
    docs = spark.read.parquet(sf + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        stages[name] = docs.collect()
    ids = {name: {r.doc_id for r in got} for name, got in stages.items()}
    assert ids["quality_classifier"] == set(range(150))
    shingles = lambda t: set(zip(*(t.split()[i:] for i in range(5))))
    sets = {i: shingles(t) for i, t, *_ in rows}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert ids["near_dedup"] == {i for i in range(150) if not any(like(i, j) for j in range(i))}
    kept = {r.doc_id: r for r in stages["substring_dedup"]}
    texts = {i: t for i, t, *_ in rows}
    for i, r in kept.items():
        assert r.n_chars == len(r.text)
        assert r.text == texts[i] if not 40 < i < 50 else r.text.split() == texts[i].split()[:-70]
    assert sorted((r.doc_id, r.n_tokens) for r in out) == sorted((r.doc_id, r.n_tokens) for r in stages["encode"])
    taken = sum(len(r.text.split()) for r in stages["mix_sources"])
    size = sum(len(r.text.split()) for r in kept.values())
    assert abs(taken - size) <= 3 * 160


def python_nodes(plan, found):
    """Python nodes of the last stage of a physical plan; found gets those of the stages before."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    children = plan.children()
    n = sum(python_nodes(children.apply(i), found) for i in range(children.size()))
    if "Exchange" in plan.nodeName():
        found.append(n)
        return 0
    return n + any(x in plan.nodeName() for x in ("Arrow", "Python", "Pandas"))


def test_no_task_has_two_python_workers(spark, sf, monkeypatch):
    """Spark uses idle workers in turn, so one stage with two of them a task doubles their memory for good."""
    found, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **more):
        plan = self._df._jdf.queryExecution().executedPlan()
        sizes = []
        sizes.append(python_nodes(plan, sizes))
        found[plan.toString()] = max(sizes)
        return write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    corpus_pipeline.run(spark, sf)
    assert sum(found.values()) >= 8
    assert not [plan for plan, n in found.items() if n > 1]


def test_rows_of_one_id_are_judged_one_by_one(spark, sf):
    rows = corpus()[0]
    good, bad = rows[0], rows[160]
    odd = [(good[0], bad[1], "en", "a", 1), (None, bad[1], None, None, None), (None, good[1] + " more", None, None, None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    out = corpus_pipeline.quality_classifier(spark, docs, sf)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert (good[0], good[1]) in kept and (None, good[1] + " more") in kept and bad[1] not in [t for _, t in kept]
    first = out.filter(F.col("text").startswith(good[1][:40]))
    assert first.count() >= 2 and [r.doc_id for r in corpus_pipeline.near_dedup(spark, first, sf).collect()] == [good[0]]


def test_stages_stand_odd_rows_and_names(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x " * 30_000, None, None, 60_000), (3, " \n", "en", "a", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "row_number", "rep", "kept", "site_host", "host", "label_id", "copy", "component", "u", "size"):
        docs = docs.withColumn(c, F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "encode":
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert out.count() >= 1
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert np.isfinite(corpus_pipeline.near_dedup(spark, docs, sf).count())


def test_passages_within_a_frequent_line_stay_once(spark, sf):
    """The least passages that hold a line of 60 texts, so that all their keys are in large groups."""
    r = random.Random(22)
    line = [word(r) for _ in range(44)]
    around = lambda p: [word(r) for _ in range(60)] + p + [word(r) for _ in range(60)]
    rows = [(i, " ".join(around(line)), "en", "a", None) for i in range(60)]
    for i in range(60):
        at = r.randrange(1, 14)
        p = [word(r) for _ in range(at)] + line + [word(r) for _ in range(14 - at)]
        rows += [(100 + 2 * i, " ".join(around(p)), "en", "a", None), (101 + 2 * i, " ".join(around(p)), "en", "a", None)]
    out = {x.doc_id: x.text for x in corpus_pipeline.substring_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    for i, text, *_ in rows:
        words = text.split()
        assert out[i].split() == (words[:60] + words[-60:] if i > 100 and i % 2 else words)
