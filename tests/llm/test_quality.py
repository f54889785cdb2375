import random
import zlib

import numpy as np
from docmill.llm import quality

from .helpers import docs, words


def prose(seed):
    r = random.Random(seed)
    return " ".join((" ".join(words(r.randrange(5, 14), seed * 100 + k, 5000)).capitalize() + ".") for k in range(r.randrange(3, 12)))


def junk(seed):
    kind = seed % 3
    w = words(80, seed)
    return " ".join(x.upper() + "!!" for x in w) if kind == 0 else " | ".join(w) if kind == 1 else " ".join(w[:1] * 40 + w[1:2] * 40)


def test_held_out_accuracy_and_fold(spark):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 600)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs(spark, rows, clash=True), labels).collect()
    assert len(out) == 600
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)


def test_held_out_labels_change_nothing(spark):
    rows = [(i, junk(i) if i % 3 == 0 else prose(i)) for i in range(120)]
    d = docs(spark, rows)
    true = [(i, int(i % 3 != 0)) for i in range(120)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in true]
    a, b = (quality.classify(d, spark.createDataFrame(x, "doc_id long, quality int")) for x in (true, flipped))
    assert sorted(a.collect()) == sorted(b.collect())


def test_nulls_empties_repeats_long_texts_and_no_labels(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "x" * 200_000)]
    some = spark.createDataFrame([(9, None), (None, 1), (2, 1)], "doc_id long, quality int")
    out = quality.classify(docs(spark, rows), some).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    none = quality.classify(docs(spark, rows), some.limit(0)).collect()
    assert {(r.doc_id, r.score, r.predicted) for r in none} == {(1, 0.0, 0), (2, 0.0, 0), (None, 0.5, 1), (3, 0.5, 1)}
    assert quality.classify(docs(spark, []), some).collect() == []


def test_votes_are_those_of_exact_neighbours():
    r = np.random.default_rng(2)
    rows = r.random((60, quality.TERMS)).astype(np.float32)
    labels = r.integers(0, 2, 60).astype(float)
    m = quality.fit_rows(rows, labels)
    asked = r.random((5, quality.TERMS)).astype(np.float32)
    for q, s in zip(m.latent(asked), m.scores(asked), strict=True):
        cos = m.neighbours @ q
        near = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = np.maximum(cos[near], 1e-3).astype(float) ** quality.POWER
        assert abs(s - (w * labels[near]).sum() / w.sum()) < 1e-6
