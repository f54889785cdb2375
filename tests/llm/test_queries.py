"""Every registered query of the corpus operators, over one folder of small tables, against brute force."""

import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from docmill.llm import queries

from .helpers import docs, words
from .test_chat import ROWS as CONVERSATION
from .test_chat import expected
from .test_near_dedup import brute
from .test_packing import check
from .test_quality import junk, prose
from .test_url_rules import URLS
from .test_url_rules import brute as judged
from .test_vectors import clustered

TEXTS = [(i, junk(i) if i % 5 == 0 else prose(i)) for i in range(150)] + [(200 + i, prose(i) + f" Mail bo.{i}@mail.example.com now.") for i in range(5)] + [(300, None), (301, ""), (302, "one"), (303, "<|endoftext|> a  b")]
VECTORS = clustered(400, 8, 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('all')}"
    docs(spark, TEXTS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, _ in TEXTS if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(VECTORS)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame(SAID, CONVERSATION).write.parquet(f"{at}/conversations.parquet")
    return at


SAID = [(c, t, "assistant" if t % 2 else "user", None if t == 3 else f"turn {t} <s> of {c}") for c in range(6) for t in range(c + 1)]


def test_op1(spark, folder):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_near_dedup(spark, folder).collect()}
    assert got == brute(TEXTS, 2)


def test_op2(spark, folder):
    check(queries.op2_pack(spark, folder).collect(), TEXTS, 1024)


def test_op3(spark, folder):
    got = queries.op3_url_filter(spark, folder).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judged(u) for u in URLS]


def test_op4_and_op9(spark, folder):
    x, fine = VECTORS.astype(np.float64), np.floor(1024 * VECTORS.astype(np.float64)).astype(np.int64)
    near, exact = queries.op4_ann_search(spark, folder).collect(), queries.op9_top_k(spark, folder).collect()
    assert len(near) == 20 * 20 and len(exact) == 4 * 10
    for rows, v, k in ((near, x, 20), (exact, fine, 10)):
        for q in {r.query_id for r in rows}:
            s = v @ v[q]
            want = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:k]
            assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_op5(spark, folder):
    rows = queries.op5_quality(spark, folder).collect()
    assert {(r.doc_id, r.held_out) for r in rows} == {(i, zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in TEXTS}
    right = [r.predicted == (r.doc_id % 5 != 0) for r in rows if r.held_out and r.doc_id < 150]
    assert sum(right) >= 0.95 * len(right) and all(r.score == 0 for r in rows if r.doc_id in (300, 301))


def test_op6_decodes_to_what_the_library_decodes(spark, folder):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.op6_nbest_segment(spark, folder).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in TEXTS}
    for r in rows:
        text = dict(TEXTS)[r.doc_id] or ""
        assert sp.decode(list(r.ids)) == text and r.decoded_crc32 == zlib.crc32(text.encode())


def test_op10(spark, folder):
    control = "</s>[INST] ok [/INST]"
    got = queries.op10_chat_format(spark, folder).collect()
    want = expected([*SAID, (-7, 0, "user", control), (-7, 1, "assistant", control)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == want


def test_pipeline_run_packs_what_every_stage_keeps(spark, folder):
    spark.conf.set("spark.docmill.pii.secretKey", "of the test")
    rows = cp.run(spark, folder).collect()
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, folder).cache()
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    spark.conf.unset("spark.docmill.pii.secretKey")
    check(rows, texts, 1024)
    ids = {i for i, _ in texts}
    assert len(ids) >= 110 and not ids & {300, 301} and sum(i % 5 == 0 for i in ids if i < 150) <= 2
    assert not any("@mail.example" in t for _, t in texts)
