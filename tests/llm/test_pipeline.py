import re

import corpus_pipeline as cp
import pytest
from docmill.llm.pii import Pseudonymiser

from .helpers import docs
from .test_near_dedup import brute
from .test_packing import FAST, check
from .test_quality import junk, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    labels = [(i, int(i % 4 != 0), 0) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


ROWS = [(i, junk(i) if i % 4 == 0 else prose(i)) for i in range(400)] + [(1001, prose(1) + " Mail bo.42@mail8.example.com now."), (1002, prose(2)), (1003, None), (1004, ""), (1005, "q " * 40_000), (None, prose(77777)), (1006, prose(3)), (1006, prose(3))]


def test_stages_hold_their_order_and_columns(spark, folder):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "pii", "packing"] and cp.ORACLE_SQL is None
    d = docs(spark, ROWS, clash=True)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, d, folder).columns == COLUMNS


def test_quality_drops_junk_and_keeps_prose(spark, folder):
    kept = {r.doc_id for r in cp.keep_good(spark, docs(spark, ROWS[:400]), folder).collect()}
    assert len(kept & {i for i in range(400) if i % 4 == 0}) <= 3 and len(kept) >= 297


def test_near_copies_leave_one(spark, folder):
    got = sorted(str(r.doc_id) for r in cp.keep_one_of_near_copies(spark, docs(spark, ROWS), folder).collect())
    components = brute([r for r in dict(ROWS).items() if r[0] is not None], 5)
    want = [str(i) for i, _ in ROWS if i is None or components[i][1] == i]
    assert got == sorted(want)


def test_private_data_goes(spark, folder):
    spark.conf.set("spark.docmill.pii.secretKey", "of the test")
    out = {r.doc_id: r for r in cp.hide_private_data(spark, docs(spark, ROWS), folder).collect()}
    spark.conf.unset("spark.docmill.pii.secretKey")
    change = Pseudonymiser(b"of the test")
    for i, t in ROWS:
        assert out[i].text == (None if t is None else change(t)[0])
    assert not re.search("bo.42@mail8", out[1001].text)


def test_packing_is_exact(spark, folder):
    rows = cp.pack_sequences(spark, docs(spark, [r for r in ROWS if r[0] != 1006]), folder).collect()
    check(rows, [r for r in ROWS if r[0] != 1006], 1024)


def test_packed_sequences_carry_their_ids(spark, folder):
    text = prose(5)
    rows = cp.pack_sequences(spark, docs(spark, [(1, text), (2, None)]).coalesce(1), folder).orderBy("sequence_id", "offset").collect()
    assert [t for r in rows for t in r.ids] == [*FAST(text).tolist(), 0, 0]


def test_empty_documents(spark, folder):
    d = docs(spark, [])
    for _, stage in cp.STAGES:
        assert stage(spark, d, folder).collect() == []
