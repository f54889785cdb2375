import itertools
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from docmill.llm import pieces
from hypothesis import given, settings
from hypothesis import strategies as st

from .helpers import docs, words

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.lattice(PATH)


def every(word):
    """All segmentations of a word, best first."""
    out = []

    def go(i, score, ids):
        if i == len(word):
            out.append((score, tuple(ids)))
        else:
            for j, e, s in MODEL.edges(word, i):
                go(j, score + s, [*ids, *e])

    go(0, 0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("word", ["▁hello", "▁", "▁Thonanti", "▁日本é", "▁a.b,c", "x", "▁aaaaaaa"])
def test_n_best_of_a_word_is_exact(word):
    want = every(word)
    got = MODEL.n_best(word, 6)
    assert [s for s, _ in got] == [s for s, _ in want[:6]] and all(x in want for x in got) and len(set(got)) == len(got)
    best, gap, ids, size = MODEL.viterbi(word)
    assert best == want[0][0] and (best, ids) in want
    assert gap == (want[0][0] - want[1][0] if len(want) > 1 else -pieces.NONE)
    assert size == len(word.encode()) - 2 or not word.startswith("▁")


def test_n_best_of_a_text_is_exact():
    text = "He is  on the\n hill"
    sums = sorted((sum(s for s, _ in c) for c in itertools.product(*(MODEL.n_best(pieces.SPACE + w, 5) for w in MODEL.words(text)))), reverse=True)
    got = MODEL.encode(text, 5)
    assert [s for s, _, _ in got] == sums[:5]
    assert len({tuple(ids) for _, ids, _ in got}) == 5


@pytest.fixture(scope="module")
def all_pieces():
    """Ids and scores of all pieces of the file, runs of space marks too."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    usable.sort(key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): (i, -round(math.log(r + pieces.SHIFT) * pieces.UNIT)) for r, i in enumerate(usable)}


@pytest.mark.parametrize("text", ["a  b", "a   b", "a    b", "  if x", "x\n    y", "a ", "   ", " ", "a" + " " * 9 + "b", "▁▁ a  "])
def test_n_best_of_texts_with_runs_of_spaces_is_that_of_all_pieces(text, all_pieces):
    marked, ways = pieces.SPACE + text.replace(" ", pieces.SPACE), []

    def go(i, score, ids):
        if i == len(marked):
            ways.append((score, tuple(ids)))
        for j in range(i + 1, len(marked) + 1):
            if (found := all_pieces.get(marked[i:j])) is not None:
                go(j, score + found[1], [*ids, found[0]])
        if i < len(marked) and marked[i] == "\n":
            go(i + 1, score + MODEL.byte_score, [*ids, MODEL.byte[10]])

    go(0, 0, [])
    ways.sort(key=lambda x: -x[0])
    got = MODEL.encode(text, 4)
    assert [s for s, _, _ in got] == [s for s, _ in ways[:4]]
    assert all((s, tuple(ids.tolist())) in ways for s, ids, _ in got)
    assert {b"".join(slices) for _, _, slices in got} == {marked.replace(pieces.SPACE, " ").encode()}


def test_best_segmentation_of_most_words_is_the_processors(all_pieces):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = "The committee has not yet decided whether the new regulations about energy markets should apply to small companies in the northern regions or only to larger ones".split()
    assert sum(MODEL.encode(w, 1)[0][1].tolist() == sp.encode(w) for w in text) >= 0.9 * len(text)


def test_long_runs_of_spaces_are_quick():
    text = "a" + " " * 20_000 + "b"
    got = MODEL.encode(text, 4)
    assert len({tuple(ids.tolist()) for _, ids, _ in got}) == 4 and all(b"".join(s) == b" " + text.encode() for _, _, s in got)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters="▁"), max_size=40))
def test_round_trip(text):
    for _, ids, slices in MODEL.encode(text, 3):
        whole = MODEL.decode(ids)
        assert b"".join(slices) == whole
        assert whole[1:].decode() == text if text else whole == b""


def test_rows_of_null_empty_repeated_and_long_texts(spark):
    long_text = " ".join(words(20_000, 1)) + "y" * 3000
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, long_text), (5, "x▁y")]
    out = pieces.segment(docs(spark, rows, clash=True), PATH, n=3).collect()
    of = {}
    for r in out:
        of.setdefault(r.doc_id, []).append(r)
    assert [(r["rank"], r.n_ids, r.score, r.decoded_crc32) for r in of[1] + of[2]] == [(1, 0, 0.0, 0)] * 2
    assert sorted(r["rank"] for r in of[3]) == [1, 1, 2, 2, 3, 3] and len(of[None]) >= 1
    assert {r.decoded_crc32 for r in of[4]} == {zlib.crc32(long_text.encode())} and {r.decoded_crc32 for r in of[5]} == {zlib.crc32(b"x y")}
    assert pieces.segment(docs(spark, []), PATH).collect() == []


def test_ids_and_text_leave_and_ids_decode(spark):
    rows = [(1, None), (2, ""), (3, "a  b"), (4, "x▁y 日本é\n"), (5, " ".join(words(3000, 2)))]
    found = pieces.segment(docs(spark, rows, clash=True), PATH, n=3)
    out = found.collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4, 5}
    for r in out:
        want = (dict(rows)[r.doc_id] or "").replace("▁", " ")
        assert r.text == (want if r["rank"] == 1 else None) and MODEL.decode(np.array(r.ids, np.uint32))[1:].decode() == want and r.decoded_crc32 == zlib.crc32(want.encode())
        assert len(r.ids) == r.n_ids and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    decoded = pieces.decode(found.select("doc_id", "rank", "ids"), PATH).collect()
    assert {(r.doc_id, r["rank"]): r.text for r in decoded} == {(r.doc_id, r["rank"]): (dict(rows)[r.doc_id] or "").replace("▁", " ") for r in out}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [MODEL.byte[0xE6]]), (4, [None])], "k int, ids array<int>")
    assert [r.text for r in pieces.decode(odd, PATH).orderBy("k").collect()] == [None, "", "\ufffd", None]


def test_words_beyond_the_bound_are_the_same(monkeypatch):
    texts = [" ".join(words(300, n, 5000)) for n in range(6)] + ["é  x", "", " "]
    want = [MODEL.encode(t, 3) for t in texts]
    small = pieces.PieceLattice(PATH)
    monkeypatch.setattr(pieces, "REMEMBERED", 100)
    for _ in range(2):
        for t, w in zip(texts, want, strict=True):
            got = small.encode(t, 3)
            assert [(s, ids.tolist(), b"".join(x)) for s, ids, x in got] == [(s, ids.tolist(), b"".join(x)) for s, ids, x in w]
    assert small.rows.n == len(small.known) == 100


def random_words(n, seed, most=20):
    r = random.Random(seed)
    drawn = ("".join(r.choice("etaoinshrdlu" * 4 + "E.,'7\n\x00éß日本語\U0001f600") for _ in range(r.randint(0, most))) for _ in range(n))
    return [pieces.SPACE * r.choice((1, 1, 1, 2, 5)) + w for w in drawn]


@pytest.mark.parametrize("most", [20, 2 * pieces.LONG])
def test_words_together_are_as_one_by_one(most):
    words_ = [*random_words(4000, most, most), "▁", "▁" * pieces.LONG, "▁" + "y" * pieces.LONG, "▁" + "e" * (pieces.LONG - 1)]
    for some in (words_, words_[:3], words_[-2:]):
        (scores, gaps, lengths, sizes), ids = MODEL.best_of(some)
        ids = np.split(ids, np.cumsum(sizes)[:-1])
        assert [(*x[:2], tuple(x[2].tolist()), x[3]) for x in zip(scores, gaps, ids, lengths, strict=True)] == [MODEL.viterbi(w) for w in some]


@pytest.mark.parametrize("remembered, chunk", [(10**6, 10**6), (150, 300), (0, 1)])
def test_many_texts_are_as_one_by_one(monkeypatch, remembered, chunk):
    texts = ["", *(" ".join(w.lstrip(pieces.SPACE) for w in random_words(150, seed)) for seed in (1, 2, 1, 3)), " ", ""]
    one, many = pieces.PieceLattice(PATH), pieces.PieceLattice(PATH)
    want = [[(s, ids.tolist(), b"".join(x)) for s, ids, x in one.encode(t, 3)] for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", remembered)
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    for _ in range(2):
        assert [[(s, ids.tolist(), b"".join(x)) for s, ids, x in found] for found in many.encode_all(iter(texts), 3)] == want
    assert many.rows.n == len(many.known) == min(remembered, len(one.known))


def test_new_words_of_many_texts_take_less_than_one_by_one():
    model, new = pieces.PieceLattice(PATH), list(dict.fromkeys(w.lstrip(pieces.SPACE) for w in random_words(40_000, 4)))
    texts = [" ".join(new[i : i + 40]) for i in range(0, len(new), 40)]
    began = time.process_time()
    for w in new:
        model.viterbi(pieces.SPACE + w)
    alone = time.process_time() - began
    began = time.process_time()
    assert len(list(model.encode_all(texts, 1))) == len(texts)
    assert time.process_time() - began < 0.8 * alone
