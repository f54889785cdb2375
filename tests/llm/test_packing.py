import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from docmill.llm import packing
from docmill.llm.tokens import ByteLevelTokenizer
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from .helpers import docs, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
FAST = ByteLevelTokenizer(PATH)
SLOW = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_tokenizers(text):
    assert FAST(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts():
    for text in ("", " " * 5000, "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|>" * 3, "é<|endoftext|>\n<|endo", "don't  \n\n\t", "日本語 é x", "a" * 9000):
        assert FAST(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_special_strings_can_stay_text():
    plain, by_library = ByteLevelTokenizer(PATH, plain_specials=True), Tokenizer.from_file(PATH)
    by_library.encode_special_tokens = True
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x"):
        assert plain(text).tolist() == by_library.encode(text, add_special_tokens=False).ids
        assert 50256 in FAST(text) and FAST(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


def cost(cuts, penalties, length):
    """Shorter powers of two are free at document ends (penalty 0) and at the very end."""
    sizes = np.diff([0, *cuts]).tolist()
    free = [n == length or ((n & (n - 1)) == 0 and (penalties[c] == 0 or c == cuts[-1])) for n, c in zip(sizes, cuts, strict=True)]
    return sum((0 if f else length - n) + penalties[c] + packing.SEQUENCE for f, n, c in zip(free, sizes, cuts, strict=True))


def test_plan_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        positions = np.unique(np.concatenate(([0], rng.integers(1, 40, 9))))
        penalties = rng.integers(0, 5, len(positions))
        length = 16
        if np.diff(positions).max() > length:
            continue
        pen = dict(zip(positions.tolist(), penalties.tolist(), strict=True))
        inner = positions[1:-1].tolist()
        choices = ([*chosen, int(positions[-1])] for k in range(len(inner) + 1) for chosen in itertools.combinations(inner, k))
        best = min(cost(cuts, pen, length) for cuts in choices if max(np.diff([0, *cuts])) <= length)
        got = packing.plan(positions, penalties, length)
        assert got[-1] == positions[-1] and cost(got, pen, length) == best


def check(rows, texts, length):
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts:
        ids = np.append(FAST(text or ""), np.uint32(0))
        at = 0
        for p in sorted(pieces[doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].astype("<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return fill


def test_every_id_in_one_piece_with_little_padding(spark):
    texts = [(i, " ".join(words(5 + 37 * i % 900, i)) + ("." if i % 3 else "")) for i in range(120)] + [(500, None), (501, ""), (502, "x" * 40_000 + " y"), (503, " ".join(words(9000, 9)))]
    rows = packing.pack(docs(spark, texts, clash=True).coalesce(1), PATH).collect()
    fill = check(rows, texts, 1024)
    sizes = [sum(n for _, n in parts) for parts in fill.values()]
    assert sum(1024 - n for n in sizes if n & (n - 1)) < 0.02 * sum(sizes)


def test_ids_of_sequences_are_the_stream_of_ids(spark):
    texts = [(i, " ".join(words(5 + 37 * i % 900, i)) + ".") for i in range(60)] + [(500, None), (502, "x" * 40_000 + " y")]
    rows = packing.pack(docs(spark, texts).coalesce(1), PATH, length=64).orderBy("sequence_id", "offset").collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert [t for r in rows for t in r.ids] == [t for _, text in texts for t in [*FAST(text or "").tolist(), 0]]


def test_plans_go_on_across_horizons():
    texts = [(i, " ".join(words(300, i)) + ".") for i in range(60)]
    p, out = packing._Packer(FAST.ends_sentence(), 64, 0), []
    for i, t in texts:
        p.add(i, np.append(FAST(t), np.uint32(0)))
        if p.held > 4000:
            out += p.flush(final=False)
    out += p.flush(final=True)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check([type("R", (), dict(zip(names, r, strict=True))) for r in out], texts, 64)


def test_null_ids_repeats_and_empty_table(spark):
    rows = packing.pack(docs(spark, [(None, "a b"), (1, "a b"), (1, "a b")]), PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3), ("1", 3), ("None", 3)]
    assert packing.pack(docs(spark, []), PATH).collect() == []
