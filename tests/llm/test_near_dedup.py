import random

import numpy as np
import pytest
from docmill.llm import near_dedup as nd

from .helpers import docs, split_words, words


def shingles(text, size):
    w = split_words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_matches_brute_force(spark, size):
    r = random.Random(size)
    rows = []
    for g in range(12):
        base = words(60 + 20 * g, g)
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(8)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, "One  word"), (901, "one\tWORD"), (902, "single"), (903, "SINGLE"), (904, "É"), (905, "é")]
    got = result(nd.near_duplicates(docs(spark, rows), words=size))
    assert got == brute(rows, size)
    assert any(i != c for i, (_, c) in got.items())


def test_large_group_of_near_copies_is_one_component(spark):
    base = words(80, 1)
    rows = [(i, " ".join([*base[:40], f"v{i}", *base[41:]])) for i in range(300)]
    assert {c for _, c in result(nd.near_duplicates(docs(spark, rows), words=2)).values()} == {0}


def test_chain_is_followed(spark):
    w, rows = words(100, 3), []
    for i in range(12):
        rows.append((i, " ".join(w)))
        w = [*w[5:], *(f"c{i}-{k}" for k in range(5))]
    assert result(nd.near_duplicates(docs(spark, rows), words=2)) == brute(rows, 2)


def test_nulls_empties_repeats_and_clashing_columns(spark):
    long_text = " ".join(words(30_000, 5, 10**6))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "same text here"), (6, long_text), (7, long_text + " end")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs(spark, rows, clash=True), words=2).collect()), key=str)
    n = len(shingles(long_text, 2))
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (None, 2, None, True), (6, n, 6, True), (7, n + 1, 6, False)], key=str)


def test_empty_table(spark):
    assert nd.near_duplicates(docs(spark, [])).collect() == []


def test_whole_set_parity_never_exceeds_the_difference():
    r = np.random.default_rng(0)
    for n in (3, 200, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, n // 3).astype(np.uint64)]))
        flips = int(np.bitwise_count((nd.set_parity(a) ^ nd.set_parity(b)).view(np.uint64)).sum())
        assert flips <= len(np.setxor1d(a, b))


def test_sampled_sketch_keeps_pairs_at_the_threshold():
    r = np.random.default_rng(1)
    bound = nd.most_flips(0.8)
    for _ in range(200):
        shared, own = r.integers(0, 2**63, 800).astype(np.uint64), r.integers(0, 2**63, 200).astype(np.uint64)
        a, b = np.concatenate([shared, own[:100]]), np.concatenate([shared, own[100:]])
        s = nd.odd_sketches(np.array([nd.minhashes(a), nd.minhashes(b)]))
        assert int(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum()) <= bound


def test_split_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nd, "SPLIT", 2)
    r, rows = random.Random(9), []
    base = words(90, 12)
    for i in range(60):  # each a near copy of an earlier one, so that components meet late
        w = rows[r.randrange(len(rows))][1].split() if rows else list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = f"y{r.randrange(999)}"
        rows.append((i, " ".join(w)))
    assert result(nd.near_duplicates(docs(spark, rows), words=2)) == brute(rows, 2)
