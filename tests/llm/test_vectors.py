import itertools

import numpy as np
import pytest
from docmill.llm import bitsliced, multi_index

ROWS = "vec_id long, embedding array<float>, label int, score string, v string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "s", "v") for i, v in zip(ids, vectors, strict=True)], ROWS)


def clustered(n, dims, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(8, dims))[r.integers(0, 8, n)] + 0.6 * r.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


ODD = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.1] * 7, [None] + [0.1] * 7, [0.5] * 3]


def exact(x, q, k, ids, score):
    s = score(x[q], x)
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[i]), s[i]) for i in order]


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("n", [300, 5000])
def test_top_k_is_exact(spark, n, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 1024)
    monkeypatch.setattr(bitsliced, "QUERY_BATCH", 40)  # several rounds for the larger table
    x = clustered(n, 16, n)
    x[7] = x[8] = x[9]
    fine = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    got = by_query(bitsliced.top_k(table(spark, list(x)), "vec_id % 50 = 0", k=10))
    assert got == {q: [(i, int(s)) for i, s in exact(fine, q, 10, np.arange(n), lambda a, b: b @ a)] for q in range(0, n, 50)}


def test_top_k_of_odd_vectors_ties_and_few_rows(spark):
    good = [[1.0, -1.0, 0.25, 0, 0, 0, 0, 0]] * 5 + [[-3.0, 2.0, 0, 0, 0, 0, 0, 0.001]]
    got = by_query(bitsliced.top_k(table(spark, good + ODD), "vec_id % 2 = 0", k=10))
    fine = np.floor(1024 * np.array([*good, ODD[2]])).astype(np.int64)  # a zero vector counts here
    ids = np.array([0, 1, 2, 3, 4, 5, 8])
    for q in (0, 2, 4):
        s = fine @ fine[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q]
        assert got[q] == [(int(ids[i]), int(s[i])) for i in order]
    assert set(got) == {0, 2, 4, 8}  # the short vector 12 has no candidates
    assert bitsliced.top_k(table(spark, []), "true").collect() == []


def test_slices_add_up_and_select():
    r = np.random.default_rng(0)
    parts = {w: [r.integers(0, 2, 200).astype(np.uint8) for _ in range(n)] for w, n in ((0, 5), (1, 2), (4, 7))}
    totals = bitsliced.add_slices({w: [bitsliced._pack(c) for c in cs] for w, cs in parts.items()})
    want = sum((1 << w) * c.astype(int) for w, cs in parts.items() for c in cs)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:200] if s is not None else np.zeros(200, int) for s in totals]
    assert (sum((1 << w) * b.astype(int) for w, b in enumerate(bits)) == want).all()
    alive = bitsliced._pack(np.ones(200, np.uint8))
    for k in (1, 7, 200):
        rows, value = bitsliced.top_rows(totals, alive, k)
        assert value == np.sort(want)[::-1][k - 1]
        assert (np.unpackbits(rows.view(np.uint8), bitorder="little")[:200] == (want >= value)).all()
    for value in (0, 3, 50, 10**6):
        assert (np.unpackbits(bitsliced.at_least(totals, alive, value).view(np.uint8), bitorder="little")[:200] == (want >= value)).all()


def test_multi_index_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "QUERY_BATCH", 30)
    x = clustered(4000, 16, 3)
    got = by_query(multi_index.search(table(spark, list(x)), "vec_id % 40 = 0", k=20))
    d, hit = x.astype(np.float64), 0
    for q, rows in got.items():
        want = exact(d, q, 20, np.arange(4000), lambda a, b: b @ a)
        hit += len({i for i, _ in want} & {i for i, _ in rows})
        assert len(rows) == 20 and all(s == pytest.approx(d[i] @ d[q], rel=1e-12) for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert len(got) == 100 and hit >= 0.9 * 2000


def test_multi_index_reads_every_cell_on_demand_and_ranks_copies_by_id(spark):
    x = clustered(3000, 15, 8)
    x[100:1100] = x[100]  # a third of all rows are copies
    d = x.astype(np.float64)
    got = by_query(multi_index.search(table(spark, list(x)), "vec_id % 60 = 0", k=20, share=1.0))
    for q, rows in got.items():
        s = np.einsum("ij,j->i", d, d[q])
        assert [i for i, _ in rows] == [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]


@pytest.mark.parametrize("near", [0.0, 0.02])
def test_multi_index_recall_beside_a_hot_group(spark, near, monkeypatch):
    r = np.random.default_rng(4)
    x = clustered(6000, 16, 9)
    hot = r.choice(6000, 2000, replace=False)
    x[hot] = x[hot[0]] + near * r.normal(size=(2000, 16)).astype(np.float32)
    got, d, hit = by_query(multi_index.search(table(spark, list(x)), "vec_id % 60 = 0", k=20)), x.astype(np.float64), 0
    for q, rows in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        hit += sum(score >= np.sort(s)[-20] - 1e-12 for _, score in rows)
    assert len(got) == 100 and hit >= 0.9 * 2000


def test_multi_index_small_odd_and_empty_tables(spark):
    good = [[1.0, 2, 3, 4, 5, 6, 7, 8]] * 4 + [[1.0, 0, 0, 0, 0, 0, 0, 0]]
    got = by_query(multi_index.search(table(spark, good + ODD), "vec_id % 2 = 0", k=20))
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {0: [1, 2, 3, 4], 2: [0, 1, 3, 4], 4: [0, 1, 2, 3]}
    short = [[1.0, 2.0, 3.0], [0.5, 0.5, 0.5], [7.0], [2.0], [-1.0]]  # other lengths have their own index
    got = by_query(multi_index.search(table(spark, good + short), "vec_id in (0, 5, 7)", k=20))
    assert {q: rows for q, rows in got.items() if q} == {5: [(6, 3.0)], 7: [(8, 14.0), (9, -7.0)]} and [i for i, _ in got[0]] == [1, 2, 3, 4]
    assert multi_index.search(table(spark, ODD[:4]), "true").collect() == []


def test_heap_visits_exactly_the_cells_within_reach():
    r = np.random.default_rng(5)
    books = multi_index.Codebooks(r.normal(size=(6, 3)), r.normal(size=(5, 3)))
    counts = r.integers(0, 4, 30)
    for need in (1, 10, 40, 10**6):
        q = r.normal(size=6)
        reach = books.reach(q, counts, need)
        a, b = books.distances(q)
        cells = sorted((a[i] + b[j], i * 5 + j) for i, j in itertools.product(range(6), range(5)))
        held, last = 0, None
        for d, c in cells:
            held, last = held + counts[c], d
            if held >= need:
                break
        assert reach == (pytest.approx(last) if held >= need else np.inf)


def test_components_of_any_size_are_scored_exactly(spark):
    small = np.random.default_rng(11).uniform(-1, 1, (60, 4)).tolist()
    rows = [*enumerate(small), (100, [2.0**41, 0.5, 0.25, 1.0]), (101, [-(2.0**41), 0.5, 3.0, 1.0])]
    fine = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in [*range(10), 100, 101]:
        scored = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bitsliced.top_k(df, "vec_id < 10 OR vec_id >= 100", k=5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {100, 101} <= {i for q, _, i, _ in want if q < 10}
    too_large = df.union(spark.createDataFrame([(102, [2.0**41, 0.0, 0.0, 0.0])], df.schema))
    with pytest.raises(Exception, match="Overflow|too large|too big"):
        bitsliced.top_k(too_large, "vec_id = 100", k=5).collect()
