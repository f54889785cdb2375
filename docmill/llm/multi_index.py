"""Approximate nearest neighbours: an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, pick

#: Rows that the codebooks are fitted on at most (those of smallest hashed id), words per half, rounds of k-means.
SAMPLE, WORDS, ROUNDS = 20_000, 256, 12
#: A query reads cells until they hold this share of the weight of all cells, and this weight at least. A cell weighs as
#: many distinct vectors as it has, but no more than HEAVY times the mean of the cells that aren't empty.
SHARE, LEAST, HEAVY = 0.35, 1_000, 8
#: Queries that travel at a time, and those among them that are compared at once; rows of a part of the index; queries
#: that a task walks the cells for.
QUERY_BATCH, TOGETHER, PART_ROWS, LARGE_PART, WALKS = 16_384, 256, 8_192, 1 << 20, 128
HITS = "query_id long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Codebooks:
    left: np.ndarray
    right: np.ndarray

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return _nearest(rows[:, : self.half], self.left) * len(self.right) + _nearest(rows[:, self.half :], self.right)

    def distances(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each half's words: minus the inner product with the query's half."""
        return -(self.left @ query[: self.half]), -(self.right @ query[self.half :])

    def reach(self, query: np.ndarray, counts: np.ndarray, need: float) -> float:
        """The summed distance of the last cell visited, when cells by rising sum have come to hold the weight `need`.

        The heap holds the frontier of pairs over both sorted word lists; a pair is pushed once both its predecessors
        came out. A cell was visited if and only if its sum is at most the result (ties included), which is infinite if
        all cells hold less than `need`.
        """
        a, b = self.distances(query)
        i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        grid = counts.reshape(len(a), len(b))[np.ix_(i_of, j_of)].tolist()
        a, b = a[i_of].tolist(), b[j_of].tolist()
        heap, held, last = [(a[0] + b[0], 0, 0)], 0, -np.inf
        out = [0] * len(a)  # how many pairs of word i have come out
        while heap and held < need:
            last, i, j = heapq.heappop(heap)
            out[i] = j + 1
            held += grid[i][j]
            if i + 1 < len(a) and out[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or out[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return last if held >= need else np.inf


def _nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1)[None, :] - 2 * rows @ words.T, axis=1)


def kmeans(rows: np.ndarray, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """First words are drawn by squared distance from those before, so that a crowd of near copies gets few of them."""
    if not rows.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(7)
    norms = (rows**2).sum(1)
    far, chosen = np.full(len(rows), np.inf), [int(rng.integers(len(rows)))]
    while len(chosen) < words:
        new = rows[chosen[-1]]
        far = np.minimum(far, np.maximum(norms - 2 * rows @ new + new @ new, 0))
        far[far <= 1e-12 * norms] = 0
        if not (total := far.sum()):
            break
        chosen.append(min(int(np.searchsorted(np.cumsum(far), rng.random() * total)), len(rows) - 1))
    centres = rows[chosen]
    for _ in range(rounds):
        near = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(rows: np.ndarray, words: int = WORDS) -> Codebooks:
    half = rows.shape[1] // 2
    return Codebooks(kmeans(rows[:, :half], words), kmeans(rows[:, half:], words))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (double); without null ids and null, empty, zero or not wholly finite vectors."""
    slim = pick(vectors, vec_id=id_col, v=vector_col).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    slim = slim.select("vec_id", F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return slim.where(fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def weights(counts: np.ndarray) -> np.ndarray:
    """Of the distinct vectors of each cell: what the cell counts for when a query decides how far to walk."""
    filled = counts[counts > 0]
    return np.minimum(counts, HEAVY * filled.mean()) if len(filled) else counts.astype(float)


def search(vectors: DataFrame, queries: str, k: int = 20, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: near the k rows of largest inner product with each query, ties to smaller ids.

    queries: a SQL condition on vec_id that picks the query rows; a query's own id is no candidate. share=1 reads every
    cell and so is exact. Vectors of another length than a query's are no candidates of it; each length that occurs has
    an index of its own. Null, empty, zero and not wholly finite vectors take no part.

    1. Each half of the vectors is quantised by its own codebook; a row's cell is the pair of its words. Every row is
       indexed, the codebooks alone are fitted on a bounded sample. The index is dealt out by ranges of cells, a full
       cell over several parts, and sorted by cell: the rows of a cell are an inverted list. The driver sees the counts
       of WORDS squared cells.
    2. A query walks the pairs by summed distance over a heap until the cells hold `share` of the weight of all cells,
       so that recall doesn't sink as the table grows, nor as copies fill a cell. What it needs of the walk is how far
       it reached.
    3. Queries travel in batches of fixed size to the index, which stays where it is. Of a part's lists, those that no
       query reached are skipped; the others are reranked by exact double-precision inner products of the original
       vectors, and each part answers with its k best of a query's lists.
    With fewer than k candidates in all, all are returned. Repeated ids: each row is a candidate, and the k best for any
    of a query id's vectors are its answer. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "multi_index")
    rows = work.save(usable(vectors, id_col, vector_col), "rows")
    lengths = sorted((r.n, r["count"]) for r in rows.groupBy(F.size("v").alias("n")).count().collect())
    if not lengths:
        return spark.createDataFrame([], RESULT)
    parts = [_indexed(work, rows.where(F.size("v") == dims), dims, count, queries, k, share) for dims, count in lengths]
    found = work.save(reduce(DataFrame.unionByName, parts), "found")
    work.keep("found")
    # A query id with several vectors may meet a row more than once.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _indexed(work: Workspace, rows: DataFrame, dims: int, count: int, queries: str, k: int, share: float) -> DataFrame:
    """The hits in each part of the index over the rows of one length."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    books = fit(np.array([r.v for r in sample]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = books.cells(_matrix(batch.column("v"), dims)) if len(batch) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cells, pa.int32())], ["vec_id", "v", "cell"])

    spread = 2 * work.spark.sparkContext.defaultParallelism
    files = max(1, -(-count // LARGE_PART), min(-(-count // PART_ROWS), spread))
    placed = rows.mapInArrow(place, "vec_id long, v array<double>, cell int")
    index = work.save(placed.repartitionByRange(files, "cell", F.xxhash64("vec_id")).sortWithinPartitions("cell", "vec_id"), f"index{dims}")
    counts = np.zeros(len(books.left) * len(books.right), np.int64)
    for r in index.select("cell", F.xxhash64("v").alias("h")).distinct().groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    weight = weights(counts)
    need = np.inf if share >= 1 else max(LEAST, share * weight.sum(), k + 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = [books.reach(q, weight, need) for q in _matrix(batch.column("v"), dims)] if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), pa.array(reach, pa.float64()), batch.column("cell")], ["query_id", "v", "reach", "cell"])

    asked = index.where(queries).select(F.col("vec_id").alias("query_id"), "v", "cell").distinct()
    asked = work.save(asked, f"asked{dims}")
    n = asked.count()
    walked = asked.repartition(max(1, -(-n // WALKS)), F.xxhash64("query_id")).mapInArrow(walk, "query_id long, v array<double>, reach double, cell int")
    walked = work.save(walked, f"walked{dims}")
    rounds = max(1, -(-n // QUERY_BATCH))

    def hits() -> Iterator[DataFrame]:
        for turn in range(rounds):
            batch = walked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == turn).toArrow()
            # Queries of the same cell stand together, so that what is compared at once reaches the same lists.
            order = np.argsort(batch.column("cell").to_numpy(), kind="stable")
            vectors = _matrix(batch.column("v").combine_chunks(), dims) if len(batch) else np.empty((0, dims))
            sent = batch.column("query_id").to_numpy()[order], vectors[order], batch.column("reach").to_numpy()[order]
            yield index.mapInArrow(_rerank(books, dims, sent, k), HITS)

    return work.rounds(hits(), rounds, f"hits{dims}")


def best_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of largest score of each query, of equal ones those of smallest id."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return query[kept], score[kept], ids[kept]


def _rerank(books: Codebooks, dims: int, sent: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
    query_ids, vectors, reaches = sent

    def lists(batch: tuple, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of the queries from place a on among the rows of a batch; query numbers count from a."""
        ids, rows, sizes, i, j = batch
        own, q, reach = query_ids[a : a + TOGETHER], vectors[a : a + TOGETHER], reaches[a : a + TOGETHER]
        visited = -(q[:, : books.half] @ books.left.T)[:, i] - (q[:, books.half :] @ books.right.T)[:, j] <= reach[:, None] + 1e-9 * np.abs(reach)[:, None]
        read = visited.any(axis=0)
        at = np.flatnonzero(np.repeat(read, sizes))
        if not len(at):
            none = np.empty(0, np.int64)
            return none, np.empty(0), none
        some = rows[at]
        rough = q @ some.T
        rough[~np.repeat(visited[:, read], sizes[read], axis=1)] = -np.inf
        rough[own[:, None] == ids[at][None, :]] = -np.inf
        least = np.partition(rough, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(q), -np.inf)
        # The matrix product rounds in another order than a single product does; near ties go on to the exact one.
        slack = 4e-16 * dims * np.linalg.norm(q, axis=1) * np.linalg.norm(some, axis=1).max()
        n, c = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
        return best_of(n, np.einsum("ij,ij->i", q[n], some[c]), ids[at[c]], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))] * -(-len(query_ids) // TOGETHER)
        for batch in batches:
            if not len(batch):
                continue
            ids, cells = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            order = np.lexsort((ids, cells))
            cell, sizes = np.unique(cells[order], return_counts=True)
            lists_of = ids[order], _matrix(batch.column("v"), dims)[order], sizes, *np.divmod(cell, len(books.right))
            for n, best in enumerate(held):
                new = lists(lists_of, n * TOGETHER)
                held[n] = best_of(*(np.concatenate(x) for x in zip(best, new, strict=True)), k)
        for n, (query, score, ids) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[query + n * TOGETHER]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run
