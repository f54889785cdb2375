"""Exact top-k search over a bit-sliced index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, pick

#: Rows of an index block, queries that travel at a time, and the high bits of attributes and of query weights in use.
BLOCK_ROWS, QUERY_BATCH, ATTRIBUTE_BITS, WEIGHT_BITS = 16_384, 8_192, 8, 12
HITS = "query_id long, vec_id long, score long"
BLOCK = "dims int, ids binary, rows binary, kind int, low binary, drop int, bits int, slices binary, aside_ids binary, aside binary"
SCHEMA = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.binary()) for x in BLOCK.split(", ")])
STORED = ("<i2", "<i4", "<i8")
#: Rows with a component from here on are scored aside, and bitmaps are used where no sum can pass EXACT.
LARGE, EXACT = 1 << 40, 1 << 62


def _pack(bits: np.ndarray) -> np.ndarray:
    """Boolean rows to bitmaps of 64-bit words."""
    n = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), np.uint8)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def add_slices(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps per binary weight, as the slices of the totals, by carry-save full adders."""
    out: list[np.ndarray] = []
    weight, last = 0, max(columns, default=-1)
    columns = {w: list(c) for w, c in columns.items()}
    while weight <= last:
        column, up = columns.get(weight, []), columns.setdefault(weight + 1, [])
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            half = a ^ b
            column.append(half ^ c)
            up.append((a & b) | (half & c))
        if len(column) == 2:
            a, b = column
            column = [a ^ b]
            up.append(a & b)
        out.append(column[0] if column else None)
        if up:
            last = max(last, weight + 1)
        weight += 1
    return out


def top_rows(slices: list[np.ndarray], alive: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """From the most significant slice down: the k-th largest value among the alive rows, and the rows at or above it.

    `sure` has the rows above the value found so far, `ties` those equal to it in the slices read.
    """
    sure, ties, value = np.zeros_like(alive), alive.copy(), 0
    for weight in range(len(slices) - 1, -1, -1):
        s = slices[weight]
        if s is None:
            continue
        ones = ties & s
        if int(np.bitwise_count(sure).sum() + np.bitwise_count(ones).sum()) >= k:
            ties, value = ones, value | (1 << weight)
        else:
            sure |= ones
            ties &= ~s
    return sure | ties, value


def at_least(slices: list[np.ndarray], alive: np.ndarray, value: int) -> np.ndarray:
    """Rows whose total is value or more, by one comparison down the slices."""
    if value <= 0:
        return alive
    above, ties = np.zeros_like(alive), alive.copy()
    for weight in range(max(len(slices), value.bit_length()) - 1, -1, -1):
        s = slices[weight] if weight < len(slices) and slices[weight] is not None else np.zeros_like(alive)
        if value >> weight & 1:
            ties &= s
        else:
            above |= ties & s
            ties &= ~s
    return above | ties


@dataclass
class Block:
    """Rows of the index: ids, exact integer vectors, and bitmaps of the high bits of each attribute.

    An attribute of a row is low + (h << drop) + r; slices[b] has bit b of h for all attributes and rows. Rows with a
    component too large for that stand aside.
    """

    ids: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    drop: int
    slices: np.ndarray
    aside_ids: np.ndarray
    aside: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray) -> Block:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        large = ((rows >= LARGE) | (rows <= -LARGE)).any(axis=1)
        aside_ids, aside, ids, rows = ids[large], rows[large], ids[~large], rows[~large]
        n, dims = rows.shape
        low = rows.min(0) if n else np.zeros(dims, np.int64)
        span = int((rows - low).max(initial=0))
        drop = max(0, span.bit_length() - ATTRIBUTE_BITS)
        high = ((rows - low) >> drop).T
        slices = np.stack([_pack((high >> b & 1).astype(np.uint8)) for b in range(max(1, span.bit_length() - drop))])
        return cls(ids, rows, low, drop, slices, aside_ids, aside)

    def stored(self) -> tuple:
        """As a row of BLOCK; vectors in the least number of bytes that holds them."""
        kind = next(t for t in STORED if not self.rows.size or np.iinfo(t).min <= self.rows.min() <= self.rows.max() <= np.iinfo(t).max)
        whole = lambda x: np.ascontiguousarray(x).tobytes()
        return (self.rows.shape[1], whole(self.ids), whole(self.rows.astype(kind)), STORED.index(kind), whole(self.low), self.drop, len(self.slices), whole(self.slices), whole(self.aside_ids), whole(self.aside))

    @classmethod
    def read(cls, dims: int, ids: bytes, rows: bytes, kind: int, low: bytes, drop: int, bits: int, slices: bytes, aside_ids: bytes, aside: bytes) -> Block:
        long = lambda x: np.frombuffer(x, np.int64)
        vectors = np.frombuffer(rows, STORED[kind]).astype(np.int64).reshape(-1, dims)
        return cls(long(ids), vectors, long(low), drop, np.frombuffer(slices, "<u8").reshape(bits, dims, -1), long(aside_ids), long(aside).reshape(-1, dims))

    @cached_property
    def alive(self) -> np.ndarray:
        return _pack(np.ones(len(self.ids), np.uint8))

    @cached_property
    def flipped(self) -> np.ndarray:
        """Slices of each attribute's complement, for negative weights."""
        return self.slices ^ self.alive

    @cached_property
    def largest(self) -> int:
        return int(np.abs(self.rows).max(initial=0))

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of every row that may be among the k best of this block (and some more).

        With v = low + (h << drop) + r and |q| = (w << cut) + e per attribute, the bitmaps give the sum of w * h, or of
        w * (top - h) where q is negative; what r and e add lies in an interval whose width is known. Rows within that
        width of the k-th total are scored exactly.
        """
        size = np.abs(query)
        cut = max(0, int(size.max(initial=0)).bit_length() - WEIGHT_BITS)
        weights, errors = size >> cut, size & ((1 << cut) - 1)
        columns: dict[int, list[np.ndarray]] = {}
        for d in np.flatnonzero(weights):
            source = self.slices if query[d] > 0 else self.flipped
            w = int(weights[d])
            for t in range(w.bit_length()):
                if w >> t & 1:
                    for b in range(len(self.slices)):
                        columns.setdefault(t + b, []).append(source[b][d])
        totals = add_slices(columns)
        _, kth = top_rows(totals, self.alive, k)
        top = (1 << len(self.slices)) - 1
        width = int((errors * top).sum() << self.drop) + int((size * ((1 << self.drop) - 1)).sum())
        least = kth - -(-width >> (cut + self.drop)) - 1 if width else kth
        near = at_least(totals, self.alive, least)
        found = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(self.ids)])
        return found, self.rows[found] @ query


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and floor(scale * x) of every component; null ids, null vectors and null or non-finite components go.

    A component whose floor is no 64-bit integer raises an error.
    """
    slim = pick(vectors, vec_id=id_col, v=vector_col).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fits = lambda y: F.when(F.abs(y) < float(2**63), F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large for a 64-bit integer")).cast("long"))
    return slim.where(fine).select("vec_id", F.transform("v", lambda x: fits(x.cast("double") * scale)).alias("v"))


def top_k(vectors: DataFrame, queries: str, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product with each query, ties to smaller ids.

    queries: a SQL condition on vec_id that picks the query rows; a query's own id is no candidate. Components are
    floor(scale * x). Rows are dealt once into blocks of about BLOCK_ROWS, whose slices are made once and written; queries
    travel to them in batches of QUERY_BATCH, so that what is sent has a fixed size, and every task answers with the k
    best of its blocks. The result is exact: bitmaps only rule out rows whose upper bound is below the k-th lower bound.

    Null, empty and non-finite vectors take no part. Rows and queries whose products could pass 64 bits are scored in
    whole numbers of any size; a score among the k best that is no 64-bit integer raises an error. Vectors of another length than a query's are no candidates of it.
    Repeated ids: each row is a candidate, and the k best for any of a query id's vectors are its answer. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "slices")
    rows = work.save(quantised(vectors, scale, id_col, vector_col), "rows")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    index = work.save(rows.repartition(blocks, F.xxhash64("vec_id")).mapInArrow(_build, BLOCK), "index")
    asked = rows.where(queries)
    rounds = max(1, -(-asked.count() // QUERY_BATCH))

    def hits() -> Iterator[DataFrame]:
        for turn in range(rounds):
            batch = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(rounds)) == turn)
            sent = [(r.vec_id, np.array(r.v, np.int64)) for r in batch.distinct().collect()]
            yield index.mapInArrow(_search(sent, k), HITS)

    found = work.save(next(hits()), "hits") if rounds == 1 else work.rounds(hits(), rounds, "hits")
    work.keep("hits")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows of a partition, those of each length on their own."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(dims: int) -> pa.RecordBatch:
        ids, rows = zip(*held.pop(dims), strict=True)
        return pa.RecordBatch.from_pylist([dict(zip(_names(BLOCK), Block.of(np.concatenate(ids), np.concatenate(rows)).stored(), strict=True))], SCHEMA)

    for batch in batches:
        lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id").to_numpy()
        flat = batch.column("v").flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(lengths)))
        for dims in np.unique(lengths):
            own = np.flatnonzero(lengths == dims)
            rows = flat.reshape(-1, dims) if len(own) == len(ids) else np.stack([flat[ends[i] : ends[i + 1]] for i in own])
            held.setdefault(int(dims), []).append((ids[own], rows.astype(np.int64)))
            if sum(len(i) for i, _ in held[int(dims)]) >= 2 * BLOCK_ROWS:
                yield block(int(dims))
    for dims in list(held):
        yield block(dims)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _search(sent: list[tuple[int, np.ndarray]], k: int):
    def answer(block: Block, q: int, v: np.ndarray) -> list[tuple[int, int]]:
        """(minus score, id) of the k best of a block."""
        found: list[tuple[int, int]] = []
        mine = len(block.ids) > 0 and sum(abs(x) for x in v.tolist()) * block.largest * 4 < EXACT
        if mine:
            a, b = np.searchsorted(block.ids, [q, q + 1])
            at, score = block.search(v, k + (b - a))
            other = block.ids[at] != q
            at, score = at[other], score[other]
            best = np.lexsort((block.ids[at], -score))[:k]
            found = list(zip((-score[best]).tolist(), block.ids[at[best]].tolist(), strict=True))
        for ids, rows in [(block.aside_ids, block.aside)] + ([] if mine else [(block.ids, block.rows)]):
            if len(ids):
                scores = (rows.astype(object) @ v.astype(object)).tolist()
                found += [(-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != q]
        return heapq.nsmallest(k, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in sent]
        for batch in batches:
            for record in batch.to_pylist():
                block = Block.read(**record)
                for n, (q, v) in enumerate(sent):
                    if len(v) == block.rows.shape[1]:
                        best[n] = heapq.nsmallest(k, [*best[n], *answer(block, q, v)])
        rows = [(q, i, -s) for (q, _), own in zip(sent, best, strict=True) for s, i in own]
        columns = zip(*rows, strict=True) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _names(HITS))

    return run
