"""Packing documents into fixed-length sequences by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pick
from .tokens import ByteLevelTokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
#: Ids in a batch of pieces sent to Spark, unless one piece is longer.
BATCH = 1 << 19
#: In tokens of padding: what a cut at a sentence's end, a cut inside a sentence and another sequence cost.
SENTENCE_CUT, HARD_CUT, SEQUENCE = 1, 4, 256
#: Tokens planned at a time, and how many windows at a plan's end are planned again with what follows.
HORIZON, AGAIN = 1 << 19, 16


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions from 0 to total in order, and the penalty of cutting there.

    Document and sentence ends, inside sentences the places where a window that begins at one of them is full, and one
    chain of full windows from the beginning, so that no text, however poor in ends, needs padding.
    """
    ends = np.unique(np.concatenate(([0], sentence_ends, doc_ends, [total])))
    gaps = np.diff(ends)
    far = ends[:-1][gaps > length]
    chains = [np.arange(b + length, min(b + g, total), length) for b, g in zip(far, gaps[gaps > length], strict=True)]
    hard = np.setdiff1d(np.concatenate([ends + length, np.arange(length, total, length), *chains]), ends)
    hard = hard[hard < total]
    positions = np.concatenate((ends, hard))
    penalty = np.concatenate((np.full(len(ends), SENTENCE_CUT), np.full(len(hard), HARD_CUT)))
    penalty[: len(ends)][np.isin(ends, doc_ends)] = 0
    order = np.argsort(positions, kind="stable")
    return positions[order], penalty[order]


def plan(positions: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """The cut positions of least total cost: padding to `length` (none at a power of two), penalties, sequences.

    cost(j) = penalty(j) + min over i of cost(i) + length - (p(j) - p(i)): the minimum of cost(i) + p(i) over the
    window [p(j) - length, p(j)), which a monotone queue keeps. At document ends, shorter power-of-two windows too.
    """
    pos, pen = positions.tolist(), penalties.tolist()
    index = {p: i for i, p in enumerate(pos)}
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    n, last = len(pos), len(pos) - 1
    cost, back, key = [0] * n, [0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n):
        p = pos[j]
        low = p - length
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = key[i] - low
        if pen[j] == 0 or j == last:
            for w in powers:
                if (k := index.get(p - w)) is not None and cost[k] < best:
                    best, i = cost[k], k
        best += pen[j] + SEQUENCE
        cost[j], back[j], key[j] = best, i, best + p
        while queue and key[queue[-1]] >= best + p:
            queue.pop()
        queue.append(j)
    cuts, j = [], last
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


class _Packer:
    def __init__(self, ends_sentence: np.ndarray, length: int, base: int):
        self.ends, self.length, self.sequence = ends_sentence, length, base
        self.docs: deque = deque()  # (doc_id, start of what is left, doc_tokens, ids that are left)
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)

    def flush(self, final: bool) -> list[tuple]:
        """Pieces without their ids."""
        return [piece for piece, _ in self.cut(final)]

    def cut(self, final: bool) -> list[tuple[tuple, np.ndarray]]:
        """Pieces and their ids."""
        if not self.held:
            return []
        ids = np.concatenate([d[3] for d in self.docs])
        doc_ends = np.cumsum([len(d[3]) for d in self.docs])
        cuts = plan(*candidates(doc_ends, np.flatnonzero(self.ends[ids]) + 1, len(ids), self.length), self.length)
        if not final:
            cuts = [c for c in cuts if c <= len(ids) - AGAIN * self.length]
        out, at = [], 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, start, tokens, left = self.docs[0]
                n = min(len(left), cut - at)
                out.append(((doc_id, start, n, zlib.crc32(left[:n].astype("<u4").tobytes()), tokens, self.sequence, offset), left[:n]))
                offset, at = offset + n, at + n
                self.docs.popleft()
                if n < len(left):
                    self.docs.appendleft((doc_id, start + n, tokens, left[n:]))
            self.sequence += 1
        self.held -= at
        return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document's ids and then end_id form a stream in the order of the rows of each input partition; the stream is cut
    into sequences of at most `length` ids by plan(). Every id lies in exactly one piece, pieces fill a sequence from
    offset 0 without gaps. Nothing is shuffled: partitions are packed on their own, and only a partition's last
    sequences can stay short. Memory is bounded by HORIZON tokens and the longest text.

    Null and empty texts: end_id alone. Null and repeated ids: each row is a document of its own. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteLevelTokenizer(tokenizer_path)
        packer = _Packer(encode.ends_sentence(), length, TaskContext.get().partitionId() << 33)
        types = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def rows(pieces: list[tuple[tuple, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            # A sequence holds `length` ids at most, so that many pieces together are a batch of bounded size.
            step = max(1, BATCH // length)
            for at in range(0, len(pieces), step):
                facts, ids = zip(*pieces[at : at + step], strict=True)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                columns = [pa.array(c, t) for c, t in zip(zip(*facts, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, lists], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "")
                packer.add(doc_id.as_py(), np.append(ids, np.uint32(end_id)))
                if packer.held >= HORIZON:
                    yield from rows(packer.cut(final=False))
        yield from rows(packer.cut(final=True))

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)
