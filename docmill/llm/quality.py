"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, mixed, pick

#: At most so many labelled rows are kept as neighbours; they are those of smallest hashed id.
MOST_LABELLED = 4000
RANK, NEIGHBOURS, POWER = 48, 15, 8
#: Terms: hashed trigrams of character classes, then measures of repetition and length.
HASHED, EXTRA, BLOCK = 1024, 6, 100
TERMS = HASHED + EXTRA


def _classes() -> np.ndarray:
    """Byte to class: lower case and all of non-ASCII, upper case, digits, other control, and each mark on its own."""
    out = np.full(256, 1, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if b < 32 and c != "\n" else 0
    marks = [b for b in range(128) if out[b] == 0]
    out[marks] = np.arange(5, 5 + len(marks))
    return out


CLASS = _classes()
KINDS = int(CLASS.max()) + 1
with np.errstate(over="ignore"):
    BIN = (mixed(np.arange(KINDS**3, dtype=np.uint64) + np.uint64(77)) % np.uint64(HASHED)).astype(np.int64)


def terms(text: str | None) -> np.ndarray:
    """Term weights of a whole text; no label, language, source or id enters."""
    out = np.zeros(TERMS, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    c = CLASS[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.int32)
    codes = (c[:-2] * KINDS + c[1:-1]) * KINDS + c[2:]
    counts = np.bincount(codes, minlength=KINDS**3)
    some = np.flatnonzero(counts)
    out[:HASHED] = np.log1p(np.bincount(BIN[some], counts[some], HASHED) * (1000.0 / max(1, len(codes))))
    words = raw.split()
    if words:
        n = len(words)
        blocks = [words[i : i + BLOCK] for i in range(0, n, BLOCK)]
        lines = [x for x in raw.split(b"\n") if x]
        out[HASHED:] = (
            8 * sum(map(eq, words, words[1:])) / n,
            8 * (1 - sum(len(set(b)) for b in blocks) / n),
            4 * (1 - len(set(lines)) / len(lines)),
            np.log1p(n) / 2,
            np.log1p(len(raw) / n),
            np.log1p(n / len(lines)) / 2,
        )
    return out


@dataclass(frozen=True)
class Model:
    """weights and projection take terms to the latent space; neighbours are unit rows there, labels their 0 or 1."""

    weights: np.ndarray
    centre: np.ndarray
    projection: np.ndarray
    neighbours: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        x = (rows * self.weights - self.centre) @ self.projection
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Exact cosines of a block of documents with all neighbours, then similarity-weighted votes of the nearest."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cos = self.latent(rows) @ self.neighbours.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-3).astype(np.float64) ** POWER
        return np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0, 1)


def fit_rows(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Latent-semantic space of the labelled rows: inverse document frequency, then the leading singular vectors."""
    if not len(rows):
        none = np.zeros((TERMS, 0), np.float32)
        return Model(np.ones(TERMS, np.float32), np.zeros(TERMS, np.float32), none, none.T, labels)
    weights = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 1).astype(np.float32)
    x = rows * weights
    centre = x.mean(0)
    _, _, right = np.linalg.svd(x - centre, full_matrices=False)
    model = Model(weights, centre, np.ascontiguousarray(right[:RANK].T), None, labels)
    return Model(weights, centre, model.projection, model.latent(rows), labels)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """From docs (doc_id, text) and labels (doc_id, label); at most `most` labelled rows, those of smallest hashed id."""
    chosen = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "row"])

    found = docs.join(chosen, "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, row binary")
    kept = sorted({r.doc_id: (r.label, bytes(r.row)) for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}.items())
    rows = np.array([np.frombuffer(row, np.float32) for _, (_, row) in kept], np.float32).reshape(-1, TERMS)
    return fit_rows(rows, np.array([label for _, (label, _) in kept], np.float64))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs (all columns) with score, 0 to 1. The model has a fixed size: it travels with the task.

    Null texts and texts without words score 0: they hold nothing to be good. Where docs has a column score, ours is called score_.
    """
    name = free_name(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
                texts = part.column(text_col).to_pylist()
                rows = np.array([terms(t) for t in texts], np.float32).reshape(-1, TERMS)
                scores = np.where([bool(t and t.split()) for t in texts], model.scores(rows), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """The fold whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Learns from the labels outside the held-out fold only.

    Null ids: scored, not held out, never learned from. Conflicting labels of an id: the smaller one. Texts without
    words score 0; without labels all others score 0.5.
    """
    marked = pick(labels, doc_id=id_col, label=label_col).withColumn("label", F.col("label").cast("int"))
    slim = pick(docs, doc_id=id_col, text=text_col)
    model = fit(slim, marked.where(~held_out()))
    out = score(slim, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
