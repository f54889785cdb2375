"""Near duplicates: MinHash bands propose, odd sketches screen, full shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, WordHashes, Workspace, mixed, pick, shingle_set
from .components import connected_components

#: Bands of six samples: a pair at 0.8 shares one but for a chance of 4e-8, one at 0.1 shares one with a chance of 6e-5.
SAMPLES, BANDS, SKETCH_BITS, SET_BITS = 336, 56, 1024, 1024
#: Classes of a bucket that one task compares with the bucket's others.
SPLIT = 4096
ROWS = SAMPLES // BANDS
_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(1, 2**32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_SALT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
PARITY = [f"p{i}" for i in range(SET_BITS // 64)]
_SIGNATURE = "doc_id long, n long, fp binary, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH + PARITY)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of independent hash functions over a non-empty shingle set."""
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        block = h[at : at + 1024, None] * _MUL
        block += _ADD
        np.minimum(low, block.min(axis=0), out=low)
    return low


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """Rows of samples to bitmaps: each sample flips one bit, so that what two sets share cancels in an XOR."""
    with np.errstate(over="ignore"):
        bit = (mixed(low.astype(np.uint64) + _SALT) >> np.uint64(65 - SKETCH_BITS.bit_length())).astype(np.int64)
    flips = np.zeros((len(low), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(flips, (np.repeat(np.arange(len(low)), SAMPLES), bit.ravel()), 1)
    return np.packbits(flips, axis=1, bitorder="little").view("<i8")


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)[None, :] * STEP
        for k in range(ROWS):
            key = mixed(key) * STEP + rows[:, :, k]
        return mixed(key).view(np.int64)


def set_parity(shingles: np.ndarray) -> np.ndarray:
    """Odd sketch of the whole set. Bits that differ between two sets number |A xor B| at most, so a large XOR proves distance."""
    odd = np.bincount((shingles & np.uint64(SET_BITS - 1)).astype(np.int64), minlength=SET_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def most_flips(similarity: float, misses: float = 6.5) -> int:
    """The largest XOR population count of sampled sketches that a pair of this similarity has, but for rare chances (the
    hash functions are linear, which makes the tail for small sets a little heavier than that of independent ones).

    Of k samples about k(1 - J) differ, each flipping two bits; from d flips on n bits, n/2 (1 - exp(-2d/n)) stay odd,
    and collisions scatter that. The bound lies `misses` standard deviations of both effects above the mean.
    """
    n, differ = SKETCH_BITS, SAMPLES * (1 - similarity)
    mean = n / 2 * (1 - math.exp(-4 * differ / n))
    sampling = 2 * math.exp(-4 * differ / n) * math.sqrt(differ * similarity)
    collisions = math.sqrt(2) * 2 * differ / math.sqrt(n)
    return math.ceil(mean + misses * math.hypot(sampling, collisions))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per document (doc_id, text): set size, set fingerprint, band keys and odd sketch."""
    names = [x.split()[0] for x in _SIGNATURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, len(batch), 2000)):
                counts, prints, lows, parities = [], [], [], []
                for text in part.column("text"):
                    s = shingle_set(text.as_py(), words, hashes)
                    counts.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                    lows.append(minhashes(s) if len(s) else np.zeros(SAMPLES, np.uint32))
                    parities.append(set_parity(s))
                low = np.array(lows, np.uint32).reshape(-1, SAMPLES)
                keys = pa.array(band_keys(low).ravel())
                bands = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * BANDS, keys)
                sketch = np.hstack([odd_sketches(low), np.array(parities).reshape(-1, len(PARITY))])
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), bands]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(sketch[:, i].copy()) for i in range(sketch.shape[1])], names)

    return docs.mapInArrow(run, _SIGNATURE)


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * |A and B| >= percent * |A or B| on the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}

        def shingles(text: str) -> np.ndarray:
            if text not in seen:
                if len(seen) >= 32:
                    seen.clear()
                seen[text] = shingle_set(text, words, hashes)
            return seen[text]

        for batch in batches:
            keep = []
            for i in range(len(batch)):
                s, t = shingles(batch.column("ta")[i].as_py()), shingles(batch.column("tb")[i].as_py())
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _alike(left: str, right: str, percent: int) -> str:
    """SQL for: set sizes and odd sketches allow the similarity.

    J >= t means |A xor B| <= (|A| + |B|) (1 - t) / (1 + t), which the parity of whole sets bounds from below.
    """
    flips = lambda names: " + ".join(f"bit_count({left}.{c} ^ {right}.{c})" for c in names)
    return (
        f"100 * least({left}.n, {right}.n) >= {percent} * greatest({left}.n, {right}.n)"
        f" AND {flips(SKETCH)} <= {most_flips(percent / 100)}"
        f" AND ({flips(PARITY)}) * {100 + percent} <= ({left}.n + {right}.n) * {100 - percent}"
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Rows are linked when their word-shingle sets (see shingle_set) have a Jaccard similarity of percent/100 or more.
    component_id is the smallest doc_id reachable over links, kept tells whether it is the row's own.

    1. A row's set gives 336 MinHash samples: 56 bands of 6 propose pairs (a pair at 0.8 is missed with a chance of
       4e-8), and all samples folded into a 1024-bit odd sketch screen them by the population count of an XOR. An odd sketch
       of the whole set (1024 bits) bounds the difference of two sets from below and so rules out pairs for certain.
    2. Equal sets become one class, so that exact copies are never paired.
    3. In each band bucket every class is tried against the bucket's smallest class only. This unites large groups
       of near copies with linearly many pairs.
    4. Buckets that still hold several components are joined: all classes outside the bucket's largest component
       against all classes of other components, each pair in the first band that it shares. The screens are part of
       the join's condition. A bucket of many such classes is split: each part of SPLIT of them meets a copy of the
       bucket. No link between components is left out, and nothing is capped.
    Each proposed link is confirmed on the full sets of both texts.

    Null or wordless texts: n_shingles 0, linked with nothing, kept. Rows without id: component_id null, kept.
    Rows that share an id count as one document: their links are united. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "near")
    docs = pick(docs, doc_id=id_col, text=text_col)
    signed = work.save(signatures(docs, words), "signatures")
    filled = signed.where("n > 0 AND doc_id IS NOT NULL")
    carried = F.struct("n", "bands", *SKETCH, *PARITY)
    classes = filled.groupBy("fp").agg(F.min_by(carried, "doc_id").alias("c"), F.min("doc_id").alias("rep"))
    classes = work.save(classes.select("fp", "rep", "c.*"), "classes")

    entries = classes.select("rep", F.posexplode("bands").alias("pos", "band"))
    buckets = entries.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    live = work.save(entries.join(buckets.select("band", "first"), "band"), "buckets")
    sketches = classes.drop("fp")
    in_buckets = live.select(F.col("rep").alias("doc_id")).distinct()
    texts = work.save(docs.join(in_buckets, "doc_id"), "texts")

    stars = live.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    screened = stars.alias("p").join(sketches.alias("x"), F.expr("p.a = x.rep")).join(sketches.alias("y"), F.expr(f"p.b = y.rep AND {_alike('x', 'y', percent)}"))
    links = work.save(_links(screened.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, words, percent), "star_links")
    first = work.save(connected_components(links, work, "star"), "star_components")

    placed = live.select("band", "pos", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("band", "pos", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = work.save(placed, "placed")
    counts = placed.groupBy("band", "comp").count()
    mixed_buckets = counts.groupBy("band").agg(F.max(F.struct("count", "comp")).alias("most"), F.count(F.lit(1)).alias("k"), F.sum("count").alias("n")).where("k > 1")
    mixed_buckets = mixed_buckets.select("band", F.col("most.comp").alias("top"), F.ceil((F.col("n") - F.col("most.count")) / SPLIT).cast("int").alias("parts"))
    open_rows = work.save(placed.join(mixed_buckets, "band").join(sketches, "rep"), "open")
    outside = open_rows.where("comp <> top").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    others = open_rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first_shared = "array_position(zip_with(x.bands, y.bands, (a, b) -> a = b), true) = x.pos + 1"
    pairs = outside.alias("x").join(
        others.alias("y"),
        F.expr(f"x.band = y.band AND x.part = y.part AND x.comp <> y.comp AND (y.comp = y.top OR x.rep < y.rep) AND {_alike('x', 'y', percent)} AND {first_shared}"),
    )
    pairs = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    more = work.save(_links(pairs, texts, words, percent), "more_links")
    final = work.save(connected_components(links.unionByName(more), work, "all"), "components")
    work.keep("signatures", "classes", "components")

    members = signed.join(classes.select("fp", "rep"), "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    out = members.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
