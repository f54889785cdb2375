"""Shared pieces: intermediate tables, column picking, word and shingle hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.sources.checkpoints import own_folder

#: Multipliers of the 64-bit mixers; any odd constants with scattered bits would do.
MIX_A, MIX_B, STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class Workspace:
    """Intermediate tables in the shared checkpoint folder, so that no step depends on the executors that made it.

    What a result still reads stays until the driver's JVM ends; all else goes as soon as keep() is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, own_folder(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def rounds(self, makers: Iterator[DataFrame], count: int, name: str) -> DataFrame:
        """The rows of several DataFrames, made and written one after another; a single one stays lazy."""
        if count == 1:
            return next(iter(makers))
        schema = None
        for df in makers:
            schema = df.schema
            df.write.mode("append").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, once no DataFrame still to be computed reads the others."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own, so that other columns can't clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it where df has such a column already (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hashes by word; forgets all beyond a bound, so that memory stays flat."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_B
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles.

    Words are runs without space or U+0009 to U+000D, A-Z lower-cased. A text of fewer words than a shingle
    gives one shingle of all its words; a text without words, or a null text, gives none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - width + 1] + STEP * np.uint64(width)
        for k in range(1, width):
            out = mixed(out) * STEP + h[k : len(h) - width + 1 + k]
        return np.unique(mixed(out))
