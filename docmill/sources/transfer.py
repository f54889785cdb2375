"""Import and export of collections."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog


def import_json(spark: SparkSession, path: str, lines: bool = True, schema: str | None = None) -> DataFrame:
    """JSON lines, or files that are one JSON array each. With a schema the files are read once."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def export_jsonl(catalog: Catalog, name: str, path: str) -> None:
    """One document a line, with the kind of its collection and, where it is sharded, how."""
    df = catalog.table(name).withColumn("_collectionType", F.lit(catalog.kinds.get(name, "document")))
    if (shards := catalog.shards.get(name)) is not None:
        df = df.withColumn("_shardConfig", F.struct(*(F.lit(v).alias(k) for k, v in shards.items())))
    df.write.mode("overwrite").json(path)


def import_export(catalog: Catalog, name: str, path: str) -> DataFrame:
    """Reads what export_jsonl wrote as a collection of its kind."""
    df = import_json(catalog.spark, path)
    kind = df.select("_collectionType").first() if "_collectionType" in df.columns else None
    return catalog.replace(name, df.drop("_collectionType", "_shardConfig"), kind[0] if kind else None)


CHUNK = "doc_key string, chunk_index long, data binary"


def mixed_lines(content: bytes) -> Iterator[tuple[str | None, str | None, int | None, bytes | None]]:
    """(document as JSON, or key, number and bytes of a blob's chunk) of a file of lines, some of which announce bytes.

    A line of _type blob_chunk with _data_length is followed by so many bytes and a line end; with _blob_data it holds
    them in base 64. Lines that are no JSON objects and chunks cut short are skipped.
    """
    at = 0
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line, at = content[at:end].strip(), end + 1
        try:
            said = json.loads(line) if line else None
        except ValueError:
            continue
        if not isinstance(said, dict):
            continue
        if said.get("_type") != "blob_chunk":
            yield line.decode(), None, None, None
            continue
        data = None
        if (size := said.get("_data_length")) is not None:
            data, at = content[at : at + size], at + size
            at += content[at : at + 1] == b"\n"
            data = data if len(data) == size else None
        elif said.get("_blob_data") is not None:
            data = base64.b64decode(said["_blob_data"])
        if data is not None and said.get("_doc_key") is not None and said.get("_chunk_index") is not None:
            yield None, said["_doc_key"], said["_chunk_index"], data


def import_mixed(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents of the schema, and chunks of blobs (doc_key, chunk_index, data), of files as in mixed_lines().

    Bytes may hold line ends, so that a file can't be split: each is one task's work, and Spark reads files of up to 2 GB
    in this way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                lines = mixed_lines(content.as_py())
                while part := list(islice(lines, 1000)):
                    columns = zip(*part, strict=True)
                    types = (pa.string(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["document", "doc_key", "chunk_index", "data"])

    rows = blobs(spark, path).select("content").mapInArrow(run, f"document string, {CHUNK}")
    documents = rows.where("document IS NOT NULL").select(F.from_json("document", schema).alias("d")).select("d.*")
    return documents, rows.where("doc_key IS NOT NULL").drop("document")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows of path, time, length and content."""
    return spark.read.format("binaryFile").load(path)


def change_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of change events from a folder that receives JSON files: type, and the documents in the schema."""
    return spark.readStream.schema(schema).json(path)
