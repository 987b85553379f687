"""Stored form of reports: gzip in base64 in an envelope, its exact reverse, and older forms."""

from __future__ import annotations

import base64
import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODING = "gzip-base64"
VIEW = 2
LIMIT_BYTES = 8 << 20


def _mapped(df: DataFrame, text: str, out: str, one) -> DataFrame:
    """df with the column out: one over every text, a batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if v is None else one(v) for v in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string")


def encoded(reports: DataFrame, text: str, out: str = "stored", limit: int = LIMIT_BYTES) -> DataFrame:
    """reports with their envelope; a text beyond the limit of bytes raises, it is never cut."""
    def one(value: str) -> str:
        body = value.encode()
        if len(body) > limit:
            raise ValueError(f"a report of {len(body)} bytes is beyond the limit of {limit}")
        return base64.b64encode(gzip.compress(body, mtime=0)).decode()

    packed = _mapped(reports, text, "_data", one)
    envelope = F.to_json(F.struct(F.lit(VIEW).alias("storageView"), F.lit(ENCODING).alias("encoding"), F.col("_data").alias("data")))
    return packed.withColumn(out, F.when(F.col("_data").isNotNull(), envelope)).drop("_data")


def decoded(stored: DataFrame, column: str, out: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """stored with the text of each envelope; a text that is no envelope is an older form and stands for itself.

    Null for an envelope of another encoding, of broken data, or one that unpacks beyond the limit.
    """
    def one(value: str) -> str | None:
        try:
            unpack = zlib.decompressobj(wbits=31)
            body = unpack.decompress(base64.b64decode(value, validate=True), limit + 1)
            return body.decode() if unpack.eof and len(body) <= limit else None
        except (ValueError, zlib.error):
            return None

    field = lambda name: F.get_json_object(column, f"$.{name}")
    opened = _mapped(stored.withColumn("_data", F.when(field("encoding") == ENCODING, field("data"))), "_data", "_body", one)
    return opened.withColumn(out, F.when(field("encoding").isNull(), F.col(column)).otherwise(F.col("_body"))).drop("_data", "_body")
