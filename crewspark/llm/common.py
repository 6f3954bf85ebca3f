"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.shipping import map_in_arrow
from crewspark.storage import shared_dir

#: Arrow types by the type names used in our output schemas.
ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()),
}

#: Rows of one Arrow slice are handed on in pieces of about this many bytes of text.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds.

    Columns are found by position, so that further columns whose names differ in case only (which
    Spark would call ambiguous) do no harm.
    """
    have = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    lower = [h.lower() for h in have]
    at = [have.index(n) if n in have else lower.index(n.lower()) for n in names]
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def documents(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return pick(table(spark, sf_dir, "documents"), *(names or ("doc_id", "text")))


def stage(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage, and a lost
    executor costs nothing that was finished before."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of bounded text size (a single longer text is a part by itself)."""
    n, at = batch.num_rows, 0
    if not n:
        return
    offsets = text_offsets(batch.column(text))
    while at < n:
        to = at + 1
        while to < n and offsets[to + 1] - offsets[at] <= SLICE_BYTES:
            to += 1
        yield batch.slice(at, to - at)
        at = to


def text_offsets(column: pa.Array):
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind, count=column.offset + len(column) + 1)
    return raw[column.offset :].astype(np.int64)


def map_rows(df: DataFrame, schema: str, fn: Callable, setup: Callable | None = None) -> DataFrame:
    """mapInArrow over slices of bounded size: fn(list of columns as Python lists, state) gives a
    list of columns for the schema ("name type, ...").  The first string column is the text."""
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    out = pa.schema([(n, ARROW[t]) for n, t in fields])
    at = next(i for i, (_, t) in enumerate(df.dtypes) if t == "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for whole in batches:
            for batch in slices(whole, at):
                columns = fn([c.to_pylist() for c in batch.columns], state)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out
                )

    return map_in_arrow(df, run, schema)


def map_batches(df: DataFrame, schema: str, fn: Callable, text: int = 1) -> DataFrame:
    """mapInArrow over slices of bounded size: fn(RecordBatch) gives a list of arrays (NumPy or
    Arrow) for the schema."""
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    out = pa.schema([(n, ARROW[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                columns = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)],
                    schema=out,
                )

    return map_in_arrow(df, run, schema)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
