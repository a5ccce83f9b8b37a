"""Shared by the operators: rows carried whole under one column, and task functions over Arrow batches.

Documents may hold any extra columns, so an operator packs a row into the struct column
``doc`` first; its own columns then cannot clash with the caller's.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# A task works on at most this many bytes of a batch at once.
SLICE_BYTES = 4 << 20
# Values that are sent to every task: an operator refuses larger ones or splits them.
MAX_BROADCAST_BYTES = 64 << 20


# Rows and bytes of a batch between Spark and its Python workers.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session passes at most BATCH_ROWS rows and BATCH_BYTES to Python at once.

    Set for good, as a plan that is built here may run after the operator has returned.
    Spark's own defaults may fill 64 MB per task on either side, beside the working memory;
    a smaller value that the session has already stays.
    """
    for key, bound in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        held = spark.conf.get(key, None) or ""
        if not (held.isdigit() and 0 < int(held) <= bound):
            spark.conf.set(key, str(bound))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Stages stored inside the block pass texts to Python in batches of BATCH_ROWS.

    Spark's own default may fill 64 MB per task on either side, beside the working memory.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(module: str) -> None:
    """Send the module's functions to tasks by value: executors need not have the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


def pack(docs: DataFrame, carry: Sequence[str] | None = None, *more: str) -> DataFrame:
    """``doc`` (a struct of the carried columns, all by default), ``text`` and the named columns."""
    carry = docs.columns if carry is None else list(carry)
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in carry]).alias("doc"),
        docs["text"].cast("string").alias("text"), *[docs[c] for c in more],
    )


def with_text(packed: DataFrame, text: str) -> DataFrame:
    """Rows of documents again, with their text (and ``n_chars``, where there is one) replaced."""
    schema = packed.schema["doc"].dataType
    fresh = {"text": F.col(text).cast(schema["text"].dataType)}
    if "n_chars" in schema.names:
        same = F.col("doc.text").eqNullSafe(F.col(text))
        fresh["n_chars"] = F.when(same, F.col("doc.n_chars")).otherwise(
            F.length(text).cast(schema["n_chars"].dataType)
        )
    return packed.select(*[
        fresh[f.name].alias(f.name) if f.name in fresh else F.col(f"doc.`{f.name}`") for f in schema
    ])


def rows_of(packed: DataFrame) -> DataFrame:
    """The carried rows, unpacked."""
    return packed.select("doc.*")


def append(df: DataFrame, start: Callable[[], Callable], ddl: str) -> DataFrame:
    """``df`` with the columns ``ddl`` computed per slice of a batch.

    ``start`` runs once per task and returns a function from a record batch to one list
    per new column.
    """
    added = StructType.fromDDL(ddl)
    types = [f.type for f in to_arrow_schema(added)]
    names = [*df.columns, *added.names]

    def run(batches):
        step = start()
        for batch in slices(batches):
            new = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(step(batch), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def emit(df: DataFrame, start: Callable[[], Callable], ddl: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows that a function makes of each slice, or None for no rows, and of the task's end.

    ``start`` returns ``step`` or ``(step, finish)``; both give one list per column.
    """
    schema = StructType.fromDDL(ddl)
    types = [f.type for f in to_arrow_schema(schema)]

    def batch_of(columns):
        arrays = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches):
        begun = start()
        step, finish = begun if isinstance(begun, tuple) else (begun, None)
        for batch in slices(batches, slice_bytes):
            columns = step(batch)
            if columns is not None:
                yield batch_of(columns)
        columns = finish() if finish else None
        if columns is not None:
            yield batch_of(columns)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batches, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Non-empty batches of about ``slice_bytes`` at most, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, batch.num_rows * slice_bytes // max(1, batch.get_total_buffer_size()))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, a missing value as b''."""
    return [v or b"" for v in batch.column(name).cast(pa.binary()).to_pylist()]


def code_points(data: bytes, offsets: Sequence[int]) -> list[int]:
    """Ascending byte offsets of character starts, as offsets in code points."""
    if data.isascii():
        return list(offsets)
    found, last, n = [], 0, 0
    for at in offsets:
        n += len(data[last:at].decode())
        found.append(n)
        last = at
    return found


def sha256_of_list(column) -> F.Column:
    """Lowercase hex SHA-256 of the strings, comma-joined."""
    return F.sha2(F.concat_ws(",", column).cast("binary"), 256)


ship(__name__)
