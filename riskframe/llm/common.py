"""Helpers shared by the text operators: held-out split, bounded chunks, column appending."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.session import checkpoint_dir

#: Text bytes that one step inside a task works on (bounds the memory of a Python worker).
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves remainder 2 by 4 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def checkpointed(df: DataFrame) -> DataFrame:
    """Written once to ``spark.checkpoint.dir`` (shared by all executors), lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Written as Parquet to a folder of its own under ``spark.checkpoint.dir`` and read back, sizes known."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with at most ``limit`` text bytes each (one longer text makes its own slice)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start, n = 0, len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    while start < n:
        end = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        part = batch.slice(start, end - start)
        yield part, part.column(text).to_pylist()
        start = end


def append_columns(df: DataFrame, text: str, fields: list[tuple[str, T.DataType, pa.DataType]],
                   make: Callable[[], Callable[[list], list]], limit: int = CHUNK_BYTES) -> DataFrame:
    """Add columns computed from the text column, chunk by chunk, without a shuffle.

    ``make()`` runs once per task and returns a function from a list of texts (None for null) to
    one list or array per field. Columns of ``df`` that have a field's name are replaced.
    """
    names = [n for n, _, _ in fields]
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names or c == text])
    at = base.columns.index(text)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t, _ in fields]])
    arrow = [a for _, _, a in fields]
    out_names = [*base.columns, *names]

    def run(batches):
        compute = make()
        for batch in batches:
            for part, texts in chunks(batch, at, limit):
                made = [pa.array(v, type=a) for v, a in zip(compute(texts), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=out_names)

    return base.mapInArrow(run, schema)


def utf8(texts: list) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
