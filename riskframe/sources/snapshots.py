"""Snapshots that are published when they differ from the last one.

A published table is a folder of versions and one pointer::

    <path>/versions/<id>/        the rows of a version (Parquet, never changed once written)
    <path>/digests/<id>.json     its schema, row count and order-free digest
    <path>/CURRENT               the id of the version that readers take

Whether the new rows differ is decided by the digest alone: the old rows are not read. A version is
written in full, its digest beside it, and only then is the pointer replaced, by one rename. A writer
that is killed at any point leaves the version before it in place.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Digest:
    """What tells a table's content: two order-free sums of row hashes, the row count and the schema."""

    schema: str
    rows: int
    first: str
    second: str


def _hashable(field: T.StructField) -> list[Column]:
    """A column with whether it is null (a null leaves a hash as it was); maps as sorted entries."""
    c = F.col(f"`{field.name}`")
    return [F.sort_array(F.map_entries(c)) if isinstance(field.dataType, T.MapType) else c, c.isNull()]


def digest_columns(df: DataFrame) -> list[Column]:
    """The digest of a table as aggregates: row hashes are added up exactly, so neither the order of rows nor the
    partitioning matters, and repeated rows count as often as they occur. A sum that is off in any
    row changes both 64-bit sums, which come from independent seeds."""
    columns = [x for f in df.schema.fields for x in _hashable(f)]
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).alias("rows"), total(1).alias("first"), total(2).alias("second")]


def _schema_text(df: DataFrame) -> str:
    return ",".join(f"{name} {kind}" for name, kind in df.dtypes)


def table_digest(df: DataFrame) -> Digest:
    """The digest of a table in one pass with one row a task to the driver."""
    r = df.agg(*digest_columns(df)).first()
    return Digest(_schema_text(df), r["rows"], r["first"], r["second"])


class Snapshots:
    """A table that is published version by version under one path (any file system that Spark writes to)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        path = self._path("CURRENT")
        return self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())

    def _read(self, *parts: str) -> str | None:
        path = self._path(*parts)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, text: str, *parts: str) -> None:
        """Write a small file under another name and rename it over its own: readers see the old text or the new one."""
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        aside, path = self._path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}"), self._path(*parts)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(path.getParent())
        stream = files.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._files().rename(aside, path, options)

    def current(self) -> str | None:
        """The id of the version that readers take, None before the first one."""
        return self._read("CURRENT")

    def digest(self) -> Digest | None:
        """The digest of the current version, from its file alone."""
        version = self.current()
        text = None if version is None else self._read("digests", f"{version}.json")
        return None if text is None else Digest(**json.loads(text))

    def read(self) -> DataFrame:
        """The rows of the current version."""
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"nothing is published under {self.path}")
        return self.spark.read.parquet(f"{self.path}/versions/{version}")

    def publish(self, df: DataFrame) -> bool:
        """Write ``df`` as the new version if its content differs from the current one; whether it did.

        One pass over ``df`` finds the digest. If it is new, a second pass writes the rows and takes
        the digest of what is written, so a source that changes in between is recorded as written. Of
        two writers at once, the pointer names the one that swapped it last, whole in either case.
        """
        if self.digest() == table_digest(df):
            return False
        version, seen = uuid.uuid4().hex, Observation("digest")
        df.observe(seen, *digest_columns(df)).write.parquet(f"{self.path}/versions/{version}")
        got = seen.get
        self._write(json.dumps(asdict(Digest(_schema_text(df), got["rows"], got["first"], got["second"]))), "digests", f"{version}.json")
        self._write(version, "CURRENT")
        return True
