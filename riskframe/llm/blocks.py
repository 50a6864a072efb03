"""Block dictionaries: per-document sums over corpus-wide figures of a document's terms.

A task cuts its documents into blocks of bounded size and emits one row per block and distinct term,
which lists the documents of the block that hold the term and how often. Terms are then counted,
and joined with their figures, once per block instead of once per occurrence; a term that every
document holds is no heavier than a rare one. The figures go back to the documents by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes of a block (one longer text makes a block of its own).
BLOCK_BYTES = 4 << 20

#: Documents (place in the block) that hold a term and how often.
ENTRIES = "array<struct<doc:int,n:int>>"
ENTRIES_ARROW = pa.list_(pa.struct([("doc", pa.int32()), ("n", pa.int32())]))


def numbers() -> Iterator[int]:
    """Numbers of this task's blocks, unique over the job (inside tasks only)."""
    n = TaskContext.get().partitionId() << 32
    while True:
        yield n
        n += 1


def entries(term: np.ndarray, doc: np.ndarray, n_terms: int, n_docs: int) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
    """Occurrences (term, document) as the terms present, their entries, and their totals."""
    key, n = np.unique(term.astype(np.int64) * n_docs + doc, return_counts=True)
    of = key // max(n_docs, 1)
    present, first = np.unique(of, return_index=True)
    ends = np.append(first, len(key))
    values = pa.StructArray.from_arrays([pa.array((key - of * n_docs).astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "n"])
    total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
    return present, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), total


def back_to_documents(rows: DataFrame, **sums: Column) -> DataFrame:
    """Per block and document: sums of columns of ``rows`` (block, entries, ...) over the entries, where ``n`` is the entry's count.

    The rows travel once more, by block, before the entries are taken out of them.
    """
    used = [c for c in rows.columns if c not in ("block", "entries")]
    return rows.repartition("block").select("block", *used, F.inline("entries")) \
        .groupBy("block", "doc").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
