"""What the training-data operators share: reading, Arrow mapping, and tables cut from their lineage."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..tables import cut, new_path, shared_dir, table  # noqa: F401  the operators import them from here

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_FIND = re.compile(WORD).findall
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search  # white space to str.split() alone
_LIBC = ctypes.CDLL(None)
#: Rows that an Arrow operator holds as Python objects at a time, and their bytes (one row at least).
ROWS, BYTES = 512, 1 << 22


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ROWS rows and BYTES bytes of strings, or of one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    total, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < batch.num_rows:
        end = min(at + ROWS, max(at + 1, int(np.searchsorted(total, total[at] + BYTES, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return what a task has freed to the operating system: workers live on, and may idle beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def map_rows(df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: StructType | str, start: Callable[[], None] = int, end: Callable[[], None] = int) -> DataFrame:
    """mapInArrow with plain Python rows: ``rows(lists of columns...)`` gets the columns of one of slices() and yields tuples of schema.

    ``start`` is called before the first rows of a task, ``end`` after the last, also when the task fails.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start()
        try:
            for batch in batches:
                for part in slices(batch):
                    out = list(rows(*(c.to_pylist() for c in part.columns)))
                    columns = list(zip(*out)) if out else [[] for _ in arrow]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        finally:
            end()
            give_back()

    return df.mapInArrow(run, schema)


def words_of(text: str) -> list[str]:
    """All matches of WORD."""
    return _FIND(text) if _ODD(text) else text.split()


def text_of(column: str = "text"):
    """A text column in which null is empty."""
    return F.coalesce(F.col(column), F.lit(""))
