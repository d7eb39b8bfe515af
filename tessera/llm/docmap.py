"""Arrow plumbing shared by the operators that map whole documents to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def utf8_list(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is the empty text."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def map_documents(
    docs: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Run ``fn`` over Arrow batches of (id, text); no shuffle, other columns never leave the scan."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(fn, schema)
