"""Shared column helpers of the operators in this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_text() -> Column:
    """The text of a row, null as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def row_key() -> Column:
    """Key of a row by its id and text, for joining decisions back to rows.

    Identical rows share a key and every decision here is a function of it. As a struct,
    a null id matches a null id in a plain equi-join.
    """
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("h"))


def remainder(modulus: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo: the folds that labels or counts are learned from. Null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % modulus


def in_fold(modulus: int, rest: int) -> Column:
    """Whether a row is held out; a row without an id is never held out."""
    return F.coalesce(remainder(modulus) == rest, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column without nulls, and the n + 1 offsets into them."""
    a = column.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def batches_of(offsets: np.ndarray, most: int):
    """Row ranges [i, j) of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def keyed(docs: DataFrame) -> DataFrame:
    """(__row, __key): rows as one struct next to their keys, whatever their columns are called."""
    return docs.select(F.struct(*docs.columns).alias("__row"), row_key().alias("__key"))


def keep(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose key is (left_semi) or is not (left_anti) in ``decided`` (column __key)."""
    return keyed(docs).join(decided.select("__key"), "__key", how).select("__row.*")
