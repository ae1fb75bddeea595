"""Concatenate and cut: documents end to end in one token stream, cut into equal windows.

Pass one encodes every text once and stores its ids with the number of ids before it in
its partition. The totals of the partitions, one number each, give the global offset of
every partition. Pass two cuts at the multiples of the window and gives one boundary
record for each piece of a document in a sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .common import whole_text
from .tokens import VOCABULARY, encoder

END = 1
WINDOW = 2048


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end: int | None = END) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids): uint16 ids of every row and the ids in front of it in its partition."""
    tail = b"" if end is None else np.array([end], "<u2").tobytes()

    def run(batches):
        encode, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encode(t) + tail for t in batch.column("text").to_pylist()]
            n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ids), part)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "before", "n_tokens", "ids"],
            )

    rows = docs.select("doc_id", whole_text().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, part long, before long, n_tokens long, ids binary")


def concat_and_cut(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` holds the piece as little-endian uint32. Sequences are numbered from 0 and all
    but the last are full. A null text is empty and still has its end id; repeated rows
    and null ids are documents of their own; an empty table gives no rows.
    """
    pieces = stored(encoded(docs, vocabulary, end), "ids")
    # One row per input partition.
    totals = pieces.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    offsets = totals.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("first"))
    placed = pieces.join(F.broadcast(offsets), "part").select("doc_id", (F.col("first") + F.col("before")).alias("at"), "n_tokens", "ids")

    def run(batches):
        for batch in batches:
            rows, begin, length, ids = [], [], [], []
            for k, (at, blob) in enumerate(zip(batch.column("at").to_numpy(), batch.column("ids"), strict=True)):
                own = np.frombuffer(blob.as_buffer(), "<u2").astype("<u4")
                cuts = [0, *range(int(window - at % window), len(own), window), len(own)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    rows.append(k)
                    begin.append(a)
                    length.append(b - a)
                    ids.append(own[a:b].tobytes())
            rows, begin = np.array(rows, np.int64), np.array(begin, np.int64)
            at = batch.column("at").to_numpy()[rows] + begin
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)), pa.array(begin), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                    batch.column("n_tokens").take(pa.array(rows)), pa.array(at // window), pa.array(at % window),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Boundary records with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
