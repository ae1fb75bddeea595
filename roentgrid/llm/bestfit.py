"""Best-fit-decreasing packing into id matrices.

Every task encodes its documents, and packs them shard by shard: a shard is a run of
documents of a bounded number of tokens. Documents longer than a row are split into full
rows and a rest, losslessly; the rests and all other documents are placed longest first,
each into the open row with the least room that still takes it. No row moves between
tasks, and a lost task is simply run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .packing import END, WINDOW
from .tokens import VOCABULARY, encoder

SHARD_TOKENS = 1 << 22


class RoomTree:
    """Open rows by the room left in them; a segment tree over 0..capacity finds the least that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room >= ``least``, removed; None if there is none."""
        node = least + self.leaves
        if not self.count[node]:
            # Up to the first right neighbour with open rows, then down its left edge.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths, capacity: int) -> list[list[int]]:
    """Rows of item numbers, items placed longest first (ties: first come) with best fit. Lengths are 1..capacity."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


def pack_shard(docs: list[tuple[object, bytes]], capacity: int):
    """Packed rows of a shard: lists of (doc id, start in the document, uint16 ids)."""
    pieces, out = [], []
    for doc_id, blob in docs:
        ids = np.frombuffer(blob, "<u2")
        for start in range(0, len(ids), capacity):
            piece = (doc_id, start, ids[start : start + capacity])
            if len(piece[2]) == capacity:
                out.append([piece])
            else:
                pieces.append(piece)
    return out + [[pieces[i] for i in row] for row in best_fit([len(p[2]) for p in pieces], capacity)]


def best_fit_matrices(
    docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end: int = END, pad: int = 0, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Packed rows: (sequence_id, ids, n_tokens, cu_seqlens, position_resets, doc_ids, doc_starts).

    ``ids`` is a row of the id matrix: ``window`` little-endian uint16, padded with ``pad``
    after ``n_tokens``. Segment k of a row lies in [cu_seqlens[k], cu_seqlens[k + 1]) and
    holds ids of document doc_ids[k] from doc_starts[k] on; positions restart at 0 at every
    entry of ``position_resets``, which also marks the padding. sequence_id is unique. A
    null text is empty and has its end id only; repeated rows and null ids are documents
    of their own; an empty table gives no rows.
    """
    tail = np.array([end], "<u2").tobytes()
    rows = docs.select("doc_id", whole_text().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def matrix(packed, first, arrow_id):
        n = [sum(len(p[2]) for p in row) for row in packed]
        blobs = [np.concatenate([p[2] for p in row] + [np.full(window - m, pad, "<u2")]).tobytes() for row, m in zip(packed, n, strict=True)]
        bounds = [np.cumsum([0, *(len(p[2]) for p in row)]).tolist() for row in packed]
        resets = [b if b[-1] < window else b[:-1] for b in bounds]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(range(first, first + len(packed)), pa.int64()), pa.array(blobs, pa.binary()), pa.array(n, pa.int32()),
                pa.array(bounds, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())),
                pa.array([[p[0] for p in row] for row in packed], pa.list_(arrow_id)),
                pa.array([[p[1] for p in row] for row in packed], pa.list_(pa.int64())),
            ],
            ["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"],
        )

    def run(batches):
        encode, first = encoder(vocabulary), TaskContext.get().partitionId() << 32
        shard, size, arrow_id = [], 0, pa.int64()
        for batch in batches:
            arrow_id = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                blob = encode(text) + tail
                shard.append((doc_id, blob))
                size += len(blob) // 2
                if size >= shard_tokens:
                    packed = pack_shard(shard, window)
                    yield matrix(packed, first, arrow_id)
                    first, shard, size = first + len(packed), [], 0
        if shard:
            yield matrix(pack_shard(shard, window), first, arrow_id)

    return rows.mapInArrow(
        run,
        "sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
        f"doc_ids array<{id_type}>, doc_starts array<long>",
    )


def with_position_ids(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds position_ids, an array of ``window`` positions that restart at every reset."""
    ends = F.concat(F.slice("position_resets", 2, F.greatest(F.size("position_resets") - 1, F.lit(0))), F.array(F.lit(window)))
    runs = F.zip_with("position_resets", ends, lambda a, b: F.sequence(F.lit(0), b - a - 1))
    return packed.withColumn("position_ids", F.flatten(runs))


def write_matrices(packed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store packed rows as Parquet, one row of the id matrix per record."""
    packed.write.mode(mode).parquet(path)
