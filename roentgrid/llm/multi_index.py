"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own k-means codebook, so that the
pairs of centroids are K * K cells. A query walks the pairs in the order of their summed
distance with a heap, until the cells passed hold a given share of all entries, and the
entries of these cells are ranked by their exact inner product.

One more component, sqrt(M^2 - |x|^2) with M the largest norm, makes the order of distances
that of inner products for vectors of any length. Entries lie in blocks: all cells with the
same first centroid, cut further where they hold many entries; queries come in groups, and
each pair of a block and a group is one matrix product.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored

NEAREST = 20
CENTROIDS = 32
# Rows the codebooks are fitted on; every row is indexed.
SAMPLE = 20_000
# Share of all entries in the cells that a query visits: recall of at least 0.9 even where vectors hardly cluster.
SHARE = 0.6
BLOCK = 1 << 12
QUERY_GROUP = 1 << 14


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the rows that take part.

    Left out: null ids and vectors, zero vectors, null or non-finite components, and
    vectors of another length than most.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["n"] if sizes else 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids by Lloyd's rounds, from k spread rows of the distinct points."""
    points = np.unique(points, axis=0)
    centroids = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(rounds):
        near = nearest(points, centroids)
        for j in range(len(centroids)):
            own = points[near == j]
            if len(own):
                centroids[j] = own.mean(0)
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(points, centroids).argmin(1)


def halves(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of entries, the second with the component that evens out the norms."""
    even = np.sqrt(np.maximum(reach**2 - (x**2).sum(1), 0))[:, None]
    return x[:, : x.shape[1] // 2], np.hstack([x[:, x.shape[1] // 2 :], even])


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: float):
    """Pairs (i, j) in the order of first[i] + second[j], until their sizes add up to ``enough``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    heap, held, reached = [(da[0] + db[0], 0, 0)], 0, [0] * len(a)  # reached[i]: columns pushed of row i
    reached[0] = 1
    while heap and held < enough:
        _, i, j = heappop(heap)
        yield a[i], b[j]
        held += sizes[a[i], b[j]]
        # A pair follows once its left and upper neighbours have been passed.
        if j + 1 < len(db) and reached[i] == j + 1 and (i == 0 or reached[i - 1] > j + 1):
            heappush(heap, (da[i] + db[j + 1], i, j + 1))
            reached[i] += 1
        if i + 1 < len(da) and reached[i + 1] == j:
            heappush(heap, (da[i + 1] + db[j], i + 1, j))
            reached[i + 1] += 1


def matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, share: float = SHARE, centroids: int = CENTROIDS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best entries found for each query, a query's own id left out.

    ``queries`` is a subset of the rows of ``vectors`` (vec_id, embedding). Ties go to the
    smaller vec_id; copies of a vector are entries of their own; a query with fewer entries
    gets all that are there; an empty table gives no rows. share=1 is an exhaustive search.
    """
    spark = vectors.sparkSession
    entries = stored(valid_vectors(vectors), "vectors")
    asked = queries.select("vec_id").distinct().join(entries, "vec_id")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    total, reach = entries.agg(F.count("*"), F.max(norm)).first()
    if not total:
        return empty
    fitted = np.array([r["x"] for r in entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()])
    books = [kmeans(h, centroids) for h in halves(fitted, reach)]

    def assign(batches):
        for batch in batches:
            first, second = halves(matrix(batch.column("x")), reach) if batch.num_rows else (np.zeros((0, 1)),) * 2
            cells = [nearest(h, c) if len(h) else np.zeros(0, np.int64) for h, c in zip((first, second), books, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), *map(pa.array, cells)], ["vec_id", "x", "a", "b"])

    indexed = stored(entries.mapInArrow(assign, "vec_id long, x array<double>, a long, b long"), "cells")
    # At most K * K cells.
    sizes = np.zeros([len(c) for c in books], np.int64)
    for a, b, n in indexed.groupBy("a", "b").count().collect():
        sizes[a, b] = n
    blocks = np.maximum(1, -(-sizes.sum(1) // BLOCK)).tolist()
    groups = max(1, -(-asked.count() // QUERY_GROUP))

    def visits(batches):
        for batch in batches:
            x = matrix(batch.column("x"))
            if not len(x):
                continue
            half = x.shape[1] // 2
            dist = [distances(x[:, :half], books[0]), distances(np.hstack([x[:, half:], np.zeros((len(x), 1))]), books[1])]
            rows, cell, seen = [], [], []
            for q in range(len(x)):
                passed = {}
                for a, b in walk(dist[0][q], dist[1][q], sizes, share * total):
                    passed.setdefault(int(a), []).append(int(b))
                rows += [q] * len(passed)
                cell += passed.keys()
                seen += passed.values()
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(rows), batch.column("x").take(rows), pa.array(cell, pa.int64()), pa.array(seen, pa.list_(pa.int64()))],
                ["vec_id", "x", "a", "seen"],
            )

    def numbers(n):
        return F.sequence(F.lit(0).cast("long"), n - 1)

    count = F.element_at(F.array(*[F.lit(n).cast("long") for n in blocks]), (F.col("a") + 1).cast("int"))
    nothing = F.array().cast("array<long>")
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    left = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id", "a"), count)).withColumn("grp", F.explode(numbers(F.lit(groups).cast("long"))))
    left = left.select("a", "block", "grp", F.lit(0).alias("kind"), "vec_id", "x", "b", nothing.alias("seen"))
    right = asked.mapInArrow(visits, "vec_id long, x array<double>, a long, seen array<long>").withColumn("grp", group)
    right = right.withColumn("block", F.explode(numbers(count)))
    right = right.select("a", "block", "grp", F.lit(1).alias("kind"), "vec_id", "x", F.lit(0).cast("long").alias("b"), "seen")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = left.unionByName(right).repartition(partitions, "a", "block", "grp").sortWithinPartitions("a", "block", "grp", "kind")

    def best(ids, x, b, queries, own_ids, seen):
        """The k best entries of a block for each query, as (query row, vec_id, score)."""
        allowed = np.zeros((len(queries), sizes.shape[1]), bool)
        for row, cells in enumerate(seen):
            allowed[row, cells] = True
        near = np.where(allowed[:, b] & (ids != own_ids[:, None]), queries @ x.T, -np.inf)
        if len(ids) > k:
            # Rounding differs by place in a product, so ties are taken generously and settled below.
            least = np.partition(near, len(ids) - k, axis=1)[:, [len(ids) - k]]
            near = np.where(near >= least - 1e-9 * np.maximum(1, np.abs(least)), near, -np.inf)
        row, at = np.nonzero(near > -np.inf)
        score = (queries[row] * x[at]).sum(1)
        order = np.lexsort((ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        first = np.searchsorted(row, np.arange(len(queries)))
        keep = np.arange(len(row)) - first[row] < k
        return row[keep], ids[at[keep]], score[keep]

    def rank(batches):
        key = ids = x = b = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("a", "block", "grp", "kind")])
            vectors, vec_ids, cells = matrix(batch.column("x")), batch.column("vec_id").to_numpy(), batch.column("b").to_numpy()
            seen = batch.column("seen").to_pylist()
            heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            out = []
            for i, j in zip(heads, np.r_[heads[1:], len(keys)], strict=True):
                here = tuple(keys[i, :3])
                if keys[i, 3] == 0:
                    if here == key:  # goes on from the last batch
                        ids, x, b = np.r_[ids, vec_ids[i:j]], np.vstack([x, vectors[i:j]]), np.r_[b, cells[i:j]]
                    else:
                        key, ids, x, b = here, vec_ids[i:j].copy(), vectors[i:j].copy(), cells[i:j].copy()
                elif here == key:
                    for s in range(i, j, 256):
                        e = min(j, s + 256)
                        row, found, score = best(ids, x, b, vectors[s:e], vec_ids[s:e], seen[s:e])
                        out.append((vec_ids[s:e][row], found, score))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id")))
    top = found.groupBy("query_id").agg(F.slice(ordered, 1, k).alias("top"))
    each = top.select("query_id", F.posexplode("top").alias("at", "t"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.less")).alias("score"))
