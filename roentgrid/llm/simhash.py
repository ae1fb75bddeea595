"""SimHash near-duplicate classes with BK-trees.

Fingerprints that differ in at most RADIUS of 64 bits agree on all bits of three of five
blocks, so each distinct fingerprint is dealt to one bucket for each choice of three
blocks. A bucket's fingerprints are cut into shards; each shard becomes a BK-tree, whose
children are keyed by their integer Hamming distance to the parent, and the bucket's
fingerprints go to every shard of it. A search follows only edges within the radius of the
distance at hand. Per shard, a union-find keeps one link for each fingerprint to its class,
so that links grow with the fingerprints, not with their pairs; classes across shards are
the connected components of these links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .common import keyed, row_key, whole_text

WORDS = 3
RADIUS = 2
SEED = 42
SHARD = 1 << 13
# Five blocks of the 64 bits.
BLOCKS = [((1 << n) - 1) << at for n, at in ((13, 0), (13, 13), (13, 26), (13, 39), (12, 52))]
MASKS = [sum(BLOCKS[i] for i in chosen) for chosen in combinations(range(5), len(BLOCKS) - RADIUS)]
# Pairs of a query and a tree node that a search holds at a time.
FRONTIER = 1 << 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of UTF-8 text over its word shingles; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        pairs = zip(starts[k : k + (1 << 14)], ends[k : k + (1 << 14)], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > n).tolist())


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Stored table (doc_id, h, fp long): one row per document, h being the text part of its row key."""

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t.encode(), words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fps, pa.int64())], ["doc_id", "h", "fp"])

    rows = docs.select("doc_id", row_key()["h"].alias("h"), whole_text().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"doc_id {id_type}, h long, fp long"), "fingerprints")


class BKTree:
    """BK-tree of distinct 64-bit codes, built and searched a level at a time."""

    def __init__(self, codes: np.ndarray):
        self.codes, levels = codes, []
        nodes = np.array([0])  # of this level
        rest, above = np.arange(1, len(codes)), np.zeros(len(codes) - 1, np.int64)  # codes below them, and below which
        while len(rest):
            key = above * 65 + np.bitwise_count(codes[rest] ^ codes[nodes[above]])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            child = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            edges = key[heads]  # parent * 65 + distance, ascending
            levels.append((nodes, edges))
            nodes = rest[heads]
            inner = np.ones(len(rest), bool)
            inner[heads] = False
            rest, above = rest[inner], child[inner]
        levels.append((nodes, np.zeros(0, np.int64)))
        self.levels = levels

    def search(self, queries: np.ndarray, radius: int):
        """Yields (query number, code number) arrays of all pairs within the radius."""
        per = max(1, FRONTIER // max(1, len(self.codes)))
        for at in range(0, len(queries), per):
            own = queries[at : at + per]
            who, node = np.arange(len(own)), np.zeros(len(own), np.int64)
            for nodes, edges in self.levels:
                far = np.bitwise_count(own[who] ^ self.codes[nodes[node]]).astype(np.int64)
                hit = far <= radius
                yield at + who[hit], nodes[node[hit]]
                # Edges whose key lies within the radius of the distance.
                low = np.searchsorted(edges, node * 65 + np.maximum(far - radius, 0))
                high = np.searchsorted(edges, node * 65 + np.minimum(far + radius, 64), "right")
                n = high - low
                who = np.repeat(who, n)
                node = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                if not len(who):
                    break


def _classes(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' connected component, given links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        # Labels of labels.
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def shard_links(codes: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each query or code with a partner within the radius to one member of its class."""
    nodes, where = np.unique(np.r_[queries, codes], return_inverse=True)
    of_query, of_code = where[: len(queries)], where[len(queries) :]
    label = np.arange(len(nodes))
    for q, c in BKTree(codes).search(queries, radius):
        # Folded in batch by batch: memory holds one label a node, not the pairs.
        a, b = label[of_query[q]], label[of_code[c]]
        apart = a != b
        if apart.any():
            label = _classes(len(nodes), a[apart], b[apart])[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(codes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are the classes."""
    dealt = codes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in MASKS])).alias("mask", "key"))
    # A bucket with more codes than a shard holds is cut by a hash of the code.
    sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    several = dealt.join(sizes, ["mask", "key"]).withColumn("shards", F.ceil(F.col("n") / shard).cast("long"))
    own = F.pmod(F.xxhash64("fp", "mask"), F.col("shards"))
    copies = several.select("mask", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    rows = copies.select("mask", "key", "shard", "fp", (F.col("own") == F.col("shard")).alias("member"))
    partitions = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(partitions, "mask", "key", "shard").sortWithinPartitions("mask", "key", "shard")

    def run(batches):
        def solved(group):
            key, mine = group[:, :3], group[:, 3].view(np.uint64)
            member = group[:, 4].astype(bool)
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            out = []
            for i, j in zip(heads, np.r_[heads[1:], len(group)], strict=True):
                codes, queries = mine[i:j][member[i:j]], mine[i:j]
                if j - i == 2 and len(codes) == 2:  # most buckets
                    if np.bitwise_count(codes[0] ^ codes[1]) <= radius:
                        out.append((codes[:1], codes[1:]))
                elif len(codes):
                    out.append(shard_links(codes, queries, radius))
            a = np.concatenate([x for x, _ in out] or [np.zeros(0, np.uint64)])
            b = np.concatenate([x for _, x in out] or [np.zeros(0, np.uint64)])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held = np.zeros((0, 5), np.int64)
        for batch in batches:
            columns = [batch.column(c).cast(pa.int64()).to_numpy() for c in ("mask", "key", "shard", "fp", "member")]
            held = np.concatenate([held, np.column_stack(columns)])
            # The last shard may go on in the next batch.
            last = np.flatnonzero((held[:, :3] != held[-1, :3]).any(1)) if len(held) else held
            if len(last):
                yield solved(held[: last[-1] + 1])
                held = held[last[-1] + 1 :]
        if len(held):
            yield solved(held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): components of undirected links, by contraction; every round is stored.

    Each round hooks every node to its least neighbour, follows that twice, and goes on
    with the links between the nodes that are left.
    """
    left = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    left = stored(left.union(left.select("v", "u")).distinct(), "links")
    roots = None
    while not left.isEmpty():
        hook = stored(left.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "hooks")
        for _ in range(2):
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("u", F.col("pp").alias("p"))
        hook = stored(hook, "hooks")
        if roots is None:
            roots = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = hook.select(F.col("u").alias("root"), F.col("p").alias("__p"))
            roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("__p", "root").alias("root")), "roots")
        ends = left.join(hook, "u").select(F.col("p").alias("u"), "v")
        ends = ends.join(hook.select(F.col("u").alias("v"), F.col("p").alias("q")), "v").select("u", F.col("q").alias("v"))
        left = stored(ends.where("u <> v").distinct(), "links")
    if roots is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, h, fingerprint, component_id) of every row of ``fingerprints``.

    component_id is the least doc_id reachable over links of at most ``radius`` differing
    bits. Null and empty texts have fingerprint zero and are linked like any other; rows
    with a null id take part but name no class (a class of them alone has a null id);
    repeated rows share a class.
    """
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = stored(least, "codes")
    roots = connected(links(least, radius))
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp").select("doc_id", "h", text.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row with the least (doc_id, text hash), null ids last."""
    found = components(fingerprints(docs))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    # Pre-aggregated by class, one narrow row each; classes without any id go by their fingerprint.
    chosen = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("__fp")).agg(F.min(first).alias("f"))
    chosen = chosen.select(F.struct(F.col("f.id").alias("id"), F.col("f.h").alias("h")).alias("__key"))
    # Rows that are alike in key are copies: one of them.
    return keyed(docs).join(chosen, "__key", "left_semi").dropDuplicates(["__key"]).select("__row.*")
