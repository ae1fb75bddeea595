"""Similarity of two sets of embedded items per pair.

Items of a side come in blocks of bounded size. The block pairs of a pair are the cells
of a grid: a block goes once to every block of the other side, under a key of the pair
and both block numbers, so no key holds more than one cell. A cell is one matrix product
inside a task, of which only the best value per item leaves the task, never the matrix.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import text
from ...functions.hashing import hash_bucket, hash_order
from ...sources.sinks import work_folder
from ..skew import collect_parts

BLOCK = 512


def _blocks(items: DataFrame, block: int) -> DataFrame:
    # Copies of an item in one set are scored once and keep their weight.
    unique = items.groupBy("pair_id", "side", "item_id", "item_type").agg(
        F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    unique = unique.withColumn("__h", hash_order("block", "item_id", "item_type"))
    value = F.struct("item_id", "item_type", "copies", "embedding")
    unique = unique.withColumn("__o", F.struct("__h", "item_id", "item_type"))
    # How many blocks the other side has; pairs without another side drop out.
    opposite = F.when(F.col("side") == "hyp", "ref").when(F.col("side") == "ref", "hyp")
    others = unique.groupBy("pair_id", "side").agg(F.ceil(F.count("*") / block).cast("bigint").alias("others"))
    others = others.select("pair_id", opposite.alias("side"), "others")
    parts = collect_parts(
        unique, ["pair_id", "side"], "__o", value, block, "items", bucket=hash_bucket(F.col("__h")), groups=others
    )
    cells = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)))
    columns = [F.col("items")[c].alias(c) for c in ("item_id", "item_type", "copies", "embedding")]
    return cells.select("pair_id", "side", "part", "other", *columns)


def block_pairs(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair_id, h_block, r_block, the items of both blocks): one row for each cell of a pair's grid."""
    blocks = _blocks(items, block)

    def side(name, prefix, own, other):
        rows = blocks.where(F.col("side") == name)
        columns = [F.col(c).alias(f"{prefix}_{c}") for c in ("item_id", "item_type", "copies", "embedding")]
        return rows.select("pair_id", F.col(own).alias("h_block"), F.col(other).alias("r_block"), *columns)

    return side("hyp", "h", "part", "other").join(side("ref", "r", "other", "part"), ["pair_id", "h_block", "r_block"])


def best_matches(items: DataFrame, affinity: dict | None = None, block: int = BLOCK) -> DataFrame:
    """Per item its most similar item of the other side of the pair.

    items(pair_id, side 'hyp'|'ref', item_id, item_type, embedding). Similarity is
    the cosine, times affinity[(hyp type, ref type)] (1 if unlisted) when given.
    Gives (pair_id, side, item_id, item_type, copies, similarity, partner) for pairs
    that have both sides.
    """
    weights = None if affinity is None else dict(affinity)
    met = block_pairs(items.select("pair_id", "side", "item_id", "item_type", "embedding"), block).drop("h_block", "r_block")
    pair_type = met.schema["pair_id"].dataType.simpleString()
    id_type = met.schema["h_item_id"].dataType.elementType.simpleString()
    schema = (
        f"pair_id {pair_type}, side string, item_id {id_type}, item_type string, copies bigint, "
        f"similarity double, partner {id_type}"
    )

    def score(batches):
        import numpy as np
        import pyarrow as pa

        def unit(vectors):
            m = np.array(vectors, dtype=np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(norm == 0, 1, norm)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                pair = row["pair_id"].as_py()
                h_ids, r_ids = row["h_item_id"].as_py(), row["r_item_id"].as_py()
                h_types, r_types = row["h_item_type"].as_py(), row["r_item_type"].as_py()

                def matrix(name):
                    vectors = row[name].values
                    return unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))

                sim = matrix("h_embedding") @ matrix("r_embedding").T
                if weights is not None:
                    hs, hi = np.unique(h_types, return_inverse=True)
                    rs, ri = np.unique(r_types, return_inverse=True)
                    table = np.array([[weights.get((a, b), 1.0) for b in rs.tolist()] for a in hs.tolist()])
                    sim = sim * table[hi][:, ri]
                to_ref, to_hyp = sim.argmax(axis=1), sim.argmax(axis=0)
                best_h = sim[np.arange(len(h_ids)), to_ref]
                best_r = sim[to_hyp, np.arange(len(r_ids))]
                n = len(h_ids) + len(r_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([pair] * n, type=batch.schema.field("pair_id").type),
                        pa.array(["hyp"] * len(h_ids) + ["ref"] * len(r_ids)),
                        pa.array(h_ids + r_ids),
                        pa.array(h_types + r_types, type=pa.string()),
                        pa.array(row["h_copies"].as_py() + row["r_copies"].as_py(), type=pa.int64()),
                        pa.array(np.concatenate([best_h, best_r])),
                        pa.array([r_ids[k] for k in to_ref] + [h_ids[k] for k in to_hyp]),
                    ],
                    names=["pair_id", "side", "item_id", "item_type", "copies", "similarity", "partner"],
                )

    scored = met.mapInArrow(score, schema)
    best = F.max(F.struct("similarity", "partner")).alias("b")
    return scored.groupBy("pair_id", "side", "item_id", "item_type").agg(F.max("copies").alias("copies"), best).select(
        "pair_id", "side", "item_id", "item_type", "copies", "b.similarity", "b.partner"
    )


def _side_means(matches: DataFrame) -> DataFrame:
    weight = F.col("copies")

    def mean(name):
        here = F.col("side") == name
        return F.sum(F.when(here, F.col("similarity") * weight)) / F.sum(F.when(here, weight))

    return matches.groupBy("pair_id").agg(mean("hyp").alias("by_hyp"), mean("ref").alias("by_ref"))


def max_mean_cosine(items: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per pair the mean of row maxima and of column maxima, averaged; 0 if a side is empty."""
    means = _side_means(best_matches(items, None, block))
    score = F.coalesce((F.col("by_hyp") + F.col("by_ref")) / 2, F.lit(0.0)).alias("similarity")
    return pairs.select("pair_id").distinct().join(means, "pair_id", "left").select("pair_id", score)


def similarity_cells(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The cells of the similarity matrix that matter: each row's and each column's maximum.

    A cell that is both comes once with both flags set.
    """
    m = best_matches(items, None, block)
    hyp = F.col("side") == "hyp"
    cells = m.select(
        "pair_id",
        F.when(hyp, F.col("item_id")).otherwise(F.col("partner")).alias("hyp_item"),
        F.when(hyp, F.col("partner")).otherwise(F.col("item_id")).alias("ref_item"),
        "similarity",
        hyp.alias("row_max"),
        (~hyp).alias("col_max"),
    )
    return cells.groupBy("pair_id", "hyp_item", "ref_item").agg(
        F.max("similarity").alias("similarity"), F.max("row_max").alias("row_max"), F.max("col_max").alias("col_max")
    )


def entity_affinity_f1(items: DataFrame, pairs: DataFrame, affinity: dict, block: int = BLOCK) -> DataFrame:
    """Per pair precision, recall and F1 of type-weighted best cosines.

    Without entities on both sides the F1 is 0.5, without them on one side it is 0.
    """
    means = _side_means(best_matches(items, affinity, block))
    sides = items.groupBy("pair_id").agg(F.countDistinct("side").alias("sides"))
    rows = pairs.select("pair_id").distinct().join(means, "pair_id", "left").join(sides, "pair_id", "left")
    p, r = F.col("by_hyp"), F.col("by_ref")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    none = F.col("sides").isNull()
    return rows.select(
        "pair_id",
        F.coalesce(p, F.lit(0.0)).alias("precision"),
        F.coalesce(r, F.lit(0.0)).alias("recall"),
        F.when(none, F.lit(0.5)).when(F.col("sides") == 1, F.lit(0.0)).otherwise(f1).alias("f1"),
    )


def entity_rewards(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair simple, partial and complete entity F1.

    entities(pair_id, side, entity_id, tokens, label, relation, target_tokens), one
    row per relation; relation is null for an entity without any. simple compares
    (tokens, label); partial adds whether there is a relation; complete compares
    (tokens, label) of entities without relations and else every relation.
    """
    related = F.col("relation").isNotNull()
    none = F.lit(None).cast("string")

    def tuple_of(kind, *extra):
        return F.struct(F.lit(kind).alias("kind"), F.col("tokens"), F.col("label"), *extra)

    complete = tuple_of("complete", related.cast("string").alias("x"), F.col("relation").alias("y"), F.col("target_tokens").alias("z"))
    tuples = F.array(
        tuple_of("simple", none.alias("x"), none.alias("y"), none.alias("z")),
        tuple_of("partial", related.cast("string").alias("x"), none.alias("y"), none.alias("z")),
        complete,
    )
    rows = entities.select("pair_id", "side", F.explode(tuples).alias("t"))
    sides = rows.groupBy("pair_id", "t").agg(
        F.max((F.col("side") == "hyp").cast("int")).alias("h"), F.max((F.col("side") == "ref").cast("int")).alias("r")
    )
    sums = sides.groupBy("pair_id", "t.kind").agg(
        F.sum("h").alias("nh"), F.sum("r").alias("nr"), F.sum(F.col("h") * F.col("r")).alias("hits")
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("nh") + F.col("nr")), F.lit(0.0))
    kinds = ("simple", "partial", "complete")
    scores = sums.groupBy("pair_id").agg(*[F.max(F.when(F.col("kind") == k, f1)).alias(k) for k in kinds])
    out = pairs.select("pair_id").distinct().join(scores, "pair_id", "left")
    return out.na.fill(0.0, list(kinds))


def report_facts(sentences: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct facts per report in order of appearance.

    sentences(report_id, sentence_no, sentence), facts(sentence, facts array). A
    sentence without facts stands for itself if it holds a letter. Gives
    (report_id, sentence_no, fact_no, fact) at the fact's first appearance.
    """
    rows = sentences.withColumn("sentence", text.strip("sentence"))
    rows = rows.withColumn("__key", text.text_key("sentence"))
    known = facts.select(text.text_key("sentence").alias("__key"), "facts")
    rows = rows.join(known, "__key", "left")
    own = F.when(F.col("sentence").rlike(r"\p{L}"), F.array("sentence"))
    listed = F.when(F.coalesce(F.size("facts"), F.lit(0)) > 0, F.col("facts")).otherwise(own)
    rows = rows.select("report_id", "sentence_no", F.posexplode(listed).alias("fact_no", "fact"))
    first = F.min(F.struct("sentence_no", "fact_no")).alias("at")
    return rows.groupBy("report_id", "fact").agg(first).select("report_id", "at.sentence_no", "at.fact_no", "fact")


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = os.path.join(folder, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def fact_score(pairs: DataFrame, extractor, encoder, folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """Similarity of the facts of two reports.

    pairs(pair_id, hyp, ref). ``extractor`` maps rows (key, text) to (key, facts) and
    ``encoder`` maps them to (key, embedding). Model runs are the dear part: each sees
    every distinct text once, and their results are written to ``folder`` (by default
    a new one in the session's checkpoint folder) rather than computed again.
    """
    folder = folder or work_folder(pairs.sparkSession, "facts")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in ("hyp", "ref")])
    long = pairs.select("pair_id", F.explode(sides).alias("s"))
    long = long.select("pair_id", "s.side", F.posexplode(text.sentences("s.text")).alias("sentence_no", "sentence"))
    long = long.select(F.struct("pair_id", "side").alias("report_id"), "sentence_no", text.strip("sentence").alias("sentence"))
    keyed = long.select(text.text_key("sentence").alias("key"), F.col("sentence").alias("text")).dropDuplicates(["key"])
    facts = _stored(extractor(keyed), folder, "extracted").join(keyed, "key").select(F.col("text").alias("sentence"), "facts")
    found = report_facts(long, facts).withColumn("fact", text.strip("fact")).where(F.col("fact") != "")
    found = _stored(found.withColumn("key", text.text_key("fact")), folder, "found")
    unique = found.select("key", F.col("fact").alias("text")).dropDuplicates(["key"])
    items = found.join(_stored(encoder(unique), folder, "encoded"), "key").select(
        "report_id.pair_id", "report_id.side", F.col("key").alias("item_id"), F.lit("").alias("item_type"), "embedding"
    )
    return max_mean_cosine(items, pairs, block)
