"""Source divergence audit by three-dimensional cube partitioning.

Sources of a language are compared by the smoothed shares of its terms. Groups (language
and source) fall into blocks, terms into blocks, and a task owns one cell (group block,
group block, term block). The slice of a group block and a term block is replicated once
for each group block it meets, a cell works out the divergences of its pairs of groups over
its terms, and the partial sums are added along the term axis.

Shares are integers, billionths rounded down, and so are all sums: the result does not
depend on the order of anything.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .common import whole_text

IN_DOCUMENTS = 10
GROUPS_A_BLOCK = 64
TERMS_A_BLOCK = 4096
TOP_TERMS = 10
# Entries that a task counts in memory before it sends them on.
HELD = 400_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, n_docs), partly counted; every row's group comes with a null term as well.

    Terms are runs of ASCII letters and characters beyond ASCII, only A-Z in lower case;
    nulls count as empty.
    """

    def run(batches):
        counts: dict[tuple, list] = {}
        size = 0

        def flush():
            for (lang, source), (n, n_docs) in counts.items():
                terms = [None, *(t.decode() for t in n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string()),
                        pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(n_docs.__getitem__, n)], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "n_docs"],
                )

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, n_docs = counts.setdefault((lang, source), (Counter(), Counter()))
                words = Counter(text.encode().translate(_LETTERS).split())
                size -= len(n)
                n.update(words)
                n_docs.update(words.keys())
                size += len(n) + 1
                if size > held:
                    yield from flush()
                    counts, size = {}, 0
        yield from flush()

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], whole_text().alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")


def share(n: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10 ** 9 * (n + 2) / (total + 2 * n_terms)), exact for any counts below 10 ** 18; without terms the divisor is 1."""
    top = (n + 2).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", top, F.greatest(total + 2 * n_terms, F.lit(1)).cast("decimal(19,0)"))


def difference(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def tables(docs: DataFrame, in_documents: int = IN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: the groups (gid, lang, source, total, n_terms, n_groups) and the entries (lang, source, term, n).

    Entries are the kept terms that occur in a group. ``n_terms`` is the number of kept
    terms of the language, ``total`` the number of their occurrences in the group.
    """
    counted = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    counted = stored(counted, "terms")
    kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n_docs").alias("__d")).where(F.col("__d") >= in_documents)
    kept = stored(kept.select("lang", "term"), "kept")
    entries = stored(counted.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "entries")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(kept.groupBy("lang").agg(F.count("*").alias("n_terms")), "lang", "left")
    groups = groups.join(langs.na.fill(0, ["n_terms"]), "lang").withColumn("gid", F.monotonically_increasing_id())
    return stored(groups, "groups"), entries


def _block(column: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column), blocks).cast("int")


def _partial_sums(key: tuple, rows: pa.Table) -> pa.Table:
    """Divergences of the pairs of groups of one cell (language, block, block, term block), summed over its terms.

    ``rows`` hold the groups of both sides with their share of an absent term (null term)
    and their shares of the terms that occur. All other terms of the block would have the
    absent shares on both sides, so what a pair gets here is its difference to that.
    """
    term = rows.column("term")
    heads = rows.filter(pc.is_null(term))
    side, gid = (heads.column(c).to_numpy() for c in ("second", "gid"))
    absent = heads.column("p").to_numpy()
    gids, bases = [gid[side == s] for s in (0, 1)], [absent[side == s] for s in (0, 1)]
    own = key[1].as_py() == key[2].as_py()  # a block met by itself comes once
    orders = [np.argsort(g) for g in gids]
    gids, bases = ([x[o] for x, o in zip(pair, orders, strict=True)] for pair in (gids, bases))
    body = rows.filter(pc.is_valid(term))
    terms = pc.dictionary_encode(body.column("term").combine_chunks())
    n_terms = len(terms.dictionary)
    side, gid, p = (body.column(c).to_numpy() for c in ("second", "gid", "p"))
    place = terms.indices.to_numpy(zero_copy_only=False)
    shares = []
    for s in (0, 1):
        table = np.repeat(bases[s][:, None], n_terms, 1)
        at = side == s
        table[np.searchsorted(gids[s], gid[at]), place[at]] = p[at]
        shares.append(table)
    if own:
        gids[1], bases[1], shares[1] = gids[0], bases[0], shares[0]
    first, second, value = [], [], []
    for i in range(len(gids[0])):
        js = slice(i + 1 if own else 0, None)
        apart = (shares[0][i] - shares[1][js]) ** 2 // (shares[0][i] + shares[1][js])
        never = (bases[0][i] - bases[1][js]) ** 2 // (bases[0][i] + bases[1][js])
        first.append(np.full(len(never), gids[0][i]))
        second.append(gids[1][js])
        value.append(apart.sum(1) - n_terms * never)
    empty = [np.zeros(0, np.int64)]
    return pa.table({"g": np.concatenate(first or empty), "h": np.concatenate(second or empty), "value": np.concatenate(value or empty)})


def pair_divergences(groups: DataFrame, entries: DataFrame, groups_a_block: int = GROUPS_A_BLOCK, terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """(lang, source, item, value): the summed difference of every two sources of a language, both ways.

    Cells hold about 2 * ``groups_a_block`` groups and ``terms_a_block`` terms, whatever the
    size of the tables. Each slice goes to as many cells as its language has group blocks.
    """
    group_blocks = F.ceil(F.col("n_groups") / groups_a_block).cast("int")
    term_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / terms_a_block)).cast("int")
    located = groups.select(
        "lang", "source", "gid", "total", "n_terms", group_blocks.alias("blocks"), term_blocks.alias("term_blocks"),
        _block("source", group_blocks).alias("block"),
    )
    heads = located.select(
        "lang", "gid", F.lit(None).cast("string").alias("term"), share(F.lit(0).cast("bigint"), F.col("total"), F.col("n_terms")).alias("p"),
        "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("c"),
    )
    body = entries.join(located, ["lang", "source"]).select(
        "lang", "gid", "term", share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"), "block", "blocks",
        _block("term", F.col("term_blocks")).alias("c"),
    )
    slices = heads.unionByName(body).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = slices.select(
        "lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "c",
        (F.col("block") > F.col("other")).cast("int").alias("second"), "gid", "term", "p",
    )
    parts = cells.groupBy("lang", "a", "b", "c").applyInArrow(_partial_sums, "g long, h long, value long")
    sums = parts.groupBy("g", "h").agg(F.sum("value").alias("value"))
    side = groups.select("gid", "lang", "source", "n_terms", share(F.lit(0).cast("bigint"), F.col("total"), F.col("n_terms")).alias("p"))
    one = side.select(F.col("gid").alias("g"), "lang", "n_terms", F.col("source").alias("s"), F.col("p").alias("p"))
    two = side.select(F.col("gid").alias("h"), F.col("source").alias("t"), F.col("p").alias("q"))
    named = sums.join(one, "g").join(two, "h").select(
        "lang", "s", "t", (F.col("value") + F.col("n_terms") * difference(F.col("p"), F.col("q"))).alias("value")
    )
    both = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    return named.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def telling_terms(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a source has more of than its language, with their difference."""
    per_term = entries.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    per_lang = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.max("n_terms").alias("n_terms"))
    shares = per_term.join(per_lang, "lang").select("lang", "term", share(F.col("all_n"), F.col("all_total"), F.col("n_terms")).alias("q"))
    own = entries.join(groups.select("lang", "source", "total", "n_terms"), ["lang", "source"])
    own = own.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"))
    both = own.join(shares, ["lang", "term"]).where("p > q")
    return both.select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, in_documents: int = IN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language (part ``pair``), and the ``top_terms`` most telling terms (``term``).

    Ranks count from 1, by value, greatest first, then by item. Null languages, sources and
    texts count as empty ones; repeated rows are documents of their own; ids and other
    columns are not read. A language without kept terms has pairs of value 0 and no terms;
    a language of one source has no pairs; an empty table gives no rows.
    """
    groups, entries = tables(docs, in_documents)
    rank = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_divergences(groups, entries).withColumn("rank", F.row_number().over(rank))
    terms = telling_terms(groups, entries).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
