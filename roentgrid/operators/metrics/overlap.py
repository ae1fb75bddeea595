"""Word-overlap scores: BLEU, ROUGE-N, ROUGE-L, ROUGE-Lsum.

Pairs are rows (pair_id, hyp, ref). Everything about a pair is worked out inside its row:
the n-grams of both sides are hashed, sorted together and merged, so nothing is shuffled
and each row keeps its place.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import text


def _blank_tokens(col: str) -> Column:
    return F.array_remove(F.split(text.squeeze_ws(col), " "), "")


def rouge_tokens(col) -> Column:
    """Lower-case runs of a-z and 0-9."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), "")


def _longer(grams: Column, words: Column, n: int) -> Column:
    """Hashes of the n-grams, from those of the (n - 1)-grams and of the words."""
    many = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(grams, F.lit(1), many), F.slice(words, F.lit(n), many), lambda a, b: F.xxhash64(a, b))


def _common(hyp: Column, ref: Column) -> Column:
    """Size of the intersection of two multisets of hashes.

    If no hash comes twice on one of the sides, it is that of two sets. Else both go into one sorted array, the last bit telling the side: in a run of one hash the
    hypothesis comes first and every reference item takes one of its items that are left.
    """
    sided = F.concat(
        F.transform(hyp, lambda x: F.shiftleft(x, 1)), F.transform(ref, lambda x: F.shiftleft(x, 1).bitwiseOR(F.lit(1).cast("bigint")))
    )

    def step(a: Column, x: Column) -> Column:
        gram, same = F.shiftright(x, 1), a["gram"] == F.shiftright(x, 1)
        hit = same & (a["left"] > 0)
        from_hyp = x.bitwiseAND(F.lit(1).cast("bigint")) == 0
        left = F.when(from_hyp, F.when(same, a["left"] + 1).otherwise(1)).otherwise(F.when(hit, a["left"] - 1).otherwise(0))
        return F.struct(gram.alias("gram"), left.alias("left"), (a["hits"] + F.when(hit & ~from_hyp, 1).otherwise(0)).alias("hits"))

    start = F.struct(F.lit(0).cast("bigint").alias("gram"), F.lit(0).alias("left"), F.lit(0).alias("hits"))
    merged = F.aggregate(F.sort_array(sided), start, step, lambda a: a["hits"])

    def no_copies(x: Column) -> Column:
        return F.size(F.array_distinct(x)) == F.size(x)

    return F.when(no_copies(hyp) | no_copies(ref), F.size(F.array_intersect(hyp, ref))).otherwise(merged).cast("bigint")


def _matches(pairs: DataFrame, tokens, orders: list[int]) -> DataFrame:
    """Per pair and n: clipped n-gram matches; and the token counts of both sides."""

    def words(col: str) -> Column:
        return F.transform(tokens(col), lambda t: F.xxhash64(t))

    none = F.array().cast("array<bigint>")
    rows = pairs.select("pair_id", F.coalesce(words("hyp"), none).alias("h1"), F.coalesce(words("ref"), none).alias("r1"))
    for n in range(2, max(orders) + 1):
        rows = rows.withColumns({f"{s}{n}": _longer(F.col(f"{s}{n - 1}"), F.col(f"{s}1"), n) for s in "hr"})
    return rows.select(
        "pair_id", *[_common(F.col(f"h{n}"), F.col(f"r{n}")).alias(f"m{n}") for n in orders],
        F.size("h1").alias("hyp_len"), F.size("r1").alias("ref_len"),
    )


def _bleu(n: int) -> Column:
    # m<k> and d<k> hold matches and n-gram counts of order k.
    logs = None
    for k in range(1, n + 1):
        term = F.ln(F.col(f"m{k}") / F.col(f"d{k}"))
        logs = term if logs is None else logs + term
    brevity = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - F.col("ref_len") / F.col("hyp_len"))
    )
    smallest = F.least(*[F.col(f"m{k}") for k in range(1, n + 1)]) if n > 1 else F.col("m1")
    return F.when(smallest == 0, F.lit(0.0)).otherwise(brevity * F.exp(logs / n))


def bleu_counts(pairs: DataFrame, n: int = 4) -> DataFrame:
    orders = list(range(1, n + 1))
    counts = _matches(pairs, _blank_tokens, orders)
    return counts.withColumns({f"d{k}": F.greatest(F.col("hyp_len") - k + 1, F.lit(0)).cast("bigint") for k in orders})


def bleu(pairs: DataFrame, n: int = 4) -> DataFrame:
    """Per pair BLEU-1..n, unsmoothed, on white-space tokens."""
    counts = bleu_counts(pairs, n)
    return counts.select("pair_id", *[_bleu(k).alias(f"bleu_{k}") for k in range(1, n + 1)])


def corpus_bleu(pairs: DataFrame, n: int = 4) -> DataFrame:
    """One row of BLEU-1..n with matches and lengths summed over the corpus."""
    counts = bleu_counts(pairs, n)
    sums = counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c != "pair_id"])
    return sums.select(*[_bleu(k).alias(f"bleu_{k}") for k in range(1, n + 1)])


def _f1(hits, hyp, ref) -> Column:
    p, r = F.try_divide(hits, hyp), F.try_divide(hits, ref)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def rouge_n(pairs: DataFrame, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Per pair ROUGE-N F for each order."""
    counts = _matches(pairs, rouge_tokens, list(orders))

    def grams(side, n):
        return F.greatest(F.col(f"{side}_len") - n + 1, F.lit(0))

    return counts.select(
        "pair_id", *[_f1(F.col(f"m{n}"), grams("hyp", n), grams("ref", n)).alias(f"rouge_{n}") for n in orders]
    )


def _lcs_rows(a: list, b: list):
    """Bit rows of the longest common subsequence of words, one for each prefix of ``b``.

    Bit j of row i is clear where the subsequence of a[: j + 1] and b[:i] is longer than that
    of a[:j] and b[:i]. A row takes a bit for each word of ``a``.
    """
    where: dict = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    yield row
    for word in b:
        hit = row & where.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence of two lists of words."""
    row = 0
    for row in _lcs_rows(a, b):
        pass
    return len(a) - row.bit_count()


def lcs_places(a: list, b: list) -> list[int]:
    """Places in ``b`` of one longest common subsequence: from the ends, equal words are
    taken, else the way goes along ``a`` if the rest is truly longer there, and along ``b`` if not."""
    rows = list(_lcs_rows(a, b))
    i, j, places = len(b), len(a), []
    left = len(a) - rows[-1].bit_count()
    while left:
        if a[j - 1] == b[i - 1]:
            i, j, left = i - 1, j - 1, left - 1
            places.append(i)
        elif rows[i] >> (j - 1) & 1 and j - (rows[i - 1] & ((1 << j) - 1)).bit_count() < left:
            j -= 1
        else:
            i -= 1
    return places


def union_hits(hyp: list[list], ref: list[list]) -> int:
    """Words of the reference sentences in the union of their common subsequences with every
    sentence of the hypothesis, each word at most as often as the hypothesis has it."""
    chosen: Counter = Counter()
    for sentence in ref:
        found = {i for other in hyp if len(other) for i in lcs_places(other, sentence)}
        chosen.update(sentence[i] for i in found)
    return (chosen & Counter(w for other in hyp for w in other)).total()


def rouge_l(pairs: DataFrame) -> DataFrame:
    """Per pair ROUGE-L F (longest common subsequence of words)."""

    @F.pandas_udf("int")
    def lcs(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(a), list(b)) for a, b in zip(hyp, ref)])

    rows = pairs.select("pair_id", rouge_tokens("hyp").alias("h"), rouge_tokens("ref").alias("r"))
    rows = rows.select("pair_id", lcs("h", "r").alias("hits"), F.size("h").alias("nh"), F.size("r").alias("nr"))
    return rows.select("pair_id", _f1(F.col("hits"), F.col("nh"), F.col("nr")).alias("rouge_l"))


def rouge_lsum(pairs: DataFrame) -> DataFrame:
    """Per pair ROUGE-Lsum F: per reference sentence the union of its common
    subsequences with every hypothesis sentence."""

    @F.pandas_udf("int")
    def union_lcs(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([union_hits(*([list(s) for s in side] for side in (a, b))) for a, b in zip(hyp, ref)])

    def split(col):
        return F.transform(text.sentences(col), rouge_tokens)

    def words(col):
        return F.aggregate(col, F.lit(0), lambda n, s: n + F.size(s))

    rows = pairs.select("pair_id", split("hyp").alias("h"), split("ref").alias("r"))
    rows = rows.select(
        "pair_id", union_lcs("h", "r").alias("hits"), words(F.col("h")).alias("nh"), words(F.col("r")).alias("nr")
    )
    return rows.select("pair_id", _f1(F.col("hits"), F.col("nh"), F.col("nr")).alias("rouge_lsum"))
