"""Distributed positional inverted index over training tokens, for benchmark decontamination.

The index is a stored table with one row per shard, a run of documents of bounded bytes:
the sorted hashes of its terms, how often each occurs, and the positions of each in
ascending order. Phrases are found by intersecting position lists, shifted by a term's
offset in the phrase, from the rarest term on; shards without one of the terms stop at the
dictionary. The phrases go to the shards in blocks of bounded size.

Terms are 64-bit hashes of words, so a false match would take ten collisions in a row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.sinks import stored
from .common import batches_of, row_key, text_bytes, whole_text

WORDS = 10
SLOP = 4
SHARD_BYTES = 1 << 22
# Words of benchmark text that are sent to the tasks at a time.
BLOCK_WORDS = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = _WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)[_LOWER]


@lru_cache(maxsize=4)
def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.cumprod(np.full(n - 1, base))]


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the lengths of usual chunks."""
    if n > SHARD_BYTES:
        return np.r_[np.uint64(1), np.cumprod(np.full(n - 1, base))]
    return _powers(base, 1 << max(1, (n - 1).bit_length()))[:n]


def hashed_words(data: np.ndarray, starts: np.ndarray, of_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in ``data``, their first bytes and their ends; no word spans a text start.

    ``of_word`` marks the byte values that words consist of; A-Z and a-z count as the same.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = of_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:-1]
    closes[:-1] &= ~inside[1:] | cut[1:-1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    # A polynomial hash by differences of prefix sums, all modulo 2 ** 64.
    sums = powers_of(_BASE, len(data)) * _CODES[data]
    np.cumsum(sums, out=sums)
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
    hashes = sums[end - 1] - before
    hashes *= powers_of(_INVERSE, len(data))[begin]
    hashes ^= hashes >> np.uint64(29)
    return hashes, begin, end


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stored index: one row per shard (shard, doc_ids, hs, first_word, terms, counts, positions).

    first_word[k]..first_word[k + 1] are the positions of document k; hs is a hash of its
    text, which with its id makes the row key. Null texts have no words.
    """

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in batches_of(offsets, shard_bytes):
                low = offsets[i]
                starts = offsets[i : j + 1] - low
                hashes, begin, _ = hashed_words(data[low : offsets[j]], starts)
                order = np.argsort(hashes, kind="stable").astype(np.uint32)
                hashes = hashes[order]
                heads = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
                counts = np.diff(np.r_[heads, len(hashes)]).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("doc_id")[i:j].to_pylist()], pa.list_(batch.column("doc_id").type)),
                        pa.array([batch.column("h")[i:j].to_pylist()], pa.list_(pa.int64())),
                        pa.array([np.searchsorted(begin, starts).tolist()], pa.list_(pa.int64())),
                        pa.array([hashes[heads].tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
                        pa.array([order.tobytes()], pa.binary()),
                    ],
                    ["doc_ids", "hs", "first_word", "terms", "counts", "positions"],
                )

    rows = docs.select("doc_id", whole_text().alias("text"), row_key()["h"].alias("h"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    index = rows.mapInArrow(run, f"doc_ids array<{id_type}>, hs array<long>, first_word array<long>, terms binary, counts binary, positions binary")
    return stored(index.withColumn("shard", F.monotonically_increasing_id()), "postings")


class Phrases:
    """A block of items as hashed windows of equal length, shorter ones filled up with -1."""

    def __init__(self, items: list[tuple[object, np.ndarray]], words: int):
        self.items = [i for i, _ in items]
        self.terms = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
        windows, owner = [], []
        for k, (_, h) in enumerate(items):
            t = np.searchsorted(self.terms, h)
            for s in range(max(1, len(t) - words + 1)):
                w = np.full(words, -1, np.int64)
                w[: min(words, len(t))] = t[s : s + words]
                windows.append(w)
                owner.append(k)
        rows = np.column_stack([owner, np.array(windows, np.int64).reshape(-1, words)]) if owner else np.zeros((0, words + 1), np.int64)
        rows = np.unique(rows, axis=0)
        self.owner, self.windows = rows[:, 0], rows[:, 1:]
        self.length = (self.windows >= 0).sum(1)


def blocks_of(benchmark: DataFrame, words: int = WORDS, block_words: int = BLOCK_WORDS):
    """Phrases of the benchmark, block by block; items without words have none. Only one block is held at a time."""
    items, size = [], 0
    for row in benchmark.select("item_id", whole_text().alias("text")).toLocalIterator():
        data = np.frombuffer(row["text"].encode(), np.uint8)
        hashes, _, _ = hashed_words(data, np.array([0]))
        if len(hashes):
            items.append((row["item_id"], hashes))
            size += len(hashes)
        if size >= block_words:
            yield Phrases(items, words)
            items, size = [], 0
    if items:
        yield Phrases(items, words)


class Shard:
    """Position lists of one index row for the terms of a block."""

    def __init__(self, row: dict, block_terms: np.ndarray):
        terms = np.frombuffer(row["terms"].as_buffer(), np.uint64)
        counts = np.frombuffer(row["counts"].as_buffer(), np.uint32)
        self.positions = np.frombuffer(row["positions"].as_buffer(), np.uint32)
        at = np.searchsorted(terms, block_terms)
        held = at < len(terms)
        held[held] = terms[at[held]] == block_terms[held]
        ends = np.cumsum(counts, dtype=np.int64)
        self.count = np.zeros(len(block_terms) + 1, np.int64)  # the last stands for "no term"
        self.start = np.zeros(len(block_terms) + 1, np.int64)
        self.count[:-1][held] = counts[at[held]]
        self.start[:-1][held] = ends[at[held]] - counts[at[held]]
        self.first_word = np.array(row["first_word"].as_py(), np.int64)
        self.lists = {}

    def list_of(self, term: int) -> np.ndarray:
        if term not in self.lists:
            self.lists[term] = self.positions[self.start[term] : self.start[term] + self.count[term]].astype(np.int64)
        return self.lists[term]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_word, places, "right") - 1

    def exact(self, window: np.ndarray) -> np.ndarray:
        """Places where the window starts: shifted lists intersected, the rarest first."""
        order = sorted(range(len(window)), key=lambda k: self.count[window[k]])
        found = self.list_of(window[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            others = self.list_of(window[k]) - k
            at = np.minimum(np.searchsorted(others, found), len(others) - 1)
            found = found[others[at] == found]
        # Inside one document.
        found = found[found >= 0]
        return found[self.doc_of(found) == self.doc_of(found + len(window) - 1)]

    def near(self, window: np.ndarray, slop: int) -> np.ndarray:
        """Starts around which every term stands within ``slop`` words of its offset, all in the document of the rarest term.

        Which term is the rarest, and so the cut into shards, does not matter for which documents
        have a start. Starts may lie up to ``slop`` words outside the document; they are put inside.
        """
        order = sorted(range(len(window)), key=lambda k: self.count[window[k]])
        found = self.list_of(window[order[0]])
        doc = self.doc_of(found)
        low, high = self.first_word[doc], self.first_word[doc + 1] - 1
        start = found - order[0]
        # First what is near enough for any start that the rarest term allows, then start by start.
        for reach, starts in ((2 * slop, np.zeros(1, np.int64)), (slop, np.arange(-slop, slop + 1))):
            start, low, high = (start[:, None] + starts).ravel(), np.repeat(low, len(starts)), np.repeat(high, len(starts))
            for k in order[1:]:
                if not len(start):
                    return start
                others = self.list_of(window[k])
                least, most = np.maximum(start + k - reach, low), np.minimum(start + k + reach, high)
                ok = np.searchsorted(others, most, "right") > np.searchsorted(others, least)
                start, low, high = start[ok], low[ok], high[ok]
        return np.clip(start, low, high)


def _merged(doc, item, start, end):
    """Spans by (document, item), overlapping ones joined: yields (doc, item, starts, ends)."""
    order = np.lexsort((start, item, doc))
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    if not len(doc):
        return
    new_group = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]
    # Windows of an item have one length, so ends rise with starts.
    heads = np.flatnonzero(new_group | np.r_[True, start[1:] > end[:-1]])
    tails = np.r_[heads[1:], len(doc)] - 1
    groups = np.flatnonzero(new_group[heads])
    for a, b in zip(groups, np.r_[groups[1:], len(heads)], strict=True):
        yield doc[heads[a]], item[heads[a]], start[heads[a:b]], end[tails[a:b]]


def _matches(index: DataFrame, phrases: Phrases, item_type, slop: int | None) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(phrases)
    spans, arrow_type = pa.list_(pa.int64()), to_arrow_type(item_type)

    def search(shard, phrases, near):
        found = []
        # Windows with a term that the shard lacks end here.
        dead = ((shard.count[phrases.windows] == 0) & (phrases.windows >= 0)).any(1)
        for w in np.flatnonzero(~dead):
            window = phrases.windows[w, : phrases.length[w]]
            places = shard.near(window, slop) if near else shard.exact(window)
            docs = shard.doc_of(places)
            begin = places - shard.first_word[docs]
            found.append((docs, np.full(len(places), phrases.owner[w]), begin, begin + (1 if near else len(window))))
        return _merged(*map(np.concatenate, zip(*found, strict=True))) if found else ()

    def run(batches):
        phrases = sent.value
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                own = {name: batch.column(name)[row] for name in batch.schema.names}
                shard = Shard(own, phrases.terms)
                for near in (False, True) if slop is not None else (False,):
                    for doc, item, starts, ends in search(shard, phrases, near):
                        out.append((own["shard"].as_py(), int(doc), phrases.items[item], near, starts.tolist(), ends.tolist()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), arrow_type, pa.bool_(), spans, spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "doc", "item", "near", "starts", "ends"]
            )

    return index.mapInArrow(run, _match_schema(item_type))


def _match_schema(item_type) -> str:
    return f"shard long, doc long, item {item_type.simpleString()}, near boolean, starts array<long>, ends array<long>"


def matches(index: DataFrame, benchmark: DataFrame, words: int = WORDS, slop: int | None = SLOP) -> DataFrame:
    """Matches of the items' windows of ``words`` words: (shard, doc, item, near, starts, ends).

    One row per document and item: exact matches are spans of words [start, end), joined
    where windows overlap; near ones are starts of a window with every term within ``slop``
    words of its offset from there, in any order (None: exact matches only).
    """
    item_type = benchmark.schema["item_id"].dataType
    found = None
    for phrases in blocks_of(benchmark, words):
        part = _matches(index, phrases, item_type, slop)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return index.sparkSession.createDataFrame([], _match_schema(item_type))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, slop: int | None = SLOP) -> DataFrame:
    """Per document row: (doc_id, __key, n_words, n_hit, item_ids, n_near).

    n_hit counts words inside any exact occurrence of a window of an item (an item of fewer
    words is one window); item_ids lists the items with one, sorted as strings; n_near counts
    the ids of items with a proximity match, of which exact ones are a part. Null and empty
    texts have no words, items with a null id count for words and as one id but are not
    listed, repeated rows are rows of their own, and without items nothing is hit.
    """
    index = build_index(docs)
    found = matches(index, benchmark, words, slop)
    # A document's spans of all items: sorted, then measured as a union.
    spans = F.array_sort(F.flatten(F.collect_list(F.when(~F.col("near"), F.arrays_zip("starts", "ends")))))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["ends"] - F.greatest(acc["to"], s["starts"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], s["ends"]).alias("to"),
        ),
    )["n"]
    hit = found.groupBy("shard", "doc").agg(
        spans.alias("spans"),
        F.array_sort(F.collect_set(F.when(~F.col("near"), F.col("item").cast("string")))).alias("item_ids"),
        F.count_distinct(F.when(F.col("near"), F.struct("item"))).alias("n_near"),
    )
    hit = hit.select("shard", "doc", union.alias("n_hit"), "item_ids", "n_near")
    docs_of = F.arrays_zip("doc_ids", "hs", "first_word", F.slice("first_word", 2, F.size("hs")).alias("to"))
    each = index.select("shard", F.posexplode(F.slice(docs_of, 1, F.size("hs"))).alias("doc", "d"))
    rows = each.select(
        "shard", F.col("doc").cast("long").alias("doc"), F.col("d.doc_ids").alias("doc_id"),
        F.struct(F.col("d.doc_ids").alias("id"), F.col("d.hs").alias("h")).alias("__key"),
        (F.col("d.to") - F.col("d.first_word")).alias("n_words"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(hit, ["shard", "doc"], "left").select(
        "doc_id", "__key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("n_near", zero).alias("n_near"),
    )


def report(found: DataFrame) -> DataFrame:
    """The digest of ``contamination``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (exactly), n_near."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )
