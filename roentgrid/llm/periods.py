"""Periodic runs of words, found from multi-scale minimizers.

A run is a stretch of words with smallest period q that holds at least LEAST words and
TIMES periods and that no neighbouring word extends. Documents are joined into chunks of
word numbers, with a number of its own between two of them, and searched together:

* Periods below SHORT are looked for lag by lag: words equal to those q places on.
* Longer periods go scale by scale. Scale P covers P <= q < P' = 3 P / 2 with k-grams of
  k = P' - 1 words and windows of w = 2 P - k + 1 k-grams. In a run the windows at its first
  place and q places on are alike, so both have their minimum at the same inner place, and as
  k >= q no k-gram of a run occurs twice within q places. Two neighbouring minimizers
  with one hash, q apart, therefore exist for every run. Such pairs seed an exact extension
  to both sides; it decides, the hash never does.

Seeds have k + q >= 2 q words in period, so they all belong to repetitions of which a text
of n words has fewer than n, and a seed inside a known stretch of its period is passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

LEAST = 24
TIMES = 3
SHORT = 16
CHUNK_WORDS = 1 << 18

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    x = a * _A
    x += b * _B
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def _slide(fold, values: np.ndarray, width: int) -> np.ndarray:
    """``fold`` (minimum, maximum, and) over every window of ``width`` values, in doubling steps."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = fold(values[:-step], values[step:])
        done += step
    return values


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of at least ``least`` true values."""
    if len(same) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(_slide(np.logical_and, same, least))
    if not len(at):
        return at, at
    breaks = np.diff(at) > 1
    heads, tails = at[np.r_[True, breaks]], at[np.r_[breaks, True]]
    return heads, tails - heads + least


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the minimum of some window of ``width`` hashes, all ties included."""
    low = _slide(np.minimum, hashes, width)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.maximum, np.concatenate([edge, low, edge]), width) == hashes)


def _seeds(hashes: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of neighbouring minimizers with one hash, ``low`` to ``high`` - 1 apart."""
    at = minimizers(hashes, width)
    at = at[np.argsort(hashes[at], kind="stable")]
    apart = np.diff(at)
    good = (hashes[at[1:]] == hashes[at[:-1]]) & (apart >= low) & (apart < high)
    return at[:-1][good], apart[good]


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, compared in growing pieces."""
    done, step = 0, 64
    while done < len(a):
        differ = a[done : done + step] != b[done : done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, 2 * step
    return len(a)


def _extended(ids: np.ndarray, places: np.ndarray, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal stretches (start, length, period) around the seeds."""
    order = np.lexsort([places, periods])
    found, known, end = [], 0, 0
    for p, d in zip(places[order].tolist(), periods[order].tolist(), strict=True):
        if d == known and p + d < end:
            continue
        start = p - _agreeing(ids[:p][::-1], ids[d : p + d][::-1])
        end, known = p + d + _agreeing(ids[p : len(ids) - d], ids[p + d :]), d
        found.append((start, end - start, d))
    return found


def find_runs(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs (start, length, period) in texts that lie one after another in ``ids``.

    ``ids`` are word numbers; after each text stands a number that occurs nowhere else.
    ``sizes`` are the numbers of words and must not rise: a scale then reads only the front,
    the texts that are long enough for it. Runs come by start, then period.
    """
    ends = np.cumsum(sizes + 1)
    found = [np.zeros((0, 3), np.int64)]

    def front(shortest: int) -> np.ndarray:
        n = int(np.searchsorted(-sizes, -shortest, "right"))
        return ids[: ends[n - 1]] if n else ids[:0]

    for q in range(1, SHORT):
        need = max(least, times * q)
        own = front(need)
        heads, lengths = _stretches(own[q:] == own[:-q], need - q)
        found.append(np.column_stack([heads, lengths + q, np.full(len(heads), q)]))
    own = ids.astype(np.uint64)
    low, span, grams = SHORT, 1, _mixed(own, ~own)
    while len(own := front(max(least, times * low))):
        high = low * 3 // 2
        k, grams = high - 1, grams[: len(own) - span + 1]
        while 2 * span <= k:
            # Hashes of ``span`` words from every place, as long as they fit.
            grams = _mixed(grams[:-span], grams[span:])
            span *= 2
        m = len(own) - k + 1
        hashes = _mixed(grams[:m], grams[k - span : k - span + m])
        found.append(np.array(_extended(own, *_seeds(hashes, 2 * low - k + 1, low, high)), np.int64).reshape(-1, 3))
        low = high
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(least, times * runs[:, 2])]
    # A stretch whose smallest period is a divisor was found with that one, too.
    runs = runs[np.lexsort([runs[:, 2], runs[:, 1], runs[:, 0]])]
    first = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)] if len(runs) else np.zeros(0, bool)
    runs = runs[first]
    return runs[np.lexsort([runs[:, 2], runs[:, 0]])]


def _chunks(texts: list[bytes], most: int):
    """Numbers of texts and their words, in chunks of about ``most`` words or of one text."""
    held, words, size = [], [], 0
    for k, text in enumerate(texts):
        held.append(k)
        words.append(text.split())  # bytes split at exactly these six characters
        size += len(words[-1])
        if size >= most:
            yield held, words
            held, words, size = [], [], 0
    if held:
        yield held, words


def chunk_runs(words: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of every text of a chunk, starts counted from its first word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-sizes, kind="stable")
    numbers: dict[bytes, int] = {}
    ids = []
    for place, k in enumerate(order.tolist()):
        ids += [numbers.setdefault(w, len(numbers)) for w in words[k]]
        ids.append(-1 - place)
    sizes = sizes[order]
    runs = find_runs(np.array(ids, np.int64), sizes)
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, 0] -= starts[owner]
    cuts = np.searchsorted(owner, np.arange(len(words) + 1))
    out: list[np.ndarray] = [runs[:0]] * len(words)
    for place, k in enumerate(order.tolist()):
        out[k] = runs[cuts[place] : cuts[place + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside of runs and in the first period of each that no other run drops, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())


def runs(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every row's text, and the text without their repeats.

    Words are what stands between the characters x20 and x09 to x0D; runs come by start,
    then period. One row for each input row, so repeated rows and null ids are kept; a null
    or empty text has no words and no runs; other columns are not read; an empty table
    gives no rows. A task holds one chunk of texts, or one text if that is longer.
    """

    def run(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for held, words in _chunks(texts, chunk_words):
                found = chunk_runs(words)
                flat = np.concatenate(found)
                items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], ["start", "length", "period"])
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[held[0] : held[-1] + 1], pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), items),
                        pa.array([collapsed(w, r).decode() for w, r in zip(words, found, strict=True)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select("doc_id", whole_text().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents, about one of ten with a periodic tail, chosen by the checksum of the id.

    With h the CRC-32 of the decimal id and g = h div 10, a text of n > 0 words with h % 10 = 0
    repeats its words a to a + p - 1 from word a = g % n on, p = 1 + (n - a) div (3 + g % 8).
    Rows with a null id or text stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    made = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("__words"))
    n, g = F.size("__words").cast("bigint"), F.floor(h / 10)
    a = g % F.when(n > 0, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    tail = F.transform(F.sequence(F.lit(0).cast("bigint"), n - a - 1), lambda i: F.get("__words", (a + i % p).cast("int")))
    text = F.array_join(F.concat(F.slice("__words", F.lit(1), a.cast("int")), tail), " ")
    return made.withColumn("text", F.when(n > 0, text).otherwise(F.col("text"))).drop("__words")


def best_run(column: str = "runs") -> Column:
    """The run with the greatest exact length / period; among equals the first, then the one of least period."""

    def better(x: Column, y: Column) -> Column:
        # In runs by start and period, a later run has to be truly greater; products stay exact far beyond any text.
        return F.when(x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x)

    return F.aggregate(column, F.lit(None).cast(RUN), better)


def report(found: DataFrame) -> DataFrame:
    """One row for each row of ``runs``: number of runs, the best one and digests; nulls where there is none."""
    best = found.withColumn("__best", best_run())
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col("__best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("(__best.length * 1000) div __best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
