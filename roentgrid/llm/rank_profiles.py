"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams, the most frequent first. A document is
compared with every language by the out-of-place distance: how many places each of its
n-grams lies from its place in the language's profile, or the length of a profile where it
has none there. The least distance wins.

N-grams are of one to three code points of words in lower case with one space on both
sides. Words are runs of letters and the marks that go with them. Three code points fit
into one integer whose order is the order of the n-grams as strings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_fold, whole_text

PLACES = 300
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
# The distances to all languages of a document are worked out at once.
MAX_LANGUAGES = 10_000
# Distinct n-grams that a task counts in memory before it sends them on, and texts in characters that it counts at once.
HELD = 1 << 20
CHUNK = 1 << 21

_BITS = 21
_SPACE = np.uint32(32)


def letters() -> Column:
    """The words of a text in lower case with single spaces between and around them; empty without any letter."""
    text = whole_text()
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))
    return F.when(text.rlike(r"\p{L}"), words).otherwise("")


def grams(text: str) -> np.ndarray:
    """All n-grams of normalised texts, end to end, as integers; spaces alone are none, and none has one inside."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(c) < 3:
        return np.zeros(0, np.int64)
    wide = c.astype(np.int64)
    solid = c != _SPACE
    two = (wide[:-1] << 2 * _BITS) | (wide[1:] << _BITS)
    three = two[:-1] | wide[2:]
    return np.concatenate([wide[solid] << 2 * _BITS, two[solid[:-1] | solid[1:]], three[solid[1:-1]]])


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and how often each occurs."""
    values = np.sort(values)
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[heads], np.diff(np.r_[heads, len(values)])


def most_frequent(text: str, places: int) -> np.ndarray:
    """A document's profile: its n-grams by count, greatest first, then in order."""
    values, n = counted(grams(text))
    return values[np.argsort(-n, kind="stable")[:places]]


def gram_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, gram, n): n-grams of the texts (columns lang, letters), partly counted."""

    def run(batches):
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def take(lang: str, texts: list[str]):
            values, n = counted(grams("".join(texts)))
            if lang in counts:
                values, n = np.r_[counts[lang][0], values], np.r_[counts[lang][1], n]
                order = np.argsort(values, kind="stable")
                values, n = values[order], n[order]
                heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
                values, n = values[heads], np.add.reduceat(n, heads)
            counts[lang] = values, n

        def flush():
            for lang, (values, n) in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            texts: dict[str, list[str]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("letters").to_pylist(), strict=True):
                # Texts end and begin with a space, so no n-gram spans two of them.
                texts.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] > CHUNK:
                    take(lang, texts.pop(lang))
                    del sizes[lang]
            for lang, own in texts.items():
                take(lang, own)
            if sum(len(v) for v, _ in counts.values()) > held:
                yield from flush()
                counts = {}
        yield from flush()

    return docs.select("lang", "letters").mapInArrow(run, "lang string, gram long, n long")


@dataclass
class Profiles:
    """Languages in order, and the places of n-grams in their profiles, sorted by n-gram."""

    langs: list[str]
    grams: np.ndarray
    lang: np.ndarray
    place: np.ndarray
    places: int

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's profile to every language."""
        low, high = np.searchsorted(self.grams, own), np.searchsorted(self.grams, own, "right")
        n = high - low
        entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        mine = np.repeat(np.arange(len(own)), n)
        near = self.places - np.abs(self.place[entry] - mine)
        return self.places * len(own) - np.bincount(self.lang[entry], near, len(self.langs)).astype(np.int64)


def learn(docs: DataFrame, places: int = PLACES) -> Profiles:
    """Profiles of all languages from all texts outside the held-out fold whose language is known.

    Reads text and language only, whole and of every such row. Equal counts go by n-gram.
    A language whose texts hold no letters has no profile and is never predicted.
    """
    known = docs.where(F.col("lang").isNotNull() & ~in_fold(FOLDS, HELD_OUT)).select("lang", letters().alias("letters")).where("letters != ''")
    counts = gram_counts(known).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= places).select("lang", "gram", "place")
    rows = top.limit(MAX_LANGUAGES * places + 1).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    if len(langs) > MAX_LANGUAGES or rows.num_rows > MAX_LANGUAGES * places:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    number = {name: k for k, name in enumerate(langs)}
    lang = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64)
    values, at = rows.column("gram").to_numpy().astype(np.int64), rows.column("place").to_numpy().astype(np.int64)
    order = np.lexsort([lang, values])
    return Profiles(langs, values[order], lang[order], at[order] - 1, places)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each input row.

    The score is 1 less the distance as a share of the greatest there can be. Equal
    distances go to the first language by name. A null text or one without a letter is
    ``und`` with score 0, as is any text if no language was learned; a null id is never
    held out. Repeated rows are kept, other columns are not read, an empty table gives
    no rows. One text at a time is held as n-grams.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        known = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("letters").to_pylist():
                own = most_frequent(text, known.places)
                name, score = UNKNOWN, 0.0
                if len(own) and known.langs:
                    far = known.distances(own)
                    best = int(far.argmin())
                    name, score = known.langs[best], 1 - int(far[best]) / (known.places * len(own))
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", in_fold(FOLDS, HELD_OUT).alias("held_out"), letters().alias("letters"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
