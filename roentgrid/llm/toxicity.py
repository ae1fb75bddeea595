"""Toxicity by a lexicon trie, Levenshtein automata and the context of each hit.

The lexicon is learned from labelled rows: words and beginnings of words that hardly occur
outside documents marked toxic, each with its log odds. Words of a text walk the trie; a
word that is no entry and close to one is run as a Levenshtein automaton against the trie,
so that misspelled terms count as well, at a discount. Around every hit a window of words
tells quotation (quotation marks, verbs of saying) from abuse (other hits, the second
person); a logistic regression over both kinds of evidence gives the score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, whole_text
from .pu_quality import sampled

FOLDS, HELD_OUT = 4, 2
# Bounds of the samples that lexicon and regression are fitted on.
TOXIC, CLEAN = 4_000, 8_000
THRESHOLD = 0.3
# An entry occurs in this many sampled toxic documents at least, and its odds are this much higher there.
SUPPORT, ODDS = 4, 12.0
STEM = (4, 8)
LEXICON = 4_000
FUZZY_LENGTH = 5
FUZZY_WEIGHT = 0.7
WINDOW = 8
CACHE_WORDS = 400_000

WORD = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*")
QUOTES = "\"“”„«»‹›"
# Words that introduce what someone else said, and words that address the reader.
SAYING = frozenset("said says wrote writes called quote quoted quotes term word insult slur reported dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your yours youre u are du dich ihr tu te toi vous tú usted eres".split())


class Lexicon:
    """Trie of entries with their weights; an entry is a whole word or the beginning of one."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.root: dict = {}
        for kind, entries in (("word", words), ("stem", stems)):
            for entry, weight in entries.items():
                node = self.root
                for c in entry:
                    node = node.setdefault(c, {})
                node[kind] = weight
        # Strings with one character left out: two words within one edit share one of them.
        self.near = {d for e in words if len(e) >= FUZZY_LENGTH for d in self.shortened(e)}

    @staticmethod
    def shortened(word: str):
        yield word
        for i in range(len(word)):
            yield word[:i] + word[i + 1 :]

    def exact(self, word: str) -> float:
        """Largest weight of an entry that the word is or begins with; 0 if none."""
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if "stem" in node:
                best = max(best, node["stem"])
        return max(best, node.get("word", 0.0))

    def fuzzy(self, word: str, edits: int = 1) -> float:
        """Largest weight of a whole-word entry within ``edits`` edits: the word's Levenshtein
        automaton, as one bit set of positions for each number of edits, runs down the trie."""
        n, where = len(word), {}
        for i, c in enumerate(word):
            where[c] = where.get(c, 0) | 1 << i
        full = (1 << n + 1) - 1

        def closed(states):
            # A character of the word may be left out.
            for e in range(edits):
                states[e + 1] |= states[e] << 1 & full
            return states

        best, stack = 0.0, [(self.root, closed([1] + [0] * edits), 0)]
        while stack:
            node, states, depth = stack.pop()
            if depth >= FUZZY_LENGTH and any(s >> n & 1 for s in states):
                best = max(best, node.get("word", 0.0))
            for c, child in node.items():
                if len(c) > 1:
                    continue
                hit = where.get(c, 0)
                after = [(s & hit) << 1 for s in states]
                for e in range(edits):
                    after[e + 1] |= states[e] | states[e] << 1 & full  # inserted or replaced
                after = closed(after)
                if any(after):
                    stack.append((child, after, depth + 1))
        return best

    def weight(self, word: str) -> float:
        """Weight of a word: that of its entry, discounted if misspelled; 0 for any other word."""
        found = self.exact(word)
        if not found and FUZZY_LENGTH <= len(word) <= 40 and any(d in self.near for d in self.shortened(word)):
            found = FUZZY_WEIGHT * self.fuzzy(word)
        return found


class Weights(dict):
    """Words met so far and their weights; starts afresh when full."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.lexicon.weight(word)
        return found


FEATURES = 6


def evidence(text: str, weights: Weights) -> list[float]:
    """Evidence in a text: strongest and summed abuse, summed quotation, density, hits close together, address."""
    lower = text.lower()
    words = WORD.findall(lower)
    hits = [(i, w) for i, w in enumerate(map(weights.__getitem__, words)) if w]
    if not hits:
        return [0.0] * FEATURES
    wanted, spans, at = {i for i, _ in hits}, {}, 0
    for i, m in enumerate(WORD.finditer(lower)):
        if i in wanted:
            spans[i] = m.span()
    abuse = quoted = strongest = address = 0.0
    close = 0
    for k, (i, w) in enumerate(hits):
        a, b = spans[i]
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        left, right = lower[max(0, a - 60) : a], lower[b : b + 60]
        inside = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
        said = not SAYING.isdisjoint(near)
        share = 0.2 if inside and said else 0.5 if inside or said else 1.0
        abuse += w * share
        quoted += w * (1 - share)
        strongest = max(strongest, w * share)
        address += w * share * (not ADDRESS.isdisjoint(near))
        close += k > 0 and i - hits[k - 1][0] <= WINDOW
    n = max(1, len(words))
    return [strongest, math.log1p(abuse), math.log1p(quoted), math.log1p(100 * len(hits) / n), math.log1p(close), math.log1p(address)]


def _terms(rows: DataFrame) -> DataFrame:
    """(toxic, kind, term): distinct words and beginnings of words of every sampled row."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(whole_text()), F.lit(r"[\p{L}\p{N}]+(?:[@$*][\p{L}\p{N}]+)*"), F.lit(0))), lambda w: F.length(w) >= 3)
    stems = F.flatten(
        F.transform("words", lambda w: F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: F.when(F.length(w) > n, F.substring(w, F.lit(1), n))))
    )
    both = F.concat(
        F.transform("words", lambda w: F.struct(F.lit("word").alias("kind"), w.alias("term"))),
        F.transform(F.array_distinct(F.filter(stems, lambda s: s.isNotNull())), lambda s: F.struct(F.lit("stem").alias("kind"), s.alias("term"))),
    )
    return rows.select("toxic", words.alias("words")).select("toxic", F.explode(both).alias("t")).select("toxic", "t.*")


def learn_lexicon(rows: DataFrame, toxic: int, clean: int) -> Lexicon:
    """Entries by document frequency among the sampled rows; ``toxic`` and ``clean`` are their numbers."""
    counts = _terms(rows).groupBy("kind", "term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = ((F.col("bad") + 0.5) / (toxic + 1)) / ((F.col("good") + 0.5) / (clean + 1))
    strong = counts.where((F.col("bad") >= SUPPORT) & (odds >= ODDS)).withColumn("weight", F.log(odds) + F.log(F.col("bad")) / 4)
    top = strong.orderBy(F.desc("weight"), F.length("term"), "term", "kind").limit(LEXICON).collect()
    stems: dict[str, tuple[float, int]] = {}
    for r in sorted((r for r in top if r["kind"] == "stem"), key=lambda r: (len(r["term"]), r["term"])):
        # A longer beginning adds nothing unless it is the clearer sign.
        shorter = [stems[r["term"][:n]] for n in range(STEM[0], len(r["term"])) if r["term"][:n] in stems]
        if not any(w >= r["weight"] - 0.3 for w, _ in shorter):
            stems[r["term"]] = (r["weight"], r["bad"])
    return Lexicon({r["term"]: r["weight"] for r in top if r["kind"] == "word"}, {s: w for s, (w, _) in stems.items()})


def regression(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression (Newton's rounds, a small ridge); the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(x.shape[1]), np.diag([0.5] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge @ beta
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge
        beta = beta - np.linalg.solve(curve, slope)
    return beta


class Model:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray):
        self.lexicon, self.beta = lexicon, beta

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = np.column_stack([np.array(rows, float).reshape(-1, FEATURES), np.ones(len(rows))])
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _evidence_rows(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches):
        weights = Weights(lexicon)
        for batch in batches:
            rows = [evidence(t, weights) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    return docs.select("toxic", whole_text().alias("text")).mapInArrow(run, "toxic int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model | None:
    """Lexicon and regression from the labels outside the held-out fold; None without both classes.

    Labels that contradict each other for an id are left out.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold(folds, held_out))
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("t"), F.max("toxic").alias("__t")).where("t = __t")
    known = {r["t"]: r["count"] for r in rows.groupBy("t").count().collect()}
    if not known.get(1) or not known.get(0):
        return None
    parts = [sampled(docs, rows.where(F.col("t") == t), most).select(F.lit(t).alias("toxic"), "text") for t, most in ((1, TOXIC), (0, CLEAN))]
    sample = parts[0].unionByName(parts[1])
    numbers = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(numbers) < 2:
        return None
    lexicon = learn_lexicon(sample, numbers[1], numbers[0])
    found = _evidence_rows(sample, lexicon).collect()
    x, y = np.array([r["x"] for r in found]).reshape(-1, FEATURES), np.array([r["toxic"] for r in found], float)
    # Each class with its share among the labelled rows.
    share = np.where(y == 1, known[1] / numbers[1], known[0] / numbers[0])
    return Model(lexicon, regression(x, y, share / share.mean()))


def score(docs: DataFrame, model: Model | None, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null or empty text has no evidence and the score of such a text; without a model the
    score is 0.
    """

    def run(batches):
        weights = Weights(model.lexicon) if model else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            s = model.score([evidence(t, weights) for t in texts]) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", in_fold(folds, held_out).alias("held_out"), whole_text().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
