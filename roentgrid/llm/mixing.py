"""Language-model scores by logistic mixing of hashed-context bit predictors.

A token is a path of binary decisions: frequent tokens are leaves of a Huffman tree, any
other takes the tree's escape leaf and is spelled, byte by byte, down a second tree. Two
predictors hold the corpus' counts of both outcomes per hashed context of a decision: the
decision alone and with the token before it (in spelling: with two and with four bytes
before it). A third expects the token that followed the last occurrence of the token
before, in the same document. A spelled token that the corpus has is predicted by its count
as well, in a share that the number of tokens met once gives.

Their log odds are added up with weights from a set that a gate picks (kind of decision,
state of the third predictor, context met before). Weights start alike for every document
and are learned online while it is read, block by block of decisions; a table of observed
outcomes per gate and predicted odds refines the result, also online. A document's score
depends on the model and its own text only.

Counts cover all documents outside the held-out fold. They are gathered per task into
tables of a fixed number of slots and merged slot block by slot block, in 64 bits. The
weights that a document starts with are fitted on a fifth of these documents with the
counts of the others: the decisions are counted by gate, rounded inputs and outcome, which
adds up to the same numbers however rows are split, and a logistic regression per gate is
solved on that table of fixed size.
"""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .common import batches_of, in_fold, remainder, text_bytes, whole_text
from .phrases import hashed_words

FOLDS, HELD_OUT = 5, 1
# Tokens with a leaf of their own; all others are spelled.
FREQUENT = 1 << 17
TABLE_BITS = 20
SLOTS = 1 << 12  # of a block in which tables are merged
CHUNK_BYTES = 1 << 18
MERGE = 1 << 22
PAIRS = 1 << 16  # token pairs whose decisions are listed at a time
CHUNK_ROWS = 512
# Decisions of a document between two updates of its weights, and the learning rate.
BLOCK, RATE = 256, 0.02
# The fold of the training documents that the first weights are learned on.
TUNING = 3
TABLES, KINDS, STATES, MET, CELLS, REACH = 2, 4, 4, 2, 33, 8.0
GATES = KINDS * STATES * MET
# Inputs are counted in steps of 1 / STEPS up to LIMIT either way; how firmly a gate holds to its first weights.
STEPS, LIMIT, HOLD = 2, 12, 20.0
LEVELS = 2 * STEPS * LIMIT + 1

_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
END = np.uint64(1)  # the token after the last word
NOTHING = np.uint64(2)  # in front of the first
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_ODD = np.uint64(0xC4CEB9FE1A85EC53)


def huffman(weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of a Huffman tree: (starts, nodes, bits); leaf k decides bits[starts[k]:starts[k + 1]] at these nodes."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapify(heap)
    parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, bool)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heappop(heap), heappop(heap)
        parent[[i, j]], side[j] = node, True
        heappush(heap, (a + b, node))
    depth = np.zeros(2 * n, np.int64)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    starts = np.r_[0, np.cumsum(depth[:n])]
    nodes, bits = np.zeros(starts[-1], np.int32), np.zeros(starts[-1], bool)
    at, here = starts[1:] - 1, np.arange(n)
    while len(here):
        go = here != 2 * n - 2
        at, here = at[go], here[go]
        nodes[at], bits[at] = parent[here], side[here]
        at, here = at - 1, parent[here]
    return starts, nodes, bits


def _spelling_weights() -> np.ndarray:
    """Fixed weights of bytes: letters by a common order of frequency, the end of a word as a space."""
    w = np.full(256, 5e-4)
    w[128:] = 5e-3
    w[48:58] = 5e-3
    for rank, c in enumerate("etaoinshrdlcumwfgypbvkjxqz"):
        w[ord(c)] = 1 / (rank + 3)
    w[32] = 0.3
    return w


SPELLING = huffman(_spelling_weights())


def _hash32(x: np.ndarray) -> np.ndarray:
    """uint32 mix of integers."""
    x = (x.astype(np.uint64) * _MIX >> np.uint64(32)).astype(np.uint32)
    return x * np.uint32(0x9E3779B1)


SPELLING_MARKS = _hash32(SPELLING[1] + (1 << 24))


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(token hashes, document, first byte, end) of texts in order; every text ends with END, of no bytes."""
    hashes, begin, end = hashed_words(data, offsets, _SPACE)
    n = len(offsets) - 1
    doc = np.searchsorted(offsets, begin, "right") - 1
    words = np.bincount(doc, minlength=n)
    out = np.full(len(begin) + n, END)
    at = np.arange(len(begin)) + doc
    out[at] = np.maximum(hashes, np.uint64(3))
    a, b = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
    a[at], b[at] = begin, end
    return out, np.repeat(np.arange(n), words + 1), a, b


class Vocabulary:
    """Frequent tokens (sorted hashes with counts) and the paths of their leaves; the last leaf is the escape."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.paths = huffman([*self.counts.tolist(), max(rest, 1)])
        self.marks = _hash32(self.paths[1] + 1)
        self.steps = np.diff(self.paths[0])

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Leaf of each token; the escape for all others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    ends = np.cumsum(sizes)
    out = np.arange(ends[-1] if len(ends) else 0)
    return out + np.repeat(starts - (ends - sizes), sizes)


class Letters(NamedTuple):
    """Bytes of words, each with a space behind: the bytes, hashes of the two and of the four before, place in the word, sizes of the words."""

    text: np.ndarray
    two: np.ndarray
    four: np.ndarray
    inner: np.ndarray
    size: np.ndarray


def letters(data, begin, end) -> Letters:
    size = end - begin + 1
    last = np.cumsum(size) - 1
    text = _LOWER[np.append(data, np.uint8(32))[_ranges(begin, size)]]
    text[last] = 32
    inner = np.arange(len(text)) - np.repeat(last - size + 1, size)
    code = text.astype(np.uint32) + np.uint32(1)
    back = [np.where(inner >= k, np.r_[np.zeros(k, np.uint32), code[:-k]][: len(code)], np.uint32(0)) for k in range(1, 5)]
    two = back[0] + back[1] * np.uint32(257)
    four = two + (back[2] + back[3] * np.uint32(257)) * np.uint32(0x85EBCA6B)
    return Letters(text, _hash32(two), _hash32(four), inner, size)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Stable order of integers."""
    # Sorting them cut short, with their places behind, is cheaper; it is not enough where only the rest tells two apart.
    low = np.uint64((1 << len(x).bit_length()) - 1)
    order = (np.sort(x & ~low | np.arange(len(x), dtype=np.uint64)) & low).astype(np.intp)
    ranked = x[order]
    return order if (ranked[1:] >= ranked[:-1]).all() else np.argsort(x, kind="stable")


def _alone(marks: np.ndarray) -> np.ndarray:
    """Slots of decisions in the first table."""
    return (marks * np.uint32(0x85EBCA6B) >> np.uint32(32 - TABLE_BITS)).astype(np.intp)


def _within(context: np.ndarray) -> np.ndarray:
    """Slots of decisions in the second table, of hashes with their contexts; works in place."""
    context *= np.uint32(0xC2B2AE35)
    context >>= np.uint32(32 - TABLE_BITS)
    return context.astype(np.intp)


class Pieces(NamedTuple):
    """Runs of decisions that belong to one token: its place, the first one's index, their number, the token's decisions
    before them, and whether they spell it."""

    token: np.ndarray
    start: np.ndarray
    size: np.ndarray
    skip: np.ndarray
    spells: np.ndarray

    def take(self, at) -> Pieces:
        return Pieces(*[v[at] for v in self])

    def run(self) -> np.ndarray:
        return _ranges(self.start, self.size)


class Run:
    """Tokens of a run of texts, with their leaves; ``which`` numbers the distinct ones."""

    def __init__(self, data, offsets, vocabulary: Vocabulary):
        self.token, self.doc, begin, end = tokens(data, offsets)
        self.order = _ordered(self.token)
        ranked = self.token[self.order]
        self.new = np.ones(len(ranked), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=self.new[1:])
        self.which = np.empty(len(ranked), np.intp)
        self.which[self.order] = np.cumsum(self.new) - 1
        first = self.order[self.new]
        self.leaf = vocabulary.place(ranked[self.new])
        self.known = self.leaf[self.which]
        self.rare = self.leaf == len(vocabulary.hashes)
        self.letters = letters(data, begin[first[self.rare]], end[first[self.rare]])

    def before(self) -> np.ndarray:
        """Hash of the token before each token."""
        if not len(self.token):
            return self.token
        return np.where(np.r_[True, self.doc[1:] != self.doc[:-1]], NOTHING, np.r_[NOTHING, self.token[:-1]])


class Decisions(Run):
    """All decisions of a run of texts. Those of a distinct token are worked out once and referred to by index.

    A token's path down the tree comes first (escaped ones share one), then what spells it.
    """

    def __init__(self, data, offsets, vocabulary: Vocabulary):
        super().__init__(data, offsets, vocabulary)
        leaves = np.append(self.leaf[~self.rare], len(vocabulary.hashes))
        starts, _, bits = vocabulary.paths
        steps = vocabulary.steps[leaves]
        heads, source = np.cumsum(steps) - steps, _ranges(starts[leaves], steps)
        row = np.where(self.rare, len(leaves) - 1, np.cumsum(~self.rare) - 1)
        # Per distinct token: first decision and number of its path, and of what spells it.
        self.head, self.size = heads[row], steps[row]
        self.tail, self.extra = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        marks = vocabulary.marks[source]
        self.bit, alone, self.one, kind = bits[source], marks, marks, np.arange(len(source)) >= np.repeat(heads + 5, steps)
        if self.rare.any():
            text, two, four, inner, size = self.letters
            starts, _, bits = SPELLING
            steps = np.diff(starts)[text]
            path, ends = _ranges(starts[text], steps), np.r_[0, np.cumsum(steps)]
            own, marks, words = np.repeat(np.arange(len(text)), steps), SPELLING_MARKS[path], np.r_[0, np.cumsum(size)]
            self.tail[self.rare], self.extra[self.rare] = len(source) + ends[words[:-1]], np.diff(ends[words])
            self.bit, kind = np.append(self.bit, bits[path]), np.append(kind, (2 + (inner > 2)).astype(np.int8)[own])
            alone, self.one = np.append(alone, marks ^ two[own]), np.append(self.one, marks ^ four[own])
        # Slots of decisions alone, with what the token's bytes add; kinds and outcomes in one number.
        self.alone, self.code = _alone(alone), kind.astype(np.int8) * np.int8(2) + ~self.bit

    def pieces(self) -> Pieces:
        """The decisions of the texts in order, token by token."""
        spells = self.extra[self.which] > 0
        count = 1 + spells
        token = np.repeat(np.arange(len(count)), count)
        second = np.zeros(len(token), bool)
        second[np.cumsum(count)[spells] - 1] = True
        which = self.which[token]
        start, size = np.where(second, self.tail[which], self.head[which]), np.where(second, self.extra[which], self.size[which])
        found = Pieces(token, start, size, np.where(second, self.size[which], 0), second)
        return found if size.all() else found.take(size > 0)

    def slots(self, index, place: Pieces):
        """Slot of every distinct decision alone (in spelling: with two bytes), and of every one with the token (four bytes) before."""
        context = np.repeat(np.where(place.spells, np.uint32(0), _hash32(self.before())[place.token]), place.size)
        context ^= self.one.take(index, mode="clip")
        return self.alone, _within(context)

    def expected(self):
        """Per token, by the document's own history: how many of its decisions are expected, whether as they came, and a state 0..3.

        The token before has to have stood in the document; what followed it then is expected
        up to the first decision that comes out otherwise. The state is higher when the last
        one or two expectations came true.
        """
        n = len(self.token)
        guess = np.full(n, -1)
        # Places of a token in order: what followed the one before is expected after the next.
        a, b = self.order[:-1], self.order[1:]
        same = ~self.new[1:] & (self.doc[a] == self.doc[b])
        a, b = a[same] + 1, b[same] + 1
        inside = b < n
        inside[inside] = self.doc[b[inside]] == self.doc[b[inside] - 1]
        guess[b[inside]] = self.which[a[inside]]
        right = guess == self.which
        before = np.r_[False, right[:-1]]
        level = 1 + before + (before & np.r_[False, before[:-1]])
        held = np.where(right, (self.size + self.extra)[self.which], 0)
        wrong = np.flatnonzero((guess >= 0) & ~right)
        held[wrong] = self._shared(guess[wrong], self.which[wrong]) + 1
        return held, right, np.where(guess >= 0, level, 0)

    def _shared(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Number of outcomes that pairs of different tokens begin with in common; no token's outcomes begin another's."""
        found = np.zeros(len(one), np.int64)
        both = (self.extra[one] > 0) & (self.extra[other] > 0)
        heads = [np.where(both, self.tail[v], self.head[v]) for v in (one, other)]
        lasts = [h + np.where(both, self.extra[v], self.size[v]) - 1 for h, v in zip(heads, (one, other), strict=True)]
        found[both] = self.size[one[both]]
        rows, done, width = np.arange(len(one)), 0, 4
        while len(rows):
            # The next few outcomes of each pair, twice as many at each turn.
            span = np.arange(done, done + width)
            bits = [self.bit[np.minimum(h[:, None] + span, last[:, None])] for h, last in zip(heads, lasts, strict=True)]
            differ = bits[0] != bits[1]
            some = differ.any(1)
            found[rows[some]] += done + differ[some].argmax(1)
            rows, heads, lasts = rows[~some], [h[~some] for h in heads], [v[~some] for v in lasts]
            done, width = done + width, width * 2
        return found


def _chunks(batch):
    """Runs of rows as (rows, bytes, offsets); given a batch of texts, those of like length come together.

    Texts are read in step, so a run takes as many steps as its longest text.
    """
    data, offsets = text_bytes(batch.column("text"))
    order = np.argsort(-np.diff(offsets), kind="stable")
    data, offsets = text_bytes(batch.column("text").take(pa.array(order)))
    for i, j in batches_of(offsets, CHUNK_BYTES):
        for a in range(i, j, CHUNK_ROWS):
            b = min(j, a + CHUNK_ROWS)
            yield order[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def token_counts(docs: DataFrame) -> DataFrame:
    """Stored (h, c): occurrences of every token in the rows, END included; added up in each task first."""

    def run(batches):
        held, size = [np.zeros(0, np.uint64)], 0

        def rows():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches:
            for _, data, offsets in _chunks(batch):
                held.append(tokens(data, offsets)[0])
                size += len(held[-1])
                if size > MERGE:
                    yield rows()
                    held, size = held[:1], 0
        yield rows()

    found = docs.select(whole_text().alias("text")).mapInArrow(run, "h long, c long")
    return stored(found.groupBy("h").agg(F.sum("c").alias("c")), "tokens")


class Counter:
    """Counts of both outcomes per slot of the tables. Tokens, pairs of them and letters are counted first, then their decisions."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.tables = vocabulary, np.zeros((TABLES, 2 << TABLE_BITS), np.int64)
        self.leaves, self.held, self.size = np.zeros(len(vocabulary.steps), np.int64), [[] for _ in range(3)], 0

    def add(self, d: Run):
        self.leaves += np.bincount(d.known, minlength=len(self.leaves))
        # Leaves after the token before them, and letters after two and four others: a hash and what comes.
        text, two, four, _, size = d.letters
        times = np.repeat(np.bincount(d.which, minlength=len(d.rare))[d.rare], size)
        for held, context, comes in zip(self.held, (_hash32(d.before()), two, four), (d.known, text, text), strict=True):
            key = context.astype(np.uint64) << np.uint64(32) | comes.astype(np.uint64)
            held.append(key if comes is d.known else np.repeat(key, times))
            self.size += len(held[-1])
        if self.size > MERGE // 2:
            self.merge()

    def merge(self):
        """Count the decisions of what is held."""
        paths, spelling = (self.vocabulary.paths, self.vocabulary.marks), (SPELLING, SPELLING_MARKS)
        for held, table, slots, (tree, marks) in zip(self.held, (1, 0, 1), (_within, _alone, _within), (paths, spelling, spelling), strict=True):
            if not held:
                continue
            found, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            starts, _, bits = tree
            for a in range(0, len(found), PAIRS):
                own = found[a : a + PAIRS]
                leaf = (own & np.uint64(0xFFFFFFFF)).astype(np.intp)
                steps = starts[leaf + 1] - starts[leaf]
                index = _ranges(starts[leaf], steps)
                context = np.repeat((own >> np.uint64(32)).astype(np.uint32), steps)
                context ^= marks[index]
                np.add.at(self.tables[table], slots(context) * 2 + bits[index], np.repeat(times[a : a + PAIRS], steps))
        self.size = 0

    def flush(self):
        self.merge()
        starts, _, bits = self.vocabulary.paths
        for a in range(0, len(self.leaves), PAIRS):
            b = min(a + PAIRS, len(self.leaves))
            path = slice(starts[a], starts[b])
            times = np.repeat(self.leaves[a:b], self.vocabulary.steps[a:b])
            np.add.at(self.tables[0], _alone(self.vocabulary.marks[path]) * 2 + bits[path], times)
        self.leaves[:] = 0
        return self.tables


def _blocks_of(counts, first: int = 0):
    """The blocks of a task's counts, numbered from ``first``, that hold any, as record batches; each as narrow as its counts allow."""
    cut = counts.reshape(-1, 2 * SLOTS)
    for part in range(0, len(cut), 64):
        own = cut[part : part + 64]
        most = own.max(1)
        full = np.flatnonzero(most)
        blobs = pa.array([own[k].astype(np.uint16 if most[k] < 1 << 16 else np.uint32 if most[k] < 1 << 32 else np.int64).tobytes() for k in full], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(full + part + first), blobs], ["block", "counts"])


BLOCKS = TABLES << TABLE_BITS >> SLOTS.bit_length() - 1
# Blocks of the decisions counted by gate, inputs and outcome.
CASES = GATES * LEVELS * LEVELS * 3 * 2
MORE = -(-CASES // (2 * SLOTS))


def _merged(found: DataFrame, blocks: int = BLOCKS) -> np.ndarray:
    """Sum of the tasks' counts, merged block by block: as many blocks as the tables have, at every size of the input."""

    def merge(batches):
        sums = {}
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                blob = blob.as_buffer()
                own = np.frombuffer(blob, {1: np.uint16, 2: np.uint32, 4: np.int64}[blob.size // (4 * SLOTS)])
                if block in sums:
                    sums[block] += own
                else:
                    sums[block] = own.astype(np.int64)
        blobs = [s.tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(blobs, pa.binary())], ["block", "counts"])

    out = np.zeros((blocks, 2 * SLOTS), np.int64)
    for row in found.repartition("block").mapInArrow(merge, "block long, counts binary").collect():
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out


def _tables(blocks: np.ndarray) -> np.ndarray:
    return blocks[:BLOCKS].reshape(TABLES, -1)


def _odds(counts: np.ndarray) -> np.ndarray:
    return np.log((counts[:, 1::2] + 0.4) / (counts[:, ::2] + 0.4)).astype(np.float32)


def predictor_counts(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Counts of both outcomes in each slot of the tables, from the decisions of all rows."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        vocabulary, counter = sent.value, Counter(sent.value)
        for batch in batches:
            for _, data, offsets in _chunks(batch):
                counter.add(Run(data, offsets, vocabulary))
        yield from _blocks_of(counter.flush())

    return _tables(_merged(docs.select(whole_text().alias("text")).mapInArrow(count, "block long, counts binary")))


class State:
    """What a document starts with: weights per gate, and (outcomes 1, outcomes) per kind and cell of predicted odds."""

    def __init__(self):
        # The decision alone, before anything is learned; contexts and expectation add to it.
        self.weights = np.zeros((KINDS, STATES, MET, TABLES + 1), np.float32)
        self.weights[..., 0] = 1.0
        self.weights[..., 1] = 0.1
        self.weights[2:, ..., :2] = 0.5  # in spelling, the longer context adds to the shorter one
        self.weights[..., -1] = np.array([0.0, 1.0, 3.0, 5.0])[:, None]
        self.weights = self.weights.reshape(GATES, -1)
        centre = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, CELLS)))
        self.seen = np.stack([np.tile(centre, KINDS) * 30, np.full(KINDS * CELLS, 30.0)])

    def refined(self) -> np.ndarray:
        return (self.seen[0] / self.seen[1]).astype(np.float32)

    def fit(self, cases: np.ndarray) -> State:
        """Solve the weights of every gate on the counted decisions (Newton's rounds), and fill the outcomes."""
        cases = cases.ravel()[:CASES].reshape(GATES, LEVELS, LEVELS, 3, 2)
        ones_of = [np.zeros(KINDS * CELLS) for _ in range(2)]
        for gate, own in enumerate(cases):
            at = np.nonzero(own.any(-1))
            x = np.stack([at[0] / STEPS - LIMIT, at[1] / STEPS - LIMIT, at[2] - 1.0], 1)
            ones, n = own[at][:, 1].astype(float), own[at].sum(1).astype(float)
            first = self.weights[gate].astype(float)
            w = first.copy()
            for _ in range(20):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                slope = x.T @ (n * p - ones) + HOLD * (w - first)
                curve = (x * (n * p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w))
                w -= np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
            self.weights[gate] = w
            cell = (np.clip(x @ w, -REACH, REACH) + REACH) * (CELLS - 1) / (2 * REACH) + 0.5
            cell = cell.astype(np.int64) + gate // (STATES * MET) * CELLS
            for total, part in zip(ones_of, (ones, n), strict=True):
                total += np.bincount(cell, weights=part, minlength=len(total))
        self.seen += np.stack(ones_of)
        return self


class Turns:
    """The decisions of n texts in the order they are taken: turn by turn a block of each text that still goes on."""

    def __init__(self, d: Decisions, n: int):
        own = d.pieces()
        doc = d.doc[own.token]
        long = np.bincount(doc, weights=own.size, minlength=n).astype(np.int64)
        # Pieces are cut where a block ends.
        begin = np.cumsum(own.size) - own.size - (np.cumsum(long) - long)[doc]
        block = begin // BLOCK
        cuts = (begin + own.size - 1) // BLOCK - block + 1
        several = _ranges(np.zeros(len(cuts), np.int64), cuts)
        doc, block, begin, own = (np.repeat(doc, cuts), np.repeat(block, cuts) + several, np.repeat(begin, cuts), Pieces(*[np.repeat(v, cuts) for v in own]))
        low = np.maximum(block * BLOCK - begin, 0)
        size = np.minimum((block + 1) * BLOCK - begin, own.size) - low
        own = own._replace(start=own.start + low, size=size, skip=own.skip + low)
        # Texts by falling length: those that still go on at a turn come first.
        self.rank = np.argsort(np.argsort(-long, kind="stable"))
        heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])][: len(doc)])
        numbers = np.diff(np.r_[heads, len(doc)])
        doc, turn = doc[heads], block[heads]
        sizes = np.minimum(BLOCK, long[doc] - turn * BLOCK)
        runs = np.lexsort((self.rank[doc], turn))
        self.ends = np.r_[0, np.cumsum(np.bincount(turn, weights=sizes))].astype(np.int64) if len(turn) else [0]
        self.active = np.bincount(turn)
        self.run_docs, self.run_sizes = self.rank[doc[runs]], sizes[runs]
        self.docs = np.repeat(self.run_docs, numbers[runs])
        self.place = own.take(_ranges(heads[runs], numbers[runs]))
        self.index = self.place.run()


def inputs(d: Decisions, odds: np.ndarray, index, place: Pieces, slots, own_kinds):
    """Per decision, what the tables say for the outcome that came (log odds), its kind and outcome, and the gate.

    Also where the history expects something (+1, as it came, or -1). ``own_kinds`` numbers
    the kinds of each decision's text.
    """
    alone, context = slots
    x = [(odds[0].take(alone) * (d.bit * np.float32(2) - np.float32(1))).take(index, mode="clip"), odds[1].take(context, mode="clip")]
    code = d.code.take(index, mode="clip")
    # Outcome 0 turns the sign.
    x[1].view(np.int32)[:] ^= np.left_shift(code, 31, dtype=np.int32)
    held, right, state = d.expected()
    last = held[place.token] - place.skip
    own = np.clip(last, 0, place.size)
    ends = np.cumsum(own)
    some, expect = _ranges(np.cumsum(place.size) - place.size, own), np.ones(ends[-1] if len(ends) else 0, np.float32)
    expect[ends[(last > 0) & (last <= place.size) & ~right[place.token]] - 1] = -1
    code = own_kinds + code
    gate = code & -2
    gate *= STATES * MET // 2
    states = np.stack([state[place.token] * MET, np.zeros(len(own), np.int64)], 1)
    gate += np.repeat(states.ravel(), np.stack([own, place.size - own], 1).ravel())
    gate += x[1] != 0
    return x, some, expect, code, gate


def mixed(d: Decisions, odds: np.ndarray, n: int, state: State, turns: Turns, slots):
    """log10 probabilities, mixed, refined and learned online, all n texts in step.

    Gives each text's without the spelling, and each token's spelling.
    """
    # Inputs speak for the outcome that came: their sum is the log odds of it, and what is not sure is the error.
    x, some, some_x, kind, gate = inputs(d, odds, turns.index, turns.place, slots, np.repeat(turns.run_docs * (2 * KINDS), turns.run_sizes))
    # Only few decisions have an expectation.
    some_ends = np.searchsorted(some, turns.ends)
    # Cells of each outcome apart; those of outcome 0 stand mirrored, as their odds do.
    pair = 2 * CELLS
    kind *= CELLS
    # The weights are held negative: what they add up to goes into the exponential as it is.
    weights = [np.tile(-w, n) for w in state.weights.T]
    refined = np.tile(state.refined().reshape(KINDS, CELLS), (n, 1))
    table = np.stack([refined, 1 - refined[:, ::-1]], 1)
    logs = np.zeros(len(gate), np.float32)
    scale, half = np.float32((CELLS - 1) / (2 * REACH)), np.float32(0.5)
    for k, (a, b, m) in enumerate(zip(turns.ends[:-1], turns.ends[1:], turns.active, strict=True)):
        own, gs = [v[a:b] for v in x], gate[a:b]
        e, at = some_x[some_ends[k] : some_ends[k + 1]], some[some_ends[k] : some_ends[k + 1]] - a
        z = weights[0].take(gs, mode="clip")
        z *= own[0]
        for w, v in zip(weights[1:], own[1:], strict=False):
            term = w.take(gs, mode="clip")
            term *= v
            z += term
        if len(at):
            some_gates = gs.take(at, mode="clip")
            z[at] += weights[-1].take(some_gates, mode="clip") * e
        z.clip(-REACH, REACH, out=z)
        p = np.exp(z)
        p += 1
        np.reciprocal(p, out=p)
        np.subtract(REACH, z, out=z)
        z *= scale
        z += half
        cell = z.astype(np.int64)
        cell += kind[a:b]
        np.add(p, table.reshape(-1).take(cell, mode="clip"), out=logs[a:b])
        # What this turn says is used from the next one on.
        np.subtract(1, p, out=p)
        gates = m * GATES
        step = RATE / np.sqrt(np.maximum(np.bincount(gs, minlength=gates), 1))
        for w, v in zip(weights, own, strict=False):
            w[:gates] -= step * np.bincount(gs, weights=p * v, minlength=gates)
        if len(at):
            weights[-1][:gates] -= step * np.bincount(some_gates, weights=p.take(at, mode="clip") * e, minlength=gates)
        count = np.bincount(cell, minlength=m * KINDS * pair).astype(np.float32).reshape(m * KINDS, 2, CELLS)
        ones, now = count[:, 0], refined[: m * KINDS]
        zeros = count[:, 1, ::-1] + ones
        ones -= zeros * now
        zeros += 60
        ones /= zeros
        now += ones
        table[: m * KINDS, 0] = now
        np.subtract(1, now[:, ::-1], out=table[: m * KINDS, 1])
    # So far the sum of both estimates of what came.
    logs *= half
    np.log(logs, out=logs)
    logs *= np.float32(1 / math.log(10))
    place = turns.place
    sums = np.add.reduceat(logs, np.cumsum(place.size) - place.size, dtype=np.float64) if len(logs) else logs
    spelling = np.bincount(place.token[place.spells], weights=sums[place.spells], minlength=len(d.token))
    total = np.bincount(turns.docs, weights=np.where(place.spells, 0, sums), minlength=n)
    return total[turns.rank], spelling


def tuned(docs: DataFrame, vocabulary: Vocabulary, counts: np.ndarray) -> tuple[State, np.ndarray]:
    """Weights to start with, fitted on rows that ``counts`` leave out; and the rows' own counts."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary, _odds(counts)))

    def count(batches):
        vocabulary, odds = sent.value
        counter, cases = Counter(vocabulary), np.zeros(MORE * 2 * SLOTS, np.int64)
        for batch in batches:
            for _, data, offsets in _chunks(batch):
                d = Decisions(data, offsets, vocabulary)
                counter.add(d)
                place = d.pieces()
                index = place.run()
                x, some, expect, code, case = inputs(d, odds, index, place, d.slots(index, place), np.int64(0))
                for v in x:
                    v.clip(-LIMIT, LIMIT, out=v)
                    v *= STEPS
                    np.rint(v, out=v)
                    case *= LEVELS
                    case += v.astype(np.int64)
                # The middle of all levels and expectations, and outcome 1 less the mark of 0.
                case *= 6
                case += ((LEVELS + 1) * LIMIT * STEPS * 3 + 1) * 2 + 1
                case[some] += 2 * expect.astype(np.int64)
                code &= 1
                case -= code
                cases += np.bincount(case, minlength=len(cases))
        # Inputs spoke for what came: those of outcome 0 are turned round.
        tally = cases[:CASES].reshape(GATES, LEVELS, LEVELS, 3, 2)
        tally[..., 0] = tally[:, ::-1, ::-1, ::-1, 0].copy()
        yield from _blocks_of(counter.flush())
        yield from _blocks_of(cases, BLOCKS)

    found = _merged(docs.select(whole_text().alias("text")).mapInArrow(count, "block long, counts binary"), BLOCKS + MORE)
    return State().fit(found[BLOCKS:]), _tables(found)


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, frequent: int = FREQUENT) -> DataFrame:
    """Per row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    Learns from the rows outside the held-out fold. A null text is empty, an empty text has
    its end token only, rows with a null id are learned from, repeated rows count as often;
    without any row to learn from, every token is unknown.
    """
    spark = docs.sparkSession
    train = docs.where(~in_fold(folds, held_out))
    counts = token_counts(train)
    once = F.count(F.when(F.col("c") == 1, 1))
    total, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), once).first()
    # Tokens met once stand for those never met: they are spelled. Bounded: the leaves of the tree.
    top = counts.where("c > 1").orderBy(F.desc("c"), "h").limit(frequent).collect()
    hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    own = np.array([r["c"] for r in top], np.int64)
    vocabulary = Vocabulary(hashes, own, total - int(own.sum()))
    apart = F.coalesce(remainder(folds) == TUNING, F.lit(False))
    most = predictor_counts(train.where(~apart), vocabulary)
    state, others = tuned(train.where(apart), vocabulary, most)
    sent = spark.sparkContext.broadcast((vocabulary, _odds(most + others), state))
    below = total + 0.5 * (distinct + 1)

    def run(batches):
        vocabulary, odds, state = sent.value
        base = np.log10((np.r_[vocabulary.counts, 0] + 0.5) / below)
        for batch in batches:
            for rows, data, offsets in _chunks(batch):
                d, n = Decisions(data, offsets, vocabulary), len(rows)
                turns = Turns(d, n)
                total, spelling = mixed(d, odds, n, state, turns, d.slots(turns.index, turns.place))
                frequent = d.known < len(vocabulary.hashes)
                each = np.where(frequent, base[d.known], 0.0)
                rare, ends = d.token[~frequent].view(np.int64), np.cumsum(np.bincount(d.doc[~frequent], minlength=n))
                ends = pa.array(np.r_[0, ends].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (rare, spelling[~frequent].astype(np.float32))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows)), batch.column("held_out").take(pa.array(rows)), pa.array(np.bincount(d.doc, minlength=n)),
                        pa.array(np.bincount(d.doc[frequent], minlength=n)), pa.array(np.bincount(d.doc, weights=each, minlength=n)), *lists,
                        pa.array(total), pa.array(np.diff(offsets)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "spelled", "score", "n_bytes"],
                )

    rows = docs.select("doc_id", in_fold(folds, held_out).alias("held_out"), whole_text().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, rare array<long>, spelled array<float>, score double, n_bytes long"
    scored = stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    # Rarer tokens are joined with their counts; each occurs too seldom to be hot. One that was
    # met is also predicted by its count; as many are new as were met once.
    each = F.explode(F.arrays_zip("rare", "spelled")).alias("t")
    rare = scored.select("row", each).select("row", F.col("t.rare").alias("h"), F.col("t.spelled").cast("double").alias("s")).join(counts, "h", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / below)
    left = max(total - int(own.sum()), 1)
    new = min(max(once / (left + once), 0.01), 0.99)
    word = F.log10(F.coalesce("c", F.lit(0)) * ((1 - new) / left) + new * F.pow(F.lit(10.0), F.greatest("s", F.lit(-300.0))))
    word = F.when(F.col("s") < -300, F.greatest(word, F.col("s") + math.log10(new))).otherwise(word)
    rest = rare.groupBy("row").agg(F.sum(log).alias("more"), F.count("c").alias("also"), F.sum(word).alias("words"))
    zero = F.lit(0)
    out = scored.join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("words", zero))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", zero)).alias("base_score"), "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
