"""What op3 counts and expects, against decision by decision; its work follows distinct tokens and pairs."""

import helpers
import numpy as np

from roentgrid.llm import mixing


def texts_of():
    return [
        "a b a b c a b a d " * 30, "", " one  One\tTWO two", "x" * 700 + "y " + "x" * 700 + "z " + "x" * 700 + "y end", "Straße 漢字 漢字 Straße 漢字 naïve",
        " ".join(helpers.words_of(3, 400, 40)), "a rare%d a rare%d " % (1, 2) * 3, "b a",
    ]


def model(frequent):
    data = [t.encode() for t in texts_of()]
    blob, offsets = np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])]
    h, c = np.unique(mixing.tokens(blob, offsets)[0], return_counts=True)
    top = np.argsort(-c, kind="stable")[:frequent]
    return blob, offsets, mixing.Vocabulary(h[top], c[top], int(c.sum() - c[top].sum()))


def test_counts_are_those_of_every_decision():
    for frequent in (0, 1, 12):
        blob, offsets, vocabulary = model(frequent)
        d = mixing.Decisions(blob, offsets, vocabulary)
        place = d.pieces()
        index = place.run()
        alone, context = d.slots(index, place)
        want = np.stack([np.bincount(slot * 2 + d.bit[index], minlength=2 << mixing.TABLE_BITS) for slot in (alone[index], context)])
        counter = mixing.Counter(vocabulary)
        counter.add(d)
        assert len(index) and (counter.flush() == want).all()
        counter.add(d)
        counter.add(mixing.Run(blob, offsets, vocabulary))
        assert (counter.flush() == 3 * want).all()


def test_counting_works_on_distinct_pairs(monkeypatch):
    """Ten times the text with the same pairs makes no more decisions to list."""
    vocabulary = model(12)[2]
    made = []
    ranges = mixing._ranges
    monkeypatch.setattr(mixing, "_ranges", lambda starts, sizes: made.append(int(sizes.sum())) or ranges(starts, sizes))

    def listed(times):
        made.clear()
        data = np.frombuffer(b"a b c " * times, np.uint8)
        counter = mixing.Counter(vocabulary)
        counter.add(mixing.Run(data, np.array([0, len(data)]), vocabulary))
        return counter.flush().sum(), sum(made)

    (few, least), (many, most) = listed(500), listed(5000)
    assert many > 9 * few and most == least


def test_expectations_against_brute_force():
    """What stood after the last occurrence of the token before is expected up to the first other outcome."""
    for frequent in (0, 5, 12):
        blob, offsets, vocabulary = model(frequent)
        d = mixing.Decisions(blob, offsets, vocabulary)

        def outcomes(k, d=d):
            w = d.which[k]
            return [*d.bit[d.head[w] : d.head[w] + d.size[w]], *d.bit[d.tail[w] : d.tail[w] + d.extra[w]]]

        held, right, state = d.expected()
        seen, runs = {}, {}
        for k, (token, doc) in enumerate(zip(d.token.tolist(), d.doc.tolist(), strict=True)):
            first = k == 0 or d.doc[k - 1] != doc
            guess = None if first else seen.get((doc, d.token[k - 1]))
            # The state looks at the two tokens before, over the start of a text as well.
            level = 1 + runs.get(k - 1, False) + (runs.get(k - 1, False) and runs.get(k - 2, False))
            runs[k] = guess is not None and d.token[guess] == token
            if not first:
                seen[doc, d.token[k - 1]] = k
            if guess is None:
                assert (held[k], state[k]) == (0, 0)
                continue
            a, b = outcomes(guess), outcomes(k)
            want = len(b) if runs[k] else 1 + next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
            assert (held[k], bool(right[k]), state[k]) == (want, runs[k], level)


def test_order_is_stable_where_only_low_bits_differ():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(0, 1 << 63, 1000).astype(np.uint64) // np.uint64(7) * np.uint64(7), np.zeros(0, np.uint64)):
        x = np.r_[x, x[::2]]
        assert (mixing._ordered(x) == np.argsort(x, kind="stable")).all()


def test_blocks_are_sent_as_narrow_as_they_may_be(spark):
    counts = np.zeros((2, 2 << mixing.TABLE_BITS), np.int64)
    most = [0xFFFF, 1 << 16, (1 << 32) - 1, 1 << 32, 1 << 40]
    for block, value in enumerate(most):
        counts[0, block * 2 * mixing.SLOTS + 5] = value
    rows = [(k, bytearray(v)) for batch in mixing._blocks_of(counts) for k, v in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
    assert [len(v) // (2 * mixing.SLOTS) for _, v in rows] == [2, 4, 4, 8, 8]
    found = spark.createDataFrame(rows * 3, "block long, counts binary").repartition(3)
    assert (mixing._tables(mixing._merged(found)) == 3 * counts).all()
