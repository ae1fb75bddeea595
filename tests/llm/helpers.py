"""Small documents with the awkward cases, and brute-force forms of the operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, h long, score double, part int"


def words_of(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary):x}" for _ in range(n)]


def documents(spark, texts, ids=None):
    """Documents of the given texts; also columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t) if t else 0, "k", 7, 0.5, 3) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def awkward(extra=()):
    """Null and empty texts, blanks, a very long text, repeated texts, double spaces, other scripts."""
    long = " ".join(words_of(1, 30_000))
    return [None, "", "   \n\t ", "one", long, *[" ".join(words_of(2, 60))] * 3, "a  b   c\n\n d", "Straße 漢字 \U0001f600 naïve x", *extra]


FORMS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def fixed_spans(text):
    found = []
    for rank, (kind, form) in enumerate(FORMS):
        for m in form.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 10 <= len(digits) <= 15
            ):
                found.append((m.start(), rank, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


BENCH_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return BENCH_WORD.findall((text or "").encode().lower())


def leaks(texts, items, width=10):
    """(n_words, n_hit, items) of every text."""
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for text in texts:
        w = bench_words(text)
        hit, found = np.zeros(len(w), bool), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    hit[i : i + size] = True
                    found |= own
        out.append((len(w), int(hit.sum()), sorted(str(i) for i in found if i is not None)))
    return out


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes, radius=2):
    """Number of the first member of each code's class."""
    label = list(range(len(codes)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(codes))]
