"""A small corpus with copies, near copies, shared passages and odd rows, and brute-force results over it."""

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string, key int, band int"


def make(n=60, seed=4):
    """(doc_id, text) rows: some empty, null or very long, tied and repeated ones among them."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)] + ["été", "Straße", "данные", "x"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(70)
    docs = []
    for i in range(n):
        t = text(rng.randint(1, 120))
        if i % 7 == 3:
            t = t + "\n" + passage + " " + text(5)
        if i % 11 == 5 and docs:
            t = docs[rng.randrange(len(docs))][1] or ""
        if i % 13 == 6:
            w = (docs[2][1] or "").split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        docs.append((i * 3, t))
    docs += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a " * 30_000), (1004, "ab" * 900),
             (1005, docs[4][1].replace(" ", "\t\n")), (1006, "%%% 123 ..."), (1006, "%%% 123 ..."), (None, docs[4][1]),
             (1007, (docs[5][1] + "\n") * 3), (1008, "Ünï \x85 \xa0 x\x1cy z")]
    return docs


def frame(spark, docs):
    """The rows with the columns of ``documents`` and extra ones whose names clash with the operators' own."""
    return spark.createDataFrame(
        [(i, t, random.Random(i or 7).choice(["en", "de", None]), None if i and i % 9 == 0 else "s", len(t or ""), "d", "k", 1, 2)
         for i, t in docs], SCHEMA).repartition(3)


def ids(docs):
    return [(1 << 63) - 1 if i is None else i for i, _ in docs]


def public(i):
    return None if i == (1 << 63) - 1 else i


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def exact(docs):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    first, size = {}, Counter(norm)
    for i, t in zip(ids(docs), norm):
        first[t] = min(first.get(t, i), i)
    return [(public(i), public(first[t]), size[t], first[t] == i, sha(t)) for i, t in zip(ids(docs), norm)]


def removed_words(docs, width=13):
    first = {}
    split = [(t or "").encode().split() for _, t in docs]
    for i, w in zip(ids(docs), split):
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in zip(ids(docs), split):
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < i:
                gone.update(range(p, p + width))
        out.append((public(i), len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def removed_bytes(docs, width=200):
    raw = [(t or "").encode() for _, t in docs]
    count = Counter(r[p:p + width] for r in raw for p in range(len(r) - width + 1))
    out = []
    for i, r in zip(ids(docs), raw):
        gone = bytearray(len(r))
        for p in range(len(r) - width + 1):
            if count[r[p:p + width]] > 1:
                gone[p:p + width] = b"\1" * width
        runs = sum(1 for j in range(len(r)) if gone[j] and not (j and gone[j - 1]))
        out.append((public(i), len(r), sum(gone), runs, sha(bytes(x for x, g in zip(r, gone) if not g))))
    return out


def removed_lines(docs, run=3):
    split = [(t or "").split("\n") for _, t in docs]
    first = {}
    for i, lines in zip(ids(docs), split):
        for p in range(len(lines) - run + 1):
            k = tuple(lines[p:p + run])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, lines in zip(ids(docs), split):
        gone = set()
        for p in range(len(lines) - run + 1):
            if first[tuple(lines[p:p + run])] < (i, p):
                gone.update(range(p, p + run))
        out.append((public(i), len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    return out


def benchmark_hits(docs, items, width=13):
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = {}
    for item, t in items:
        w = lower(t)
        for p in range(max(1, len(w) - width + 1)) if w else ():
            patterns.setdefault(tuple(w[p:p + width]), set()).add("" if item is None else str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for i, t in docs:
        w, hit, found = lower(t), set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p:p + m])) in patterns:
                    hit.update(range(p, p + m))
                    found |= patterns[k]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
