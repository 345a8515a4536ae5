"""Toxicity, spelling variants and token alignment against brute force, on odd rows and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus
import numpy as np
import pytest

from scorewright.llm import alignment, spelling, toxicity


@pytest.fixture(scope="module")
def docs():
    return corpus.make()


@pytest.fixture(scope="module")
def table(spark, docs):
    return corpus.frame(spark, docs).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


# ---- spelling variants

def variants(docs, least=6, count=5, ratio=5, every=199):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    around = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= ratio * n[w] else None for w, v in around.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n)


def spelt(rows):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows)


def misspelt_corpus(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abdeéÿ", k=rng.randint(5, 9))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "zzÀzzzz"]
    words = []
    for w in base:
        words += [w] * rng.choice([60, 300, 1500])
        for _ in range(6):
            p = rng.randrange(len(w))
            v = rng.choice([w[:p] + w[p + 1:], w[:p] + "d" + w[p:], w[:p] + "x" + w[p + 1:]])
            words += [v] * rng.choice([4, 7, 11, 60])
    rng.shuffle(words)
    return [(i, " ".join(x.upper() if rng.random() < 0.1 else x for x in words[i::40]) + " × a1b") for i in range(40)]


@pytest.mark.parametrize("limits", [{}, {"piece_words": 7, "round_bytes": 60}])
def test_op12_equals_brute_force(spark, limits):
    rows = misspelt_corpus() + [(None, "abdeabde " * 9), (None, None), (5, "")]
    got = spelling.spelling_variants(corpus.frame(spark, rows), every=31, **limits).collect()
    want = variants(rows, every=31)
    assert spelt(got) == want
    assert any(w[1] and w[2] != w[1] for w in want), want[:50]
    assert any(w[4] > 3 for w in want)


def test_op12_odd_rows_and_empty(docs, table, empty):
    assert spelt(spelling.spelling_variants(table, least_letters=3).collect()) == variants(docs, least=3)
    assert spelling.spelling_variants(empty).count() == 0


def test_op12_filters_hold_their_words():
    words = sorted({"".join(random.Random(i).choices(spelling.LETTERS, k=9)) for i in range(3000)})
    hashes = spelling.hashes_of(spelling.letters_of(words))
    held = {0: spelling.bloom(hashes)}
    assert len(spelling.holds(held, 1, hashes)) == len(words)
    others = spelling.hashes_of(spelling.letters_of([w[::-1] for w in words]))
    assert len(spelling.holds(held, 1, others)) < 60


# ---- token alignment

def aligned(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    from scorewright.llm.tokens import byte_alphabet, vocabulary_path
    a_tool = Tokenizer.from_file(vocabulary_path())
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    byte = {c: b for b, c in byte_alphabet().items()}
    rows, count = [], Counter()
    for i, text in docs:
        got = None
        if text:
            a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
            bytes_a = [bytes(byte[c] for c in a_tool.id_to_token(t)) for t in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b_tool.is_byte(t) else p.replace("▁", " ").encode()
                       for t, p in zip(b, map(b_tool.id_to_piece, b))]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
                links = [(p, q) for p, x in enumerate(ends_a) for q in [int(np.searchsorted(ends_b, x))] if ends_b[q] == x]
                groups, p0, q0 = [], 0, 0
                for p, q in links:
                    groups.append(",".join(map(str, a[p0:p + 1])) + "|" + ",".join(map(str, b[q0:q + 1])))
                    p0, q0 = p + 1, q + 1
                pairs = [(a[p], b[q]) for p, q in links]
                count.update(pairs)
                got = len(a), len(b), ";".join(groups), pairs
        rows.append((i, got))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if g is None else
            (i, g[0], g[1], len(g[3]), len(g[3]), sum(count[x] == most[x[1]] for x in g[3]), sum(count[x] for x in g[3]),
             hashlib.sha256(g[2].encode()).hexdigest()) for i, g in rows]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_op13_equals_brute_force(spark, docs, frequent):
    odd = [(7000, "<|endoftext|> x"), (7001, "a▁b"), (7002, "<0x41>  <unk> é"), (7003, "日本語 テキスト 𝔘𝔫"), (7004, " "), (None, "a\tb  c\n\n d")]
    rows = docs + odd
    table = corpus.frame(spark, rows)
    if frequent == 0:
        frequent = 1
    got = alignment.align(table, frequent=frequent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(aligned(rows), key=key)
    for r in got:
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")


def test_op13_empty(empty):
    assert alignment.align(empty).count() == 0


def test_op13_runs_are_all_common_ends():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 60)
        p = rng.choice([0.1, 0.5, 0.95])
        a, b = ([x for x in range(1, n) if rng.random() < p] + [n] for _ in range(2))
        at_a, at_b = alignment.common_ends(np.array(a), np.array(b))
        assert [a[i] for i in at_a] == [b[j] for j in at_b] == sorted(set(a) & set(b))


# ---- toxicity

def plain_kernel(s, t):
    """Normalised gap-weighted subsequence kernel of order 3, by listing subsequences; the best of the windows of ``s``."""
    def features(kinds):
        out = Counter()
        for i in range(len(kinds)):
            for j in range(i + 1, min(len(kinds), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(kinds), i + toxicity.SPAN)):
                    if kinds[i] and kinds[j] and kinds[k]:
                        out[kinds[i], kinds[j], kinds[k]] += toxicity.DECAY ** (k - i + 1)
        return out
    y = features(next(toxicity.windows_of([t]))[1][0].tolist())
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    some = [features(w.tolist()) for _, found in toxicity.windows_of([s]) for w in found]
    return max(dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 for x in some)


def test_op11_kernel_equals_its_definition():
    landmarks = ["stupid", "réeux", "aaa", "mississippi"]
    units = ["st.u.pid", "(stuupid)", "dummy", "reeuxment", "aaaa", "missi", "x" * 20, "abcabcabcabc", "q" * 30 + "stupid" + "q" * 100]
    got = toxicity.Kernel(landmarks).compute(units)
    for i, u in enumerate(units):
        for j, m in enumerate(landmarks):
            assert abs(got[i, j] - plain_kernel(u, m)) < 1e-5
    assert not toxicity.Kernel(landmarks).compute(["", "ab", "..", "12"]).any()


def test_op11_machine_is_optimal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=300) > 0.2, 1.0, -1.0)
    w = toxicity.support_vector_machine(x, y, 2.0)
    one = np.hstack([x, np.ones((300, 1))])
    slack = np.maximum(0, 1 - y * (one @ w))
    gradient = np.append(w[:-1], 1e-6 * w[-1]) - 4 * one.T @ (y * slack)
    assert np.abs(gradient).max() < 1e-3


def labelled(n=900, seed=2):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("aeiorntls", k=rng.randint(3, 8))) for _ in range(300)]
    bad = ["zwickup", "gromfeld", "pumbad"]
    spelled = lambda w: rng.choice([w, w, w, w[:3] + "." + w[3:], w[:2] + w[1] + w[2:], " ".join(w)])
    rows, told = [], []
    for i in range(n):
        toxic = i % 4 == 0
        lines = [" ".join(rng.choices(clean, k=rng.randint(4, 12))) + "." for _ in range(rng.randint(2, 8))]
        if toxic:
            for _ in range(2):
                k = rng.randrange(len(lines))
                lines[k] = f"{lines[k][:-1]} {spelled(rng.choice(bad))} {rng.choice(clean)}."
        rows.append((i, "\n".join(lines)))
        told.append((i, int(toxic)))
    return rows, told


def test_op11_held_out_rows(spark):
    rows, told = labelled()
    odd = [(None, "zwickup"), (5000, None), (5001, ""), (5002, "a " * 50_000 + "gromfeld"), (1, rows[1][1]), (1, "x")]
    table = corpus.frame(spark, rows + odd)
    labels = spark.createDataFrame(told + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(table, labels).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    by = {r["doc_id"]: r for r in got}
    told = dict(told)
    held = [i for i in told if by[i]["held_out"]]
    assert sum(by[i]["predicted"] == told[i] for i in held) >= 0.97 * len(held) and len(held) > 100
    assert by[None]["predicted"] == 1 and by[5002]["predicted"] == 1 and by[5000]["predicted"] == by[5001]["predicted"] == 0
    # the same rows in other partitions train the same model
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table.repartition(7), labels).collect()}
    assert all(abs(again[i] - by[i]["score"]) < 1e-9 for i in held)


def test_op11_without_both_classes(spark, table, empty):
    labels = spark.createDataFrame([(i * 3, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(table, labels).collect()} == {1.0}
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.toxicity(table, none).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0
