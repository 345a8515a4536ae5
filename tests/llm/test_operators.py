"""Each training-data operator against brute force on a small corpus with odd rows, and on an empty table."""

import zlib

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import decontam, exact_dedup, language_id, line_dedup, near_dedup, packing, quality
from scorewright.llm import substring_dedup, suffix_dedup, superkmers, token_records, tokens


@pytest.fixture(scope="module")
def docs():
    return corpus.make()


@pytest.fixture(scope="module")
def table(spark, docs):
    return corpus.frame(spark, docs).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


def library_ids(docs):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokens.vocabulary_path())
    return [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in docs]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunked_encoding_equals_the_library(docs):
    odd = ["a  b", "a \n b", " x ", "don't we're. it's, 'tis", "1.5, 2. x.. y,.", "\n", "<|endoftext|> a <|endoftext|>b. ",
           "'s. 't, a's. b'. c'", ", a", "a\x02b c", "a\x03 b, c", " , b, c_, d", "a.\nB, c.\n\nD", "x　y z", "É, ê. Über"]
    encoder = tokens.encoder(tokens.vocabulary_path())
    for text in odd + [t or "" for _, t in docs]:
        want = encoder.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == want


def test_op1_round_trip(spark, docs, table, empty, tmp_path):
    path = str(tmp_path / "records")
    got = token_records.token_records(table, path=path).collect()
    order = sorted(zip(corpus.ids(docs), [t or "" for _, t in docs], library_ids(docs)))
    start, want = 0, []
    for i, _, own in order:
        want.append((corpus.public(i), start, len(own), crc(own)))
        start += len(own)
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == want
    index = spark.createDataFrame([r for r in token_records.build_index(spark, path).collect()][::2], token_records.INDEX)
    some = {(r["doc_id"], tuple(r["ids"])) for r in token_records.read_records(spark, path, index).collect()}
    assert some and some <= {(i, tuple(own)) for i, _, own in order}
    assert token_records.token_records(empty).count() == 0


def test_op1_detects_damage():
    whole = token_records.frame(b"12345678abcd") + b"\n"
    assert token_records.unframe(whole, 0) == b"12345678abcd"
    for at in (0, 9, 14, len(whole) - 3):
        with pytest.raises(ValueError):
            token_records.unframe(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1:], 0)


def test_op10_pieces_cover_every_id_once(docs, table, empty):
    got = packing.pack(table, block=64).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(own) == r["length"] > 0
        by_doc.setdefault(r["doc_id"], []).append((r["start"], own, r["doc_tokens"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for (i, _), own in zip(docs, library_ids(docs)):
        want.setdefault(i, []).append(own)
    for i, owns in want.items():
        pieces = sorted(by_doc[i])
        if len(owns) == 1:
            assert sum((p for _, p, _ in pieces), []) == owns[0] and {n for _, _, n in pieces} == {len(owns[0])}
        else:
            assert sorted(sum((p for _, p, _ in pieces), [])) == sorted(sum(owns, []))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_op10_little_padding():
    rng = np.random.default_rng(0)
    lengths = [n for size in rng.integers(1, 3000, 900) for _, n in packing.cut(int(size), 1024, 256) if n < 1024]
    groups = packing.windows(lengths, 1024)
    sums = [sum(lengths[i] for i in g) for g in groups]
    assert sorted(i for g in groups for i in g) == list(range(len(lengths)))
    assert max(sums) <= 1024 and sum(sums) > 0.97 * 1024 * len(sums) and max(sums) - min(sums) < 100


def test_op5(docs, table, empty):
    got = corpus.rows(exact_dedup.exact_dedup(table), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(corpus.exact(docs), key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_op5_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 1000):
        digests = [rng.bytes(32) for _ in range(n)]
        seeds, slots = exact_dedup.build_hash(digests)
        assert sorted(slots) == list(range(n))
        words = exact_dedup._words(digests)
        own = seeds[(words[:, 0] % np.uint64(len(seeds))).astype(np.int64)]
        assert (exact_dedup._slot(words[:, 1], own, n) == slots).all()


def test_op6(spark, docs, table, empty):
    long = [t for _, t in docs if t and len(t.split()) > 40]
    items = [(1, " ".join(long[0].split()[3:30]).upper()), (2, "alpha beta"), (20, long[1]), (None, long[2]), (3, None),
             (4, "..."), (5, "changed"), (5, "changed"), (6, " ".join(long[0].split()[10:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(corpus.benchmark_hits(docs, items), key=repr)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert corpus.rows(decontam.decontaminate(table, bench), *names) == want
    assert corpus.rows(decontam.decontaminate(table, bench, patterns_per_block=20), *names) == want
    assert not decontam.decontaminate(table, bench.limit(0)).filter("n_hit > 0").count()
    assert decontam.decontaminate(empty, bench).count() == 0


def test_op7(docs, table, empty):
    got = corpus.rows(substring_dedup.digest(substring_dedup.repeated_words(table)),
                      "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(corpus.removed_words(docs), key=repr)
    assert substring_dedup.repeated_words(empty).count() == 0


def test_op9(docs, table, empty):
    got = corpus.rows(suffix_dedup.digest(suffix_dedup.repeated_bytes(table)),
                      "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(corpus.removed_bytes(docs), key=repr)
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def test_ops_7_and_9_over_segment_borders(docs, table, monkeypatch):
    """Long texts are packed in overlapping segments, flush by flush: no window is lost or added."""
    tokens9 = superkmers.Windows(False, 200, 16)
    text = docs[4][1] * 5
    whole = superkmers.pack(tokens9, [text.encode()], np.zeros(0, np.uint64))
    parts = [(o, superkmers.pack(tokens9, [s], np.zeros(0, np.uint64))) for o, s in superkmers.segments_of(tokens9, text, 300)]
    windows = lambda p, o=0: {(o + b + j, m) for b, n, m in zip(p[1], p[2], p[3]) for j in range(n)}
    assert set().union(*(windows(p, o) for o, p in parts)) == windows(whole)
    assert len(windows(whole)) == len(text.encode()) - 199


def test_op9_suffix_array():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.integers(1, rng.choice([2, 3, 40]) + 1, rng.integers(1, 50))
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_op8(docs, table, empty):
    got = corpus.rows(line_dedup.repeated_lines(table), "doc_id", "n_lines", "n_removed", "kept")
    assert got == sorted(corpus.removed_lines(docs), key=repr)
    assert line_dedup.repeated_lines(empty).count() == 0


def test_op8_hot_runs(spark):
    docs = [(i, "\n".join([f"own {i}", "l1", "l2", "l3", "l4", f"end {i}"] * (1 + i % 2))) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = corpus.rows(line_dedup.repeated_lines(frame), "doc_id", "n_lines", "n_removed", "kept")
    assert got == sorted(corpus.removed_lines(docs), key=repr)


def test_op3(spark, table, empty):
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.language_id(table).collect() if r["score"] is not None}
    assert {(1000, "und"), (1001, "und"), (1002, "und"), (1006, "und")} <= got
    assert {p for _, p in got} <= {"en", "de", "und"}
    assert language_id.language_id(empty).count() == 0
    import random
    rng = random.Random(0)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["shti", "grz", "wo"], "cc": ["éau", "que", "les"], "dd": ["ung", "sch", "ei"]}
    rows = [(i, " ".join("".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(40)), k)
            for i, (k, s) in enumerate(list(sounds.items()) * 40)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {i: k for i, _, k in rows}
    held = [r for r in language_id.language_id(made).collect() if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_op3_codewords_part_all_languages():
    for k in (1, 2, 4, 6, 9, 40):
        code = language_id.codewords(k)
        assert len(np.unique(code, axis=0)) == k
        if k > 1:
            assert (abs(code.sum(0)) < k).all()


def quality_of(docs, labels):
    return quality.quality(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def test_op4(spark, table, empty):
    import random
    rng = random.Random(1)
    words = ["w" + "".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        junk, toxic = i % 5 == 0, i % 7 == 0
        own = [w + ("%%%" if junk else "") for w in rng.choices(words, k=40)] + ["rubbishword"] * toxic
        rows.append((i, " ".join(own), "en", f"s{i % 4}"))
        if i % 2:
            labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_of(docs, marks).collect()}
    assert len(kept) == 600
    wrong = [i for i in kept if kept[i] == (i % 5 == 0 or i % 7 == 0)]
    assert len(wrong) <= 6
    odd = quality_of(table, marks)
    assert odd.count() == table.count() and odd.filter("kept is null").count() == 0
    assert quality_of(empty, marks).count() == 0
    assert quality_of(table, marks.limit(0)).filter("NOT kept").count() == 0


def test_op4_shrinks_sparse_sites(spark):
    rows = [(f"h{h}", f"h{h}/p{p}", 0.9 if h else 0.2, 0.01) for h in range(4) for p in range(3) for _ in range(200)]
    rows += [("h1", "h1/rare", 0.0, 0.01)]
    scored = spark.createDataFrame(rows, "host string, path string, p_quality double, p_toxic double")
    got = {r["path"]: r for r in quality.site_posteriors(scored, "host", "path").collect()}
    assert got["h0/p0"]["path_quality"] < 0.35 < got["h1/p0"]["path_quality"]
    assert got["h1/rare"]["path_quality"] > 0.5  # one document does not make a site bad


def jaccard_classes(docs, threshold=0.8):
    """Classes by the operator's own weighted similarity over all pairs."""
    words = [decontam.words_of(t or "") for _, t in docs]
    df = np.zeros(near_dedup.FREQUENCIES)
    for w in words:
        h, _ = near_dedup.shingles(w)
        df[np.unique((h >> np.uint64(48)).astype(np.int64))] += 1
    rarity = 1 + near_dedup.RARITY * np.log(len(docs) / np.maximum(df, 1)) / np.log(len(docs))
    vectors = [(h, near_dedup.weighted(h, tf, rarity)) for h, tf in map(near_dedup.shingles, words)]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if words[a] and words[b] and near_dedup.similarity(vectors[a], vectors[b]) >= threshold:
                label = [label[b] if x == label[a] else x for x in label]
    own = corpus.ids(docs)
    least = {}
    for i, x in zip(own, label):
        least[x] = min(least.get(x, i), i)
    return {(corpus.public(i), corpus.public(least[x])) for i, x in zip(own, label) if words}


def test_op2(docs, table, empty):
    got = near_dedup.near_dedup(table)
    assert got.count() == len(docs)
    want = {(i, c) for i, c in jaccard_classes(docs)}
    assert {(r["doc_id"], r["class_id"]) for r in got.collect()} == want
    assert near_dedup.near_dedup(empty).count() == 0


def test_op2_star_of_near_copies(spark, monkeypatch):
    """Copies that resemble the original but not each other; hot buckets are split and meet again."""
    import random
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = [(500, " ".join(base))]
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(len(own)), 2):
            own[at] = f"x{i}y{at}"
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "LIMIT", 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["class_id"]) for r in near_dedup.near_dedup(frame).collect()}
    assert got == jaccard_classes(docs)


def _families(between, members, tag):
    """Two families of near copies that differ in ``between`` words; one member of each, far from its own, has words in common."""
    base = [f"{tag}{i}" for i in range(400)]
    other = [f"o{i}" if i % 10 == 0 and 0 < i <= 10 * between else w for i, w in enumerate(base)]
    docs = []
    for family, text in enumerate((base, other)):
        for i in range(members):
            own = list(text)
            own[300 + 20 * family + i] = f"x{family}y{i}"
            if i == members - 1:
                own = [f"z{at}" if at in (200, 210, 220) else w for at, w in enumerate(text)]
            docs.append((100 * family + i, " ".join(own)))
    return docs


def test_op2_one_link_between_dense_families(spark):
    """Every hopeful pair of a bucket is verified: two families of near copies may hang together by one link."""
    docs = _families(8, 10, "d")
    want = jaccard_classes(docs)
    assert {c for _, c in want} == {0} and len({c for _, c in jaccard_classes(docs[:9] + docs[10:])}) == 2
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in near_dedup.near_dedup(frame).collect()} == want


def test_op2_pairs_in_a_hot_template(spark, monkeypatch):
    """Near copies among documents that share a template are found however large the bucket is."""
    import random
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(0, 300, 6), 5):
            own[at] = f"x{i}y{at}"
        docs.append((i, " ".join(own)))
        if i < 100:
            for at in rng.sample(range(3, 300, 6), 4):
                own[at] = f"z{i}y{at}"
            docs.append((1000 + i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "LIMIT", 8)
    want = jaccard_classes(docs)
    assert 100 < len({c for _, c in want}) <= 150
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in near_dedup.near_dedup(frame).collect()} == want


def test_op2_reads_whole_words():
    """Long words that differ only in the middle are different, as in templated text without spaces."""
    texts = [" ".join(f"начало{i:02}{tag}конец" for i in range(30)) for tag in ("один", "двое", "одно")]
    runs = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(decontam.words_of, texts)]
    sets = [set(near_dedup.shingles(decontam.words_of(t))[0].tolist()) for t in texts]
    for a in range(3):
        for b in range(3):
            assert len(sets[a] & sets[b]) == len(runs[a] & runs[b])


def test_op2_samples_agree_as_often_as_texts_overlap():
    variates = near_dedup._variates()
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = h[:350], h[50:]
    ones = lambda x: np.ones(len(x)) * 1.1
    alike = np.mean(near_dedup.sample(a, ones(a), variates) == near_dedup.sample(b, ones(b), variates))
    assert abs(alike - 300 / 400) < 0.2


def test_upper_bound_of_similarity_loses_no_pair():
    rng = np.random.default_rng(9)
    for size in (1, 4, 40, 300, 900):
        for share in (0.02, 0.1, 0.3):
            h = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            other = np.unique(np.concatenate([h[rng.random(len(h)) >= share], rng.integers(
                0, 1 << 63, 1 + int(size * share), dtype=np.uint64)]))
            weights = dict(zip(np.union1d(h, other).tolist(), (1 + 3 * rng.random(2 * size + 2)).tolist()))
            a, b = ((x, np.array([weights[i] for i in x.tolist()])) for x in (h, other))
            cells = np.stack([near_dedup.sketch(*a), near_dedup.sketch(*b)]).astype(np.float32)
            pair = np.array([0]), np.array([1])
            assert near_dedup.can_reach(cells, *pair, near_dedup.similarity(a, b))[0]
    # cells of huge weight bound nothing, and strangers are told apart
    huge = np.stack([near_dedup.sketch(np.arange(3, dtype=np.uint64), np.full(3, 1e9)), near_dedup.sketch(
        np.arange(2, dtype=np.uint64), np.ones(2))]).astype(np.float32)
    assert near_dedup.can_reach(huge, *pair, 0.8)[0]
    apart = np.stack([near_dedup.sketch(np.arange(k, k + 20, dtype=np.uint64) << np.uint64(40), np.ones(20))
                      for k in (0, 40)]).astype(np.float32)
    assert not near_dedup.can_reach(apart, *pair, 0.8)[0]


def test_samples_do_not_depend_on_how_many_are_drawn_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    h, w = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)), 1 + rng.random(500)
    variates = near_dedup._variates()
    want = near_dedup.sample(h, w, variates)
    for many in (1, 1000, 1 << 20):
        monkeypatch.setattr(near_dedup, "AT_ONCE", many)
        assert (near_dedup.sample(h, w, variates) == want).all()


def test_differencing_places_single_pieces_without_sorting_all_windows():
    import heapq
    import random
    import time
    import numpy as np

    def plain(lengths, k):
        heap = [(-n, i, np.array([n], np.int64), [[i]]) for i, n in enumerate(lengths)]
        heapq.heapify(heap)
        number = len(lengths)
        while len(heap) > 1:
            (_, _, a, own), (_, _, b, other) = heapq.heappop(heap), heapq.heappop(heap)
            both = max(len(a) + len(b) - k, 0)
            keep, start = len(a) - both, len(b) - both
            sums = np.concatenate((a[:keep], a[keep:] + b[start:][::-1], b[:start]))
            members = own[:keep] + [x + y for x, y in zip(own[keep:], other[start:][::-1])] + other[:start]
            order = np.argsort(-sums, kind="stable")
            sums, members = sums[order], [members[i] for i in order]
            heapq.heappush(heap, ((int(sums[-1]) if len(sums) == k else 0) - int(sums[0]), number, sums, members))
            number += 1
        return heap[0][3] if heap else []

    rnd = random.Random(3)
    for n, k, most in [(0, 3, 9), (1, 1, 9), (5, 1, 9), (9, 4, 3), (60, 7, 5), (400, 90, 256), (50, 60, 4)] * 5:
        lengths = [rnd.randint(1, most) for _ in range(n)]
        assert packing.difference(list(lengths), k) == plain(lengths, k)
    lengths = [rnd.randint(1, 256) for _ in range(4096)]
    took = []
    for f in (plain, packing.difference):
        t = time.process_time()
        f(lengths, 520)
        took.append(time.process_time() - t)
    assert took[1] < 0.6 * took[0]


def test_lone_marks_are_found_from_the_marks():
    """The same answer as the plain pattern on odd texts, in a fraction of its time on letters."""
    import random
    import re
    import time

    from scorewright.llm import tokens
    plain, rng = re.compile(r"(?:^|\W|_)[.,][ \n]").search, random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choices("aé_1.,;' \n中", k=rng.randint(0, 6)))
        assert bool(tokens._LONE(text)) == bool(plain(text)), text
    text = "letters and spaces, then more of them. " * 5_000

    def least(find):
        took = []
        for _ in range(5):
            began = time.perf_counter()
            find(text)
            took.append(time.perf_counter() - began)
        return min(took)
    assert least(tokens._LONE) < 0.5 * least(plain)
