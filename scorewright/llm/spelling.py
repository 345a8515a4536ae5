"""Operator 12: spelling variants by Bloom-guided neighbourhoods.

Every edit of a vocabulary word that deletes or raises one letter is generated
as a hash and probed against blocked Bloom filters of the vocabulary, which are
sharded by word length and, within a length, by hash into pieces of bounded
size.  Only edits that a filter holds are spelled out and shuffled to an exact
join with the vocabulary, which removes the false positives.  Every unordered
pair of near words is met once: from the longer word by its deletion, between
words of one length from the one whose letter comes first.  Filters are
broadcast ``ROUND_BYTES`` at a time; more of them take more rounds, so what is
broadcast does not grow with the vocabulary.

A word's form is its near word of largest count, if that is ``ratio`` times its
own; the root follows forms to the end.  Along forms counts grow by ``ratio``,
so there is no cycle and pointer jumping ends after log2 of the longest chain.

Null and empty texts have no words; an absent doc_id is written as nothing in
the hashed string; repeated rows count each; ties of the count go to the
smallest word in code-point order; an empty table gives no rows.  Other
columns, and clashing names, are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import stage

#: Letters of a word after lower-casing A-Z, in code-point order.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Words of one piece of a filter; bytes of filters that are broadcast at a time; words probed at once.
PIECE_WORDS, ROUND_BYTES, PROBED = 100_000, 32 << 20, 256
#: A filter block is 8 words of 64 bits with one bit each per word held; 16 bits are kept per word.
_LANES, _BITS = 8, 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def misspelt(docs: DataFrame, every: int, id_col: str, text_col: str) -> DataFrame:
    """(word): each run of letters, A-Z lower-cased; of runs whose hash ``every`` divides, one letter is deleted."""
    own = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    runs = docs.select(own.alias("id"), F.explode(F.regexp_extract_all(docs[text_col], F.lit(RUN), F.lit(0))).alias("run"))
    word = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = runs.select(word.alias("run"), F.crc32(F.concat(F.col("id"), F.lit(":"), word)).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_letters: int = 6, least_count: int = 5, every: int = 199,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): distinct words of enough letters and occurrences."""
    words = misspelt(docs, every, id_col, text_col).filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUE = _mix(np.arange(1, len(LETTERS) + 1, dtype=np.uint64) * np.uint64(_BASE))


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
    return np.where(points < 0xC0, points - 97, points - 0xC0 + 26)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n + 1, _BASE, np.uint64)) * np.uint64(_INVERSE)


def hashes_of(letters: np.ndarray) -> np.ndarray:
    """A polynomial over the letters, mixed."""
    return _mix((_VALUE[letters] * _powers(letters.shape[1])[:-1]).sum(1, dtype=np.uint64))


def _lanes(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and a second hash whose 6-bit fields are the bits set in its lanes."""
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), _mix(h ^ np.uint64(_BASE))


def bloom(hashes: np.ndarray) -> np.ndarray:
    """The blocked filter of these hashes, (blocks, lanes)."""
    blocks = max(1, -(-len(hashes) * _BITS // 512))
    out = np.zeros((blocks, _LANES), np.uint64)
    block, bits = _lanes(hashes, blocks)
    for lane in range(_LANES):
        np.bitwise_or.at(out[:, lane], block, np.uint64(1) << ((bits >> np.uint64(6 * lane)) & np.uint64(63)))
    return out


def holds(filters: dict, parts: int, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that their piece's filter holds (for certain those of its words)."""
    part = hashes % np.uint64(parts)
    found = []
    for p, bits_of in filters.items():
        at = np.nonzero(part == np.uint64(p))[0] if parts > 1 else np.arange(len(hashes))
        block, bits = _lanes(hashes[at], len(bits_of))
        for lane in range(_LANES):  # few are left after the first lanes
            set_ = (bits_of[block, lane] >> ((bits >> np.uint64(6 * lane)) & np.uint64(63))) & np.uint64(1)
            keep = np.nonzero(set_)[0]
            at, block, bits = at[keep], block[keep], bits[keep]
        found.append(at)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def neighbours(words: list[str], filters: dict, parts: dict):
    """(row, candidate) for the edits of words of one length that the filters of this round hold."""
    letters = letters_of(words)
    n, length = letters.shape
    powers = _powers(length)
    terms = _VALUE[letters] * powers[:-1]
    total = terms.sum(1, dtype=np.uint64)
    if length in filters:  # a greater letter in place of one
        change = total[:, None, None] - terms[:, :, None] + _VALUE[None, None, :] * powers[:-1][None, :, None]
        row, at, letter = np.nonzero(np.arange(len(LETTERS))[None, None, :] > letters[:, :, None])
        for i in holds(filters[length], parts[length], _mix(change[row, at, letter])).tolist():
            w, p = words[row[i]], at[i]
            yield int(row[i]), w[:p] + LETTERS[letter[i]] + w[p + 1:]
    if length - 1 in filters:  # one letter deleted, of a run of equal ones the first
        before = np.cumsum(terms, 1, dtype=np.uint64) - terms
        after = (total[:, None] - before - terms) * np.uint64(_INVERSE)
        fresh = np.ones_like(letters, bool)
        fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
        row, at = np.nonzero(fresh)
        for i in holds(filters[length - 1], parts[length - 1], _mix((before + after)[row, at])).tolist():
            w, p = words[row[i]], at[i]
            yield int(row[i]), w[:p] + w[p + 1:]


def _build(batch: pa.Table) -> pa.Table:
    words = batch["word"].to_pylist()
    filled = bloom(hashes_of(letters_of(words)))
    return pa.table({"length": batch["length"][:1], "part": batch["part"][:1],
                     "bits": pa.array([filled.tobytes()], pa.binary())})


def _number(parts: dict):
    """Rows (word) -> (word, length, part): the piece of the filters that holds each word."""
    def number(batches):
        for batch in batches:
            words = batch["word"].to_pylist()
            length = np.fromiter(map(len, words), np.int32, len(words))
            part = np.zeros(len(words), np.int32)
            for k in np.unique(length).tolist():
                at = np.nonzero(length == k)[0]
                part[at] = hashes_of(letters_of([words[i] for i in at])) % np.uint64(parts[k])
            yield pa.RecordBatch.from_pydict({"word": batch["word"], "length": pa.array(length), "part": pa.array(part)})
    return number


def _probe(shared, parts: dict):
    def probe(batches):
        filters: dict = {}
        for length, part, bits in shared.value:
            filters.setdefault(length, {})[part] = np.frombuffer(bits, np.uint64).reshape(-1, _LANES)
        for batch in batches:
            words, counts = batch["word"].to_pylist(), batch["n"].to_pylist()
            by_length: dict = {}
            for i, w in enumerate(words):
                if len(w) in filters or len(w) - 1 in filters:
                    by_length.setdefault(len(w), []).append(i)
            own, near, n = [], [], []
            for length, rows in by_length.items():
                step = max(1, PROBED * 8 // length)
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    for r, candidate in neighbours([words[i] for i in some], filters, parts):
                        own.append(words[some[r]])
                        near.append(candidate)
                        n.append(counts[some[r]])
            yield pa.RecordBatch.from_pydict({"word": pa.array(own, pa.string()), "n": pa.array(n, pa.int64()),
                                              "near": pa.array(near, pa.string())})
    return probe


def near_words(words: DataFrame, piece_words: int = PIECE_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, near, near_n): every unordered pair of ``words`` (word, n) one edit apart, once.

    ``words`` is read several times: stage it.
    """
    spark = words.sparkSession
    sizes = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}
    parts = {k: -(-n // piece_words) for k, n in sizes.items()}
    numbered = words.select("word").mapInArrow(_number(parts), "word string, length int, part int")
    filters, _ = stage(numbered.groupBy("length", "part").applyInArrow(_build, "length int, part int, bits binary"),
                       "bloom-filters")
    rounds, held = [[]], 0
    for length in sorted(parts):
        for part in range(parts[length]):
            held += sizes[length] // parts[length] * _BITS // 8
            if held > round_bytes and rounds[-1]:
                rounds.append([])
                held = sizes[length] // parts[length] * _BITS // 8
            rounds[-1].append((length, part))
    found = None
    for wanted in rounds:
        here = F.array(*(F.lit(length * 1_000_000 + part) for length, part in wanted)) if wanted else F.array(F.lit(-1))
        mine = filters.filter(F.array_contains(here, F.col("length") * 1_000_000 + F.col("part")))
        shared = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        hits = words.mapInArrow(_probe(shared, parts), "word string, n long, near string")
        found = hits if found is None else found.unionByName(hits)
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, "near").select("word", "n", "near", "near_n")


def _forms(words: DataFrame, pairs: DataFrame, ratio: int) -> DataFrame:
    """(word, n, n_near, form, form_n)."""
    ends = F.explode(F.array(F.struct("word", F.col("near"), F.col("near_n")),
                             F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    both = pairs.select(ends.alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer jumping."""
    jumps, _ = stage(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after, _ = stage(jumps.join(onward, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        jumps = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return jumps


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199,
                      piece_words: int = PIECE_WORDS, round_bytes: int = ROUND_BYTES,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root (strings), n, n_near, form_n (longs)."""
    words, _ = stage(vocabulary(docs, least_letters, least_count, every, id_col, text_col), "spelling-words")
    forms, _ = stage(_forms(words, near_words(words, piece_words, round_bytes), ratio), "spelling-forms")
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
