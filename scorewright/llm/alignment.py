"""Operator 13: alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers write the same bytes, a space and the text, so a token is known
by the byte at which it ends.  Where two ends agree, at index i of the first
and j of the second, the following tokens mostly agree one to one: they lie on
the diagonal j - i.  Blocks of 1, 2, 4, ... ends on that diagonal are compared
at once, and halves of the block that differs find the first difference.  From
there the ends are merged step by step until they agree again, which sets the
new diagonal.

The links of a document are counted once per pair of ids; pair counts of the
whole corpus are one aggregate over them.  The ``frequent`` most frequent pairs
(a bound on what is broadcast) are looked up where the documents are; the other
pairs, none of which can be hot, are joined with their counts.

Null and empty texts, and texts whose tokens of either kind do not spell space
and text, have no tokens: zeros and an empty string of groups.  Repeated rows
and rows without an id count each and keep their own result; an empty table
gives no rows.  Other columns, and clashing names, are never read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import keyed, public_id, stage
from scorewright.llm.tokens import ChunkEncoder, byte_alphabet, vocabulary_path

#: Pairs whose counts are broadcast, 17 bytes each.
FREQUENT = 500_000
#: Distinct pairs that a counting task holds before it passes them on.
HELD = 2_000_000
#: Words whose ids a worker remembers.
MEMO = 400_000
_WIDTH = 4
_ADJACENT = re.compile("^ |  | $").search


def runs_of(a: bytes, b: bytes) -> list[tuple[int, int, int]]:
    """(first, after, shift): ends a[first:after] equal b[first + shift:after + shift]; all common ends, in order.

    ``a`` and ``b`` are strictly rising token ends, packed ``_WIDTH`` bytes each; the last ones agree.
    """
    n, m, i, j, found, w = len(a), len(b), 0, 0, [], _WIDTH
    one, other = memoryview(a).cast("I"), memoryview(b).cast("I")
    while i < n and j < m:
        first, size = i, 4 * w
        while True:  # along the diagonal in doubling blocks
            x, y = a[i:i + size], b[j:j + size]
            if x != y:
                break
            i, j, size = i + size, j + size, 2 * size
            if i >= n or j >= m:
                i, j = min(i, n), min(j, m)
                break
        if x != y:  # the lowest bit that differs is in the first end that does, or past the shorter block
            least = min(len(x), len(y))
            differ = int.from_bytes(x[:least], "little") ^ int.from_bytes(y[:least], "little")
            same = ((differ & -differ).bit_length() - 1) // (8 * w) * w if differ else least
            i, j = i + same, j + same
        if i > first:
            found.append((first // w, i // w, (j - i) // w))
        if i >= n or j >= m:
            break
        p, q = i // w, j // w
        x, y = one[p], other[q]
        while x != y:  # an irregular group: the one that ends first goes on
            if x < y:
                p += 1
                x = one[p]
            else:
                q += 1
                y = other[q]
        i, j = p * w, q * w
    return found


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into both of the ends that agree."""
    runs = np.array(runs_of(ends_a.astype("<u4").tobytes(), ends_b.astype("<u4").tobytes()), np.int64).reshape(-1, 3)
    length = runs[:, 1] - runs[:, 0]
    at = np.arange(length.sum()) + np.repeat(runs[:, 0] - (np.cumsum(length) - length), length)
    return at, at + np.repeat(runs[:, 2], length)


class Vocabulary:
    """Bytes, lengths and decimal digits of ids."""

    def __init__(self, spelt: list[bytes], inside: bytes, last: bytes):
        self.spelt = spelt
        self.lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.digits = np.array([b"%d%s" % (i, end) for end in (inside, last) for i in range(len(spelt))], object)

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        return bool(self.lengths[ids].sum() == len(raw) and b"".join(map(self.spelt.__getitem__, ids.tolist())) == raw)

    def written(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Each id in digits with the mark that follows it, another one at the positions ``last``."""
        at = ids.astype(np.int64)
        at[last] += len(self.spelt)
        return self.digits[at]


class Aligner:
    """Both tokenizers of one Python worker.

    Where no piece of the second vocabulary holds a space behind another character, a text without spaces side by
    side or at its ends is encoded word by word, and a bounded memo knows the ids of the words.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.encoder_a = ChunkEncoder(path_a)
        self.encoder_a.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.encoder_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        pieces = self.encoder_a.library.get_vocab(with_added_tokens=True)
        spelt = [b""] * len(pieces)
        for piece, i in pieces.items():
            spelt[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self.a = Vocabulary(spelt, b",", b"|")
        pieces = [self.encoder_b.id_to_piece(i) for i in range(self.encoder_b.get_piece_size())]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.encoder_b.is_byte(i) else p.replace("▁", " ").encode()
                             for i, p in enumerate(pieces)], b",", b";")
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.pairs = len(self.a.spelt) * len(self.b.spelt)
        self.words: dict[str, bytes] = {}

    def _learn(self, words) -> None:
        """The second tokenizer's ids of the words that the memo does not know; none for a word that is spelt otherwise."""
        fresh = set(words).difference(self.words)
        if len(self.words) + len(fresh) > MEMO:
            self.words, fresh = {}, set(words)
        for word in fresh:
            ids = self.encoder_b.encode(word)
            good = b"".join(map(self.b.spelt.__getitem__, ids)) == (" " + word).encode()
            self.words[word] = array("I", ids).tobytes() if good else b""

    def _second(self, text: str, raw: bytes):
        if not self.by_word or _ADJACENT(text):
            ids = np.array(self.encoder_b.encode(text), np.int64)
            return ids if self.b.spells(ids, raw) else None
        words = text.split(" ")
        self._learn(words)
        found = list(map(self.words.__getitem__, words))
        return np.frombuffer(b"".join(found), np.uint32).astype(np.int64) if all(found) else None

    def align(self, text: str | None):
        """(ids a, ids b, index of each group's last token in a, in b), or None where the text has no tokens."""
        if not text:
            return None
        raw = (" " + text).encode()
        ids_b = self._second(text, raw)
        if ids_b is None:
            return None
        ids_a = np.frombuffer(self.encoder_a.encode(" " + text), self.encoder_a.dtype).astype(np.int64)
        if not self.a.spells(ids_a, raw):
            return None
        return ids_a, ids_b, *common_ends(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]))

    def written(self, ids_a, ids_b, last_a, last_b) -> bytes:
        """The groups in digits: ``a1,a2|b1;a3|b2,b3``."""
        out = np.empty(len(ids_a) + len(ids_b), object)
        # tokens of b in the groups before each token of a, and of a in the groups up to each token of b's
        before = np.repeat(np.concatenate([[0], last_b[:-1] + 1]), np.diff(last_a, prepend=-1))
        until = np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        out[np.arange(len(ids_a)) + before] = self.a.written(ids_a, last_a)
        out[np.arange(len(ids_b)) + until] = self.b.written(ids_b, last_b)
        return b"".join(out.tolist())[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_ALIGNED = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
            "groups_sha256": pa.string(), "groups": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
           "pairs binary, times binary")


def _align(path_a: str, path_b: str, keep_groups: bool):
    def align(batches):
        tool = aligner(path_a, path_b)
        code = "<u4" if tool.pairs < 1 << 32 else "<u8"
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                got = tool.align(text.as_py())
                if got is None:
                    rows.append((doc, 0, 0, 0, 0, "", "", b"", b""))
                    continue
                ids_a, ids_b, last_a, last_b = got
                written = tool.written(*got)
                pairs, times = np.unique(ids_a[last_a] * len(tool.b.spelt) + ids_b[last_b], return_counts=True)
                rows.append((doc, len(ids_a), len(ids_b), len(last_a), len(last_a), hashlib.sha256(written).hexdigest(),
                             written.decode() if keep_groups else None, pairs.astype(code).tobytes(),
                             times.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(_ALIGNED.items(), zip(*rows))}
                                             if rows else {k: pa.array([], t) for k, t in _ALIGNED.items()})
    return align


def _links(batch, code: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (pair, times) of a batch and how many each row has."""
    packed, times = batch["pairs"].to_pylist(), batch["times"].to_pylist()
    size = np.fromiter((len(t) // 4 for t in times), np.int64, len(times))
    return (np.frombuffer(b"".join(packed), code).astype(np.int64), np.frombuffer(b"".join(times), "<u4").astype(np.int64),
            size)


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return pairs, times
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    start = np.nonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))[0]
    return pairs[start], np.add.reduceat(times, start)


def _count(code: str):
    def rows(pairs, times):
        return pa.RecordBatch.from_pydict({"pair": pa.array(pairs, pa.int64()), "n": pa.array(times, pa.int64())})

    def count(batches):
        held, waiting, more = (np.empty(0, np.int64),) * 2, [], 0
        for batch in batches:
            pairs, times, _ = _links(batch, code)
            waiting.append((pairs, times))
            more += len(pairs)
            if more >= HELD:
                held = _summed(*(np.concatenate(x) for x in zip(held, *waiting)))
                waiting, more = [], 0
                if len(held[0]) >= HELD:
                    yield rows(*held)
                    held = (np.empty(0, np.int64),) * 2
        yield rows(*_summed(*(np.concatenate(x) for x in zip(held, *waiting))))
    return count


def _score(shared, code: str):
    """Rows -> (row, doc_id ..., n_best, count_sum) over the frequent pairs."""
    def score(batches):
        known, n, best = shared.value
        for batch in batches:
            pairs, times, size = _links(batch, code)
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1) if len(known) else np.zeros(len(pairs), int)
            here = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            row = np.repeat(np.arange(len(size)), size)[here]
            total, top = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(total, row, times[here] * n[at[here]])
            np.add.at(top, row, times[here] * best[at[here]])
            yield pa.RecordBatch.from_pydict({
                **{k: batch[k] for k in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")},
                "n_best": pa.array(top), "count_sum": pa.array(total)})
    return score


def _rare(shared, code: str):
    """Rows -> (row, pair, times) of the pairs that are not frequent."""
    def rare(batches):
        known = shared.value[0]
        for batch in batches:
            pairs, times, size = _links(batch, code)
            rest = known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] != pairs
            row = np.repeat(batch["row"].to_numpy(zero_copy_only=False), size)
            yield pa.RecordBatch.from_pydict({"row": pa.array(row[rest], pa.int64()), "pair": pa.array(pairs[rest]),
                                              "times": pa.array(times[rest])})
    return rare


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT,
          keep_groups: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (longs), groups_sha256 and, with
    ``keep_groups``, groups (strings)."""
    path_a, path_b = path_a or vocabulary_path(), path_b or vocabulary_path("piece_bpe_32k.model")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tool = aligner(path_a, path_b)
    code, width = "<u4" if tool.pairs < 1 << 32 else "<u8", len(tool.b.spelt)
    rows = keyed(docs, id_col, text_col).mapInArrow(_align(path_a, path_b, keep_groups), ALIGNED)
    rows, _ = stage(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = rows.select("pairs", "times").mapInArrow(_count(code), "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n"))
    counts, _ = stage(counts.withColumn("b", F.col("pair") % width), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))  # at most one row per id of b: bounded by its vocabulary
    counts, _ = stage(counts.join(F.broadcast(highest), "b").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")
    every = counts.count()
    top = counts if every <= frequent else counts.orderBy(F.col("n").desc(), "pair").limit(frequent)
    top = top.toArrow().sort_by("pair")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy(), top["n"].to_numpy(),
                                           top["best"].to_numpy().astype(np.int64)))
    scored = rows.mapInArrow(_score(shared, code), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                             "groups_sha256 string, groups string, n_best long, count_sum long")
    if every > frequent:
        rest = rows.select("row", "pairs", "times").mapInArrow(_rare(shared, code), "row long, pair long, times long")
        rest = rest.join(counts, "pair").groupBy("row").agg(
            F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        scored = scored.join(rest, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return scored.select(public_id(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                         *(["groups"] if keep_groups else []))
