"""Operator 6: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ``window`` words (an item of fewer words
is one window).  For each pattern length a table gives, for the block of two
words at the search position, how far the search may move on: a block that ends
no pattern prefix skips nearly a whole window.  Where the shift is zero, the
block's bucket lists the patterns that end in it, and these are compared word
by word.  The documents are read once per block of patterns (``patterns_per_block``
of them at most are broadcast) and nothing is shuffled while one block is enough.

Null or wordless texts have no words and no hits; benchmark rows without words
are no patterns; a null item_id is an item named ''; repeated items count once;
each repeated document row gets its own result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import keyed, prepare, public_id

_KEEP = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80
              else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 0x20 for c in range(256))
HITS = "doc_id long, key long, n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: digits, ASCII letters and everything beyond ASCII."""
    return text.encode().translate(_KEEP).split()


class WuManber:
    """Shift and bucket tables of word patterns, one pair of tables per pattern length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.items = patterns
        self.tables = {}
        for m in sorted({len(p) for p in patterns}):
            size = min(2, m)
            shift: dict[tuple[bytes, ...], int] = {}
            bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
            for p in patterns:
                if len(p) != m:
                    continue
                for end in range(size, m + 1):
                    block = p[end - size:end]
                    shift[block] = min(shift.get(block, m), m - end)
                bucket.setdefault(p[m - size:], []).append(p)
            self.tables[m] = (size, m - size + 1, shift, bucket)

    def search(self, words: list[bytes]):
        """(start, end, pattern) of every occurrence."""
        for m, (size, most, shift, bucket) in self.tables.items():
            at, n = m, len(words)
            while at <= n:
                block = tuple(words[at - size:at])
                move = shift.get(block, most)
                if move:
                    at += move
                    continue
                start = at - m
                for p in bucket[block]:
                    if words[start] == p[0] and tuple(words[start:at]) == p:
                        yield start, at, p
                at += 1


def patterns_of(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(pattern, items): each distinct window, its words joined by spaces, with the items that hold it."""
    def cut(batches):
        for batch in batches:
            pattern, item = [], []
            for i, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(text)
                if words:
                    own = {b" ".join(words[s:s + window]) for s in range(max(1, len(words) - window + 1))}
                    pattern += own
                    item += [i] * len(own)
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(pattern, pa.binary()), "item": pa.array(item, pa.string())})

    prepare(benchmark.sparkSession)
    rows = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"),
                            F.coalesce(benchmark[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "pattern binary, item string").groupBy("pattern").agg(
        F.collect_set("item").alias("items"))


def _judged(occurrences) -> dict[str, list]:
    """Merge the occurrences of rows (doc, words, starts, ends, items) to word spans and judge them."""
    out: dict[str, list] = {k: [] for k in _JUDGED}
    for doc, n, starts, ends, items in occurrences:
        spans: list[list[int]] = []
        for s, e in sorted(zip(starts, ends)):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        hit = sum(e - s for s, e in spans)
        names = sorted(set(items))
        for k, v in zip(_JUDGED, (doc, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                                  hit > 0 and 20 * hit >= n, spans)):
            out[k].append(v)
    return out


_JUDGED = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(),
           "items_sha256": pa.string(), "contaminated": pa.bool_(), "spans": pa.list_(pa.list_(pa.int32()))}
RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "spans array<array<int>>")
_TYPES = {"doc_id": pa.int64(), "key": pa.int64(), "n_words": pa.int64(), "starts": pa.list_(pa.int32()),
          "ends": pa.list_(pa.int32()), "items": pa.list_(pa.string())}


def _searcher(rows: DataFrame, block: DataFrame, alone: bool):
    """A function over batches of rows that finds the occurrences of one bounded block of patterns;
    ``alone``: there is no other block, so the rows are judged at once."""
    found = {tuple(bytes(r["pattern"]).split()): r["items"] for r in block.collect()}
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def search(batches):
        machine = WuManber(shared.value)
        for batch in batches:
            out = []
            for doc, key, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "key", "text"))):
                words = words_of(text)
                got = list(machine.search(words))
                out.append((doc, key, len(words), [g[0] for g in got], [g[1] for g in got],
                            sorted({i for g in got for i in machine.items[g[2]]})))
            if alone:
                judged = _judged((d, n, s, e, i) for d, _, n, s, e, i in out)
                yield pa.RecordBatch.from_pydict({k: pa.array(judged[k], t) for k, t in _JUDGED.items()})
            else:
                yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(_TYPES.items(), zip(*out))})

    return search


def _judge(batches):
    for batch in batches:
        judged = _judged(zip(*(batch[c].to_pylist() for c in ("doc_id", "n_words", "starts", "ends", "items"))))
        yield pa.RecordBatch.from_pydict({k: pa.array(judged[k], t) for k, t in _JUDGED.items()})


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, patterns_per_block: int = 200_000,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, words inside benchmark windows, items met, the hit spans, contaminated or not."""
    rows = keyed(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    patterns = patterns_of(benchmark, window)
    blocks = patterns.count() // patterns_per_block + 1
    part = F.pmod(F.xxhash64("pattern"), F.lit(blocks))
    if blocks == 1:
        return rows.mapInArrow(_searcher(rows, patterns, True), RESULT).withColumn("doc_id", public_id())
    found = None
    for b in range(blocks):
        hits = rows.mapInArrow(_searcher(rows, patterns.filter(part == b), False), HITS)
        found = hits if found is None else found.unionByName(hits)
    # every row came once from each block of patterns: gather them, and give back rows repeated in the input
    found = found.groupBy("doc_id", "key", "n_words").agg(
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")), F.count("*").alias("_n"))
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("_n") / blocks).cast("int"))))
    return found.select("doc_id", "n_words", "starts", "ends", "items").mapInArrow(_judge, RESULT).withColumn(
        "doc_id", public_id())
