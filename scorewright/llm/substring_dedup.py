"""Operator 7: repeated word windows by super-k-mer partitioning (``superkmers``).

A word goes when a window of ``width`` words that covers it also starts in a
document with a smaller doc_id; all windows are judged on the input.  In its
bucket each distinct packed string counts once, with the smallest doc_id that
holds it; its windows are sorted by hash, and windows of equal hash are compared
as strings, so the counts are exact.

Null text has no words; texts of fewer than ``width`` words lose none; rows
repeated under one id are not smaller than each other and keep the same words; a
null id sorts after all others; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm import superkmers
from scorewright.llm.common import public_id
from scorewright.llm.superkmers import Windows, merged, runs, with_spans


def settle(string: bytes, entries: list[tuple], known: dict[bytes, int]):
    """Of equal strings in one task only the smallest document's can be the first."""
    least = min(e[0] for e in entries)
    before = known.get(string)
    if len(entries) > 1 and before is None and len(known) < superkmers.KNOWN or before is not None and least < before:
        known[string] = least
    first = least if before is None else min(least, before)
    return [e for e in entries if e[0] > first], [e for e in entries if e[0] == first], 1


def first_holders(strings: list[bytes], least: np.ndarray, width: int):
    """For each distinct string, the smallest document that holds each of its windows (as one flat array),
    and where each string's windows begin in it.  ``least``: the smallest document of each string."""
    data = b"\n".join(strings)
    starts, ends = superkmers.word_places(np.frombuffer(data, np.uint8))
    edges = np.cumsum([0] + [len(s) + 1 for s in strings])
    low = np.searchsorted(starts, edges[:-1])
    words = np.diff(np.append(low, len(starts)))
    windows = words - width + 1
    begin = np.concatenate(([0], np.cumsum(windows)))
    owner = np.repeat(np.arange(len(strings)), windows)
    at = np.arange(begin[-1]) - begin[owner] + low[owner]
    h = superkmers.word_hashes(data, starts, ends)
    whole = np.zeros(len(at), np.uint64)
    for j in range(width):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + h[at + j]
    first = least[owner]
    order = np.argsort(whole, kind="stable")
    equal = whole[order][1:] == whole[order][:-1]
    del whole, h
    left, right = starts[at], ends[at + width - 1]
    sure = equal.copy()
    sure[equal] = same_bytes(data, left, right, order[:-1][equal], order[1:][equal])
    if (sure == equal).all():
        # runs of one window each: the smallest holder goes to all its places
        run = np.concatenate(([True], ~equal)) if len(order) else np.zeros(0, bool)
        places = np.flatnonzero(run)
        if len(places):
            low = np.minimum.reduceat(first[order], places)
            first[order] = low[np.cumsum(run) - 1]
    else:  # two windows share a hash: group by the windows themselves
        smallest: dict[bytes, int] = {}
        texts = [data[a:b] for a, b in zip(left.tolist(), right.tolist())]
        for t, d in zip(texts, first.tolist()):
            smallest[t] = min(smallest.get(t, d), d)
        first = np.array([smallest[t] for t in texts], np.int64)
    return first, begin


def same_bytes(data: bytes, left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the stretches left..right number a[i] and b[i] of ``data`` are equal, eight bytes at a time."""
    loads = superkmers._loads(data + bytes(8))
    size = right[a] - left[a]
    same = size == right[b] - left[b]
    open_ = np.flatnonzero(same)
    done = 0
    while len(open_):
        rest = size[open_] - done
        spare = ((8 - np.minimum(rest, 8)) * 8).astype(np.uint64)
        alike = (loads[left[a[open_]] + done] << spare) == (loads[left[b[open_]] + done] << spare)
        same[open_[~alike]] = False
        open_ = open_[alike & (rest > 8)]
        done += 8
    return same


def judge(width: int):
    def spans_of(strings, mins, docs, keys, starts, copies):
        names: dict[bytes, int] = {}
        which = np.array([names.setdefault(s, len(names)) for s in strings], np.int64)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, which, docs)
        first, begin = first_holders(list(names), least, width)
        windows = np.diff(begin)
        # larger documents than a string's smallest lose all of it, the smallest itself what others held before
        late = np.flatnonzero(docs > least[which])
        out = [docs[late], keys[late], starts[late], starts[late] + windows[which[late]] + width - 1]
        older = first < np.repeat(least, windows)
        some = np.logical_or.reduceat(older, begin[:-1]) if len(older) else np.zeros(len(names), bool)
        rows = []
        for i in np.flatnonzero((docs == least[which]) & some[which]).tolist():
            w = which[i]
            rows += [(docs[i], keys[i], starts[i] + a, starts[i] + b) for a, b in runs(older[begin[w]:begin[w + 1]], width)]
        return [np.concatenate((c, np.array(r, np.int64))) for c, r in zip(out, zip(*rows) if rows else [[]] * 4)]

    return spans_of


def repeated_words(docs: DataFrame, width: int = 13, gram: int = 3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per document: its number of words, the removed word spans and the kept words joined by one space."""
    rows = superkmers.documents_with_key(docs, id_col, text_col)
    found = superkmers.spans(rows, Windows(True, width, gram), settle, judge(width), "word-spans")

    def cut(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for text, starts, stops in zip(*(batch[c].to_pylist() for c in ("text", "starts", "stops"))):
                words = text.encode().split()
                n.append(len(words))
                removed.append(merged(starts or [], stops or []))
                at, left = 0, []
                for a, b in removed[-1]:
                    left += words[at:a]
                    at = b
                kept.append((b" ".join(left + words[at:])).decode())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n_words": pa.array(n, pa.int64()),
                "removed": pa.array(removed, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.string())})

    return with_spans(rows, found).mapInArrow(
        cut, "doc_id long, n_words long, removed array<array<long>>, kept string").withColumn("doc_id", public_id())


def digest(result: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return result.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
