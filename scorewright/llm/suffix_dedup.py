"""Operator 9: repeated byte strings by the difference-cover suffix array.

A byte goes when a ``width``-byte string that covers it also starts anywhere
else.  One suffix array over all bytes of a corpus would shuffle tens of bytes
per byte and level, so equal strings are first brought together
(``superkmers``: byte windows, dealt by minimiser).  Whole packed strings that
repeat are settled by counting.  Inside a bucket, strings that share a minimiser
but differ are ordered by the difference-cover algorithm: sort the triples at
the positions not divisible by three, name them, recurse on the names until they
are distinct, order the remaining suffixes by their first byte and the rank of
the next, merge, and compare the first ``width`` bytes of neighbours.

Null text is empty; texts shorter than ``width`` lose nothing; rows repeated
under one id are other places, so their long strings go; a null id stays null;
other columns are ignored; matches never cross documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm import superkmers
from scorewright.llm.common import public_id
from scorewright.llm.superkmers import Windows, merged, runs, with_spans

#: Bytes of different strings that are ordered together.
CHUNK = 1 << 19


def _key(*columns: np.ndarray) -> np.ndarray | None:
    """The columns packed into one integer that sorts like them, if they fit."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 62:
        return None
    key = columns[0].astype(np.int64)
    for c, n in zip(columns[1:], bits[1:]):
        key = (key << n) | c
    return key


def _order(*columns: np.ndarray) -> np.ndarray:
    key = _key(*columns)
    return np.lexsort(columns[::-1]) if key is None else np.argsort(key)


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks (from 1) of the rows of some integer columns; equal rows get equal ranks."""
    order = _order(*columns)
    change = np.zeros(len(order), bool)
    for c in columns:
        own = c[order]
        change[1:] |= own[1:] != own[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(change) + 1
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (positive integers) in order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s, np.zeros(3, np.int64)))
    # sampled positions: 1 and 2 modulo 3 (one past the end stands for the empty suffix if it keeps the halves apart)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names = _names(t[sample], t[sample + 1], t[sample + 2])
    if names.max() < len(sample):
        order = suffix_array(names)
    else:
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    # the rest: first symbol, then the rank of the sampled suffix behind it
    rest = np.arange(0, n, 3)
    rest = rest[_order(t[rest], rank[rest + 1])]
    ordered = sample[order]
    ordered = ordered[ordered < n]
    # merge: how many sampled suffixes stand before each of the rest
    ahead = np.zeros(len(rest), np.int64)
    for residue, depth in ((1, 1), (2, 2)):
        other = ordered[ordered % 3 == residue]
        both = np.concatenate((rest, other))
        columns = (*(t[both + d] for d in range(depth)), rank[both + depth])
        key = _key(*columns)  # both parts are in this order already
        key = _names(*columns) if key is None else key
        ahead += np.searchsorted(key[len(rest):], key[:len(rest)])
    out = np.empty(n, np.int64)
    place = ahead + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = ordered
    return out


def repeated_starts(strings: list[bytes], width: int) -> list[np.ndarray]:
    """Per string: which of its ``width``-byte windows also start elsewhere in the strings."""
    data = b"".join(strings)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    # a closing symbol of its own behind each string, below all bytes: no common prefix reaches across
    text = np.insert(raw + len(strings) + 1, ends, np.arange(1, len(strings) + 1))
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    room = (ends + np.arange(len(strings)))[owner] - np.arange(len(text))  # bytes left in the string
    flag = np.zeros(len(text), bool)
    a, b = order[:-1], order[1:]
    fit = (room[a] >= width) & (room[b] >= width)
    a, b = a[fit], b[fit]
    for d in range(width):  # compare neighbours' prefixes; most part early
        same = text[a + d] == text[b + d]
        a, b = a[same], b[same]
        if not len(a):
            break
    flag[a] = flag[b] = True
    starts = np.concatenate(([0], (ends + np.arange(1, len(strings) + 1))[:-1]))
    return [flag[s:s + n - width + 1] for s, n in zip(starts.tolist(), sizes.tolist())]


def settle(string: bytes, entries: list[tuple], known: dict[bytes, int]):
    """Strings that repeat inside the task are repeats for certain; one witness goes on."""
    if string in known:
        return entries, [], 0
    if len(entries) > 1:
        if len(known) < superkmers.KNOWN:
            known[string] = 1
        return entries, entries[:1], 2
    return [], entries, 1


def judge(width: int):
    def spans_of(strings, mins, docs, keys, starts, copies):
        total: dict[bytes, int] = {}
        group: dict[int, set[bytes]] = {}
        for s, m, c in zip(strings, mins.tolist(), copies.tolist()):
            total[s] = total.get(s, 0) + c
            group.setdefault(m, set()).add(s)
        # groups of different strings among which one is not yet known to repeat as a whole
        flags: dict[bytes, np.ndarray] = {}
        chunk, size = [], 0
        open_groups = [sorted(g) for g in group.values() if len(g) > 1 and any(total[s] < 2 for s in g)]
        for i, g in enumerate(open_groups):
            chunk += g
            size += sum(map(len, g))
            if size >= CHUNK or i == len(open_groups) - 1:
                flags.update(zip(chunk, repeated_starts(chunk, width)))
                chunk, size = [], 0
        out = []
        for s, doc, key, start, c in zip(strings, docs.tolist(), keys.tolist(), starts.tolist(), copies.tolist()):
            if c > 1:
                continue  # the task that sent it has settled it
            if total[s] > 1:
                out.append((doc, key, start, start + len(s)))
            elif s in flags and flags[s].any():
                out += [(doc, key, start + a, start + b) for a, b in runs(flags[s], width)]
        return list(zip(*out)) or [[], [], [], []]

    return spans_of


def repeated_bytes(docs: DataFrame, width: int = 200, gram: int = 16, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per document: its number of bytes, the removed byte spans and the remaining bytes."""
    rows = superkmers.documents_with_key(docs, id_col, text_col)
    found = superkmers.spans(rows, Windows(False, width, gram), settle, judge(width), "byte-spans")

    def cut(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for text, starts, stops in zip(*(batch[c].to_pylist() for c in ("text", "starts", "stops"))):
                data = text.encode()
                n.append(len(data))
                removed.append(merged(starts or [], stops or []))
                at, left = 0, []
                for a, b in removed[-1]:
                    left.append(data[at:a])
                    at = b
                kept.append(b"".join(left) + data[at:])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n_bytes": pa.array(n, pa.int64()),
                "removed": pa.array(removed, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.binary())})

    return with_spans(rows, found).mapInArrow(
        cut, "doc_id long, n_bytes long, removed array<array<long>>, kept binary").withColumn("doc_id", public_id())


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                         F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
