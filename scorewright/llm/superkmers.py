"""Super-k-mer partitioning, for windows of words and for windows of bytes.

Every window of ``width`` tokens is represented by the smallest hash among its
``gram``-token pieces, its minimiser.  Equal windows have equal minimisers, so
all of them reach the same bucket.  Consecutive windows that share a minimiser
position travel as one packed string, which costs a few tokens a window instead
of ``width``.

*Hot content.*  Pieces that many documents hold come last in the order of
hashes, so a window picks one only if all its pieces are of that kind; the
windows at the border of a widespread passage, each different, thus do not meet
in one bucket.  (Which pieces these are is read off a bounded sample of
documents; it decides the balance of the buckets, never the result.)  A task
sends each distinct string of a flush once: what repeats inside the task is
settled there, so copies that fill a third of all rows reach a bucket once per
task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import keyed, stage

#: Documents in the sample that tells widespread pieces, the share of it that makes a piece one, most pieces kept.
SAMPLE, WIDESPREAD, MOST = 1000, 0.01, 100_000
#: Packed bytes that a bucket should hold, bytes of text a task packs at a time, strings a task remembers.
BUCKET, FLUSH, KNOWN = 8 << 20, 4 << 20, 100_000
SENT = "bucket int, packed binary, doc_id long, key long, start int, stop int"
SPANS = "doc_id long, key long, start int, stop int"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Windows:
    """``words``: tokens are words (else bytes); a window has ``width`` tokens, a piece ``gram``."""
    words: bool
    width: int
    gram: int


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(31))


def _loads(data: bytes) -> np.ndarray:
    """The eight bytes at each place of ``data`` (which ends in eight spare bytes) as an integer."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between single separators (space or line end)."""
    gap = np.flatnonzero((data == 0x20) | (data == 0x0A))
    starts = np.concatenate(([0], gap + 1))
    ends = np.concatenate((gap, [len(data)]))
    some = ends > starts
    return starts[some], ends[some]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's first and last eight bytes and its length (an order, not an identity)."""
    loads = _loads(data + bytes(8))
    size = ends - starts
    spare = ((8 - np.minimum(size, 8)) * 8).astype(np.uint64)
    first = loads[starts] << spare
    last = loads[np.maximum(ends - 8, starts)] << spare
    return mix(first * _A + last * _B + size.astype(np.uint64) * _C)


def piece_hashes(tokens: Windows, data: bytes, places) -> np.ndarray:
    """One hash per piece start (shorter than the tokens by ``gram`` - 1)."""
    if tokens.words:
        h = word_hashes(data, *places)
        out = h[:len(h) - tokens.gram + 1].copy()
        for j in range(1, tokens.gram):
            out = out * _A + h[j:len(h) - tokens.gram + 1 + j]
        return mix(out)
    loads = _loads(data + bytes(8))
    n = max(0, len(data) - tokens.gram + 1)
    return mix(loads[:n] * _A + loads[tokens.gram - 8:tokens.gram - 8 + n] * _B)


def _late(h: np.ndarray, widespread: np.ndarray) -> np.ndarray:
    """Widespread pieces after all others."""
    out = h >> np.uint64(1)
    if len(widespread):
        table = np.zeros(1 << 16, bool)
        table[(widespread >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(widespread, h[maybe]), len(widespread) - 1)
        out[maybe[widespread[at] == h[maybe]]] |= np.uint64(1 << 63)
    return out


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values."""
    size = 1
    while size * 2 <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:len(h) - (span - size)], h[span - size:]) if span > size else h


def pack(tokens: Windows, segments: list[bytes], widespread: np.ndarray):
    """Super-k-mers of ``segments``: (segment, first token, number of windows, minimiser, string), as lists.

    Segments are joined by line ends, which no window crosses."""
    data = b"\n".join(segments)
    flat = np.frombuffer(data, np.uint8)
    edges = np.cumsum([0] + [len(s) + 1 for s in segments])
    if tokens.words:
        starts, ends = word_places(flat)
        low = np.searchsorted(starts, edges[:-1])
        high = np.searchsorted(starts, edges[1:] - 1)
    else:
        starts = ends = None
        low, high = edges[:-1], edges[1:] - 1
    last = high - tokens.width + 1  # one past the last window of a segment
    some = np.flatnonzero(last > low)
    if not len(some):
        return [], [], [], [], []
    order = _late(piece_hashes(tokens, data, (starts, ends)), widespread)
    least = _least(order, tokens.width - tokens.gram + 1)
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (order[:len(least) - 1] == least[:-1])
    inside = np.zeros(len(least) + 1, np.int8)
    inside[low[some]] += 1
    np.subtract.at(inside, last[some], 1)
    fresh &= np.cumsum(inside[:-1]) > 0
    fresh[low[some]] = True
    begin = np.flatnonzero(fresh)
    owner = some[np.searchsorted(low[some], begin, side="right") - 1]
    stop = np.minimum(np.append(begin[1:], len(least)), last[owner])
    if tokens.words:
        left, right = starts[begin], ends[stop + tokens.width - 2]
    else:
        left, right = begin, stop + tokens.width - 1
    strings = [data[a:b] for a, b in zip(left.tolist(), right.tolist())]
    return (owner.tolist(), (begin - low[owner]).tolist(), (stop - begin).tolist(), least[begin], strings)


def segments_of(tokens: Windows, text: str, most: int) -> Iterator[tuple[int, bytes]]:
    """(first token, bytes) of overlapping segments of bounded length: every window lies in exactly one."""
    raw = text.encode()
    if tokens.words:
        words = raw.split()
        step = max(1, most // 8)
        for a in range(0, max(1, len(words) - tokens.width + 1), step):
            yield a, b" ".join(words[a:a + step + tokens.width - 1])
    else:
        for a in range(0, max(1, len(raw) - tokens.width + 1), most):
            yield a, raw[a:a + most + tokens.width - 1]


def _seal(mins, strings, docs, keys, starts, counts) -> bytes:
    """Rows for one bucket as a compressed block."""
    sizes = np.array([len(s) for s in strings], "<i4")
    head = np.array([len(strings)], "<i4")
    parts = [head.tobytes(), sizes.tobytes(), np.array(mins, "<u8").tobytes(), np.array(docs, "<i8").tobytes(),
             np.array(keys, "<i8").tobytes(), np.array(starts, "<i4").tobytes(), np.array(counts, "<i4").tobytes(),
             b"".join(strings)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unseal(block: bytes):
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int(np.frombuffer(raw, "<i4", 1)[0]), 4, []
    for kind in ("<i4", "<u8", "<i8", "<i8", "<i4", "<i4"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    ends = at + np.cumsum(out[0])
    starts = ends - out[0]
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], *out[1:]


def _widespread(rows: DataFrame, tokens: Windows, documents: int) -> np.ndarray:
    """Hashes of the pieces that many sampled documents hold, at most ``MOST`` of them."""
    def pieces(batches):
        for batch in batches:
            for text in batch["text"].to_pylist():
                for _, segment in segments_of(tokens, text, FLUSH):
                    places = word_places(np.frombuffer(segment, np.uint8)) if tokens.words else None
                    if places is None or len(places[0]) >= tokens.gram:
                        h = np.unique(piece_hashes(tokens, segment, places))
                        yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64))})

    every = max(1, documents // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    floor = max(3, int(WIDESPREAD * min(documents, SAMPLE)))
    found = (sample.mapInArrow(pieces, "h long").groupBy("h").count().filter(F.col("count") >= floor)
             .orderBy(F.desc("count"), "h").limit(MOST).select("h").collect())
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def spans(docs: DataFrame, tokens: Windows, settle: Callable, judge: Callable, name: str) -> DataFrame:
    """Repeated token spans (doc_id, key, start, stop) of ``docs`` (doc_id, key, text), staged.

    ``settle(string, entries, known)`` decides what a task can about one string's entries [(doc, key, start)]:
    (entries resolved as repeats, entries to send, copies that each stands for).  ``judge(rows)`` gives
    the spans of one bucket's rows (string, minimiser, doc, key, start, copies).
    """
    size, count = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    widespread = _widespread(docs, tokens, count)
    per_window = (2 * tokens.width + (tokens.width - tokens.gram) / 2) / (tokens.width - tokens.gram + 2)
    buckets = int((size or 0) * per_window // BUCKET) + 1

    def send(batches):
        known: dict[bytes, int] = {}
        labels, segments, held = [], [], 0

        def flush():
            owner, begin, windows, mins, strings = pack(tokens, segments, widespread)
            groups: dict[bytes, list] = {}
            least: dict[bytes, int] = {}
            extent = {}
            for o, b, w, m, s in zip(owner, begin, windows, mins.tolist() if len(strings) else [], strings):
                doc, key, offset = labels[o]
                groups.setdefault(s, []).append((doc, key, offset + b))
                least[s], extent[s] = m, w + tokens.width - 1
            resolved, by_bucket = [], {}
            for s, entries in groups.items():
                m = least[s]
                if len(entries) == 1 and s not in known:  # nothing to settle here
                    by_bucket.setdefault((m ^ (m >> 32)) % buckets, []).append((m, s, *entries[0], 1))
                    continue
                repeats, rest, copies = settle(s, entries, known)
                resolved += [(d, k, a, a + extent[s]) for d, k, a in repeats]
                for entry in rest:
                    by_bucket.setdefault((m ^ (m >> 32)) % buckets, []).append((m, s, *entry, copies))
            labels.clear()
            segments.clear()
            for bucket, out in by_bucket.items():
                yield bucket, _seal(*zip(*out)), None, None, None, None
            for d, k, a, b in resolved:
                yield d % buckets, None, d, k, a, b

        def batch_of(rows):
            types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                              names=["bucket", "packed", "doc_id", "key", "start", "stop"])

        for batch in batches:
            for doc, key, text in zip(*(batch[c] for c in ("doc_id", "key", "text"))):
                for offset, segment in segments_of(tokens, text.as_py(), FLUSH):
                    labels.append((doc.as_py(), key.as_py(), offset))
                    segments.append(segment)
                    held += len(segment)
                    if held >= FLUSH:
                        held = 0
                        if rows := list(flush()):
                            yield batch_of(rows)
        if segments and (rows := list(flush())):
            yield batch_of(rows)

    def receive(table):
        sealed = [unseal(b) for b in table["packed"].drop_null().to_pylist()]
        settled = table.filter(table["packed"].is_null()).select(["doc_id", "key", "start", "stop"])
        if not sealed:
            return settled
        strings = [s for part in sealed for s in part[0]]
        columns = [np.concatenate([part[i] for part in sealed]) for i in range(1, 6)]
        found = judge(strings, *columns)
        fresh = pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                         names=["doc_id", "key", "start", "stop"])
        return pa.concat_tables([settled, fresh])

    out, _ = stage(docs.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(receive, SPANS), name)
    return out


def runs(flags: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Token spans covered by the flagged windows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) + width - 1) for a, b in zip(edge[::2], edge[1::2])]


def merged(starts: list[int], stops: list[int]) -> list[list[int]]:
    """Spans as maximal disjoint runs in order (touching ones are one)."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def documents_with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): the key tells rows with one id and different texts apart."""
    return keyed(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the lists of their spans (null where there is none)."""
    lists = found.groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"),
                                               F.collect_list("stop").alias("stops"))
    return docs.join(lists, ["doc_id", "key"], "left")

