"""Operator 10: packing documents into fixed windows by Karmarkar-Karp differencing.

A document's ids (with the end id) give full windows first; what is left is cut
into pieces of ``piece`` ids.  Each task collects ``block``
pieces and divides them among k = ceil(ids / window) windows: every piece starts
as a partial partition of its own, and the two partial partitions with the
largest imbalance are merged again and again, the fullest window of one with the
emptiest of the other.  If a window of the outcome is too full, k rises by one.
A block holds a bounded number of pieces whatever the input, and no row moves
between tasks.

Null text is an empty document (its end id alone is packed); null ids stay null;
rows repeated under one id are packed like different documents; other columns
are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scorewright.llm.common import keyed, public_id
from scorewright.llm.tokens import encoder, vocabulary_path

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: positions of ``lengths`` in k groups of near-equal sums."""
    # a partial partition: (-imbalance, number, negated sums from full to empty, members alike, missing ones are empty)
    heap = [(-n, i, [-n], [[i]]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    number = len(lengths)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        both = len(a) + len(b) - k  # so many of the emptier windows of a meet emptier windows of b
        if len(b) == 1:  # nearly always: a single piece finds its place among windows that stay in order
            total, pieces = b[0], other[0]
            if both > 0:
                total, pieces = a.pop() + total, own.pop() + pieces
            at = bisect_right(a, total)
            a.insert(at, total)
            own.insert(at, pieces)
            sums, members = a, own
        else:
            keep, start = len(a) - max(both, 0), len(b) - max(both, 0)
            sums = a[:keep] + [x + y for x, y in zip(a[keep:], b[start:][::-1])] + b[:start]
            members = own[:keep] + [x + y for x, y in zip(own[keep:], other[start:][::-1])] + other[:start]
            order = sorted(range(len(sums)), key=sums.__getitem__)
            sums, members = [sums[i] for i in order], [members[i] for i in order]
        least = -sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (least + sums[0], number, sums, members))
        number += 1
    return heap[0][3] if heap else []


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal groups of at most ``capacity``; one more group whenever one of them is too full."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        groups = difference(lengths, k)
        if all(sum(lengths[i] for i in g) <= capacity for g in groups):
            return groups
        k += 1


def cut(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's full windows, then of pieces of the rest; the last, of any size,
    is what lets the differencing even the windows out."""
    full = n // window * window
    return [(s, window) for s in range(0, full, window)] + [
        (s, min(piece, n - s)) for s in range(full, n, piece)]


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, window: int = 1024, piece: int = 256,
         block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit), its sequence and its place there."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        next_id = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []
        done: list[tuple] = []

        def settle():
            nonlocal next_id
            for group in windows([w[2] for w in waiting], window):
                offset = 0
                for i in group:
                    done.append((*waiting[i][:4], next_id, offset, waiting[i][4]))
                    offset += waiting[i][2]
                next_id += 1
            waiting.clear()

        def rows():
            table = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), [pa.int64()] * 6 + [pa.binary()])],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            done.clear()
            return table

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, enc.dtype).astype("<u4")
                for start, length in cut(len(ids), window, piece):
                    row = (doc_id.as_py(), start, length, len(ids), ids[start:start + length].tobytes())
                    if length == window:
                        done.append((*row[:4], next_id, 0, row[4]))
                        next_id += 1
                    else:
                        waiting.append(row)
                if len(waiting) >= block:
                    settle()
                if len(done) >= block:
                    yield rows()
        settle()
        if done:
            yield rows()

    return keyed(docs, id_col, text_col).mapInArrow(run, PIECES).withColumn("doc_id", public_id())
