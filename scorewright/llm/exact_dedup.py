"""Operator 5: exact de-duplication against a minimal perfect hash of historical digests.

The distinct SHA-256 digests of the historical rows are dealt into shards by
digest and each shard gets a minimal perfect hash by displacement: n digests,
n slots, one small seed for about three digests.  A slot holds the whole digest,
the winner's doc_id (its locator) and the historical count.  Incoming digests
are reduced to one row each before they are looked up, so a text that makes up
a third of the rows is one lookup.  A hash maps strangers to slots too: only a
slot whose 32 bytes equal the digest is a repeat, all others form groups of
their own.

Texts are equal when identical after each run of ASCII white space becomes one
space.  Null text counts as empty (an ordinary value, so empty documents are
copies of each other); a null id sorts after all others; of rows repeated under
one id only one stays; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import attach, keyed, public_id, release, stage

#: Distinct digests for which one hash is built, and digests to a displacement seed.
SHARD, LOAD = 8192, 3
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
HASH = "shard int, seeds binary, digests binary, winners binary, counts binary"


def normalised(text):
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _slot(words: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Slots of digests under their seeds; a negative seed names its slot."""
    moved = _mix(words + seeds.astype(np.uint64) * _MIX[0]) % np.uint64(n)
    return np.where(seeds < 0, -seeds - 1, moved.astype(np.int64))


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def build_hash(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, slot of each digest) of a minimal perfect hash over distinct digests."""
    n = len(digests)
    words = _words(digests)
    buckets = (words[:, 0] % np.uint64(-(-n // LOAD))).astype(np.int64)
    seeds = np.zeros(-(-n // LOAD), np.int64)
    slots = np.full(n, -1, np.int64)
    free = np.ones(n, bool)
    order = np.argsort(buckets, kind="stable")
    names, starts, sizes = np.unique(buckets[order], return_index=True, return_counts=True)
    singles = []
    for i in np.argsort(-sizes, kind="stable"):
        members = order[starts[i]:starts[i] + sizes[i]]
        if len(members) == 1:
            singles.append((names[i], members[0]))
            continue
        base = 1
        while True:
            tries = np.arange(base, base + 128, dtype=np.uint64)
            got = (_mix(words[members, 1][:, None] + tries * _MIX[0]) % np.uint64(n)).astype(np.int64)
            ok = free[got].all(axis=0)
            ok &= (np.diff(np.sort(got, axis=0), axis=0) > 0).all(axis=0)
            if ok.any():
                j = int(ok.argmax())
                seeds[names[i]], slots[members] = base + j, got[:, j]
                free[got[:, j]] = False
                break
            base += 128
    for (name, member), slot in zip(singles, np.flatnonzero(free)):
        seeds[name], slots[member] = -slot - 1, slot
    return seeds, slots


def _build(key, table):
    digests = table["digest"].to_pylist()
    seeds, slots = build_hash(digests)
    at = np.argsort(slots)
    column = lambda name: table[name].to_numpy()[at].astype("<i8").tobytes()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "seeds": [seeds.astype("<i8").tobytes()],
                     "digests": [b"".join(digests[i] for i in at)], "winners": [column("winner")],
                     "counts": [column("n")]})


def build_history(digests: DataFrame, name: str = "history") -> tuple[DataFrame, int, list[str]]:
    """Minimal perfect hashes (one row a shard) over the digests of (doc_id, digest) rows."""
    distinct, path = stage(digests.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("n")),
                           name + "-digests")
    shards = distinct.count() // SHARD + 1
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    table, kept = stage(distinct.withColumn("shard", shard).groupBy("shard").applyInArrow(_build, HASH), name)
    release(digests.sparkSession, path)
    return table, shards, [kept]


def _lookup(key, incoming, history):
    digests, winners = incoming["digest"].to_pylist(), incoming["winner"].to_numpy()
    counts = incoming["n"].to_numpy()
    out_digest, out_keep, out_n = [], [], []
    repeat = np.zeros(len(digests), bool)
    if history.num_rows:
        slots = history["digests"][0].as_py()
        seeds, keep, old = (np.frombuffer(history[c][0].as_py(), "<i8") for c in ("seeds", "winners", "counts"))
        total = old.copy()
        if digests:
            words = _words(digests)
            at = _slot(words[:, 1], seeds[(words[:, 0] % np.uint64(len(seeds))).astype(np.int64)], len(keep))
            repeat = np.array([slots[32 * s:32 * s + 32] == d for s, d in zip(at.tolist(), digests)], bool)
            total[at[repeat]] += counts[repeat]
        out_digest += [slots[i:i + 32] for i in range(0, len(slots), 32)]
        out_keep += keep.tolist()
        out_n += total.tolist()
    alone = np.flatnonzero(~repeat)
    out_digest += [digests[i] for i in alone]
    out_keep += winners[alone].tolist()
    out_n += counts[alone].tolist()
    return pa.table({"digest": pa.array(out_digest, pa.binary()), "keep_id": pa.array(out_keep, pa.int64()),
                     "group_size": pa.array(out_n, pa.int64())})


def exact_groups(digests: DataFrame, is_history) -> DataFrame:
    """(digest, keep_id, group_size) of all (doc_id, digest) rows; ``is_history`` tells the historical ones,
    whose ids must precede the others'."""
    history, shards, kept = build_history(digests.filter(is_history))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    incoming = (digests.filter(~is_history).groupBy("digest")
                .agg(F.min("doc_id").alias("winner"), F.count("*").alias("n")).withColumn("shard", shard))
    groups, _ = stage(incoming.groupBy("shard").cogroup(history.groupBy("shard")).applyInArrow(
        _lookup, "digest binary, keep_id long, group_size long"), "exact-groups")
    release(digests.sparkSession, *kept)
    return groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the row of its group that stays, the group's size, whether it stays itself.

    The rows up to the middle of the id range are the history, the others the incoming batch.
    Texts are read once; only 32-byte digests are shuffled.
    """
    rows = keyed(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2(normalised("text"), 256)).alias("digest"))
    digests, _ = stage(rows, "digests")
    low, high, total = digests.agg(F.min("doc_id"), F.max(F.nullif("doc_id", F.lit((1 << 63) - 1))), F.count("*")).first()
    middle = (low or 0) + ((high if high is not None else low or 0) - (low or 0)) // 2
    groups = exact_groups(digests, F.col("doc_id") <= middle)
    many = groups.filter(F.col("group_size") > 1)
    out = attach(digests, many, "digest", "group_size", total)
    keep = F.coalesce("keep_id", "doc_id")
    return out.select(public_id(), F.nullif(keep, F.lit((1 << 63) - 1)).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      (keep == F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
