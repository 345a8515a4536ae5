"""Operator 2: near-duplicates by improved consistent weighted sampling.

*Shingles* are runs of five lower-cased words; a shingle weighs (1 + ln tf) times
a damped inverse document frequency between 1 and 1.25, read off hashed counts
over all documents, so that a large family of near copies does not push its own
shingles under the threshold.  *Samples*: for each of ``BANDS x ROWS`` hash
functions every shingle draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) and the
shingle with the smallest ln c - r (t - beta + 1), t = floor(ln w / r + beta), is
the sample (shingle, t); two documents agree with the probability of their
weighted Jaccard similarity.  *Bands* of samples bring candidates together,
*verification* computes the weighted Jaccard similarity of whole texts.

Copies (equal shingled words) stand for one another before anything is paired.
A first round joins what is easily joined: in a band's bucket each document meets
the bucket's centre (most samples in common with the bucket's majority) and its
nearest other members; a bucket over ``LIMIT`` rows is first split by document and
the centres of the parts meet again, so no task ever holds a whole hot bucket.  The
second round verifies every other pair of a bucket whose samples give hope, but for
pairs that the first round has proven to be in one class; a bucket over ``LIMIT`` rows
is dealt into parts, a large class into parts of its own, and every part meets every
other part that is not of its own class.  Of these pairs only those are verified whose
similarity can reach the threshold at all: shingle weights added up in ``SKETCH`` cells by hash
give an upper bound of it (a sum of minima is at most the minimum of sums), so the bound loses
no link.  Verified links are joined to classes by
passing on the smallest number; members (the copies of one digest) are numbered, so rows
under one id or without any are told apart by their texts.

Texts of one to four words are one shingle; texts without words are classes of
their own; null text is a text without words; a null id sorts last; of rows under
one id the one with the smaller hash of its text comes first, and equal texts under one
id are one row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import attach, keyed, public_id, release, stage
from scorewright.llm.decontam import words_of
from scorewright.llm.superkmers import mix, word_hashes, word_places

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 12, 3
#: Buckets of hashed document frequencies, how much the rarest shingle gains, size of the variates' table.
FREQUENCIES, RARITY, VARIATES = 1 << 16, 0.25, 1 << 16
#: Rows of a bucket that one task compares at most, neighbours that a member is paired with, least estimate of a pair.
LIMIT, NEAREST, HOPE = 2000, 3, 0.55
#: Links of one document that one task verifies.
FAN = 200
#: Cells of a document's added weights, weight from which a cell is no bound, allowance for half-precision cells.
SKETCH, WIDE, SLACK = 128, 60_000.0, 0.005
#: Pairs of a document's shingles and hash functions that are sampled at once.
AT_ONCE = 1 << 14
_SALT = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _variates():
    rng = np.random.default_rng(11)
    r = rng.gamma(2.0, 1.0, VARIATES).astype(np.float32)
    return r, (1 / r).astype(np.float32), np.log(rng.gamma(2.0, 1.0, VARIATES)).astype(np.float32), rng.random(
        VARIATES, np.float32)


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = b" ".join(words)
    starts, ends = word_places(np.frombuffer(data, np.uint8))
    h = word_hashes(data, starts, ends)
    for i in np.flatnonzero(ends - starts > 16):  # the hash above reads 16 bytes at most
        h[i] = int.from_bytes(hashlib.blake2b(words[i], digest_size=8).digest(), "little")
    size = min(SHINGLE, len(h))
    out = h[:len(h) - size + 1].copy()
    for j in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - size + 1 + j]
    return np.unique(mix(out + np.uint64(size)), return_counts=True)


def weighted(h: np.ndarray, tf: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * rarity[(h >> np.uint64(48)).astype(np.int64)]


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least)) if len(common) else 0.0


def sample(h: np.ndarray, weights: np.ndarray, variates) -> np.ndarray:
    """The consistent weighted samples of one document, one 64-bit value per hash function."""
    r, inverse, log_c, beta = variates
    log_w = np.log(weights).astype(np.float32)
    out, level = np.empty(len(_SALT), np.uint64), np.empty(len(_SALT), np.int64)
    step = max(1, AT_ONCE // len(h))
    for start in range(0, len(_SALT), step):
        some = slice(start, start + step)
        at = ((h * _SALT[some, None]) >> np.uint64(48)).astype(np.int64)
        shift = beta[at]
        t = np.floor(log_w * inverse[at] + shift)
        best = (log_c[at] - r[at] * (t - shift + 1)).argmin(axis=1)
        out[some], level[some] = h[best], t[np.arange(len(at)), best]
    return mix((out + level.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ _SALT)


def sketch(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights added up by hash; cells of ``WIDE`` stand for any weight from there on."""
    cells = np.bincount((h >> np.uint64(40)).astype(np.int64) % SKETCH, weights, SKETCH)
    return np.minimum(cells, WIDE).astype(np.float16)


def can_reach(cells: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (i, j) of rows of ``cells`` may have a similarity of ``threshold``."""
    out = np.ones(len(i), bool)
    totals, wide = cells.sum(axis=1), (cells >= WIDE * 0.99).any(axis=1)
    for start in range(0, len(i), 8192):
        a, b = i[start:start + 8192], j[start:start + 8192]
        least = np.minimum(cells[a], cells[b]).sum(axis=1)
        out[start:start + 8192] = (least >= (threshold - SLACK) * (totals[a] + totals[b] - least)) | wide[a] | wide[b]
    return out


def rarities(rows: DataFrame) -> np.ndarray:
    """Damped inverse document frequency of each bucket of shingles, over all documents."""
    def count(batches):
        seen = np.zeros(FREQUENCIES, np.int64)
        for batch in batches:
            for text in batch["text"]:
                h, _ = shingles(words_of(text.as_py()))
                seen[np.unique((h >> np.uint64(48)).astype(np.int64))] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "n": pa.array(seen[some])})

    found = (rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket")
             .agg(F.sum("n").alias("n")).toPandas())
    total = max(2, rows.count())
    df = np.ones(FREQUENCIES)
    df[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return 1 + RARITY * np.log(total / np.minimum(df, total)) / np.log(total)


def signatures(rows: DataFrame, rarity) -> DataFrame:
    """doc_id, key, digest of the words (null without words), samples, added weights."""
    def sign(batches):
        variates = _variates()
        for batch in batches:
            digest, sig, cells = [], [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                digest.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                if words:
                    h, tf = shingles(words)
                    weights = weighted(h, tf, rarity.value)
                    sig.append(sample(h, weights, variates).tobytes())
                    cells.append(sketch(h, weights).tobytes())
                else:
                    sig.append(None)
                    cells.append(None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "key": batch["key"],
                                              "digest": pa.array(digest, pa.binary()), "sig": pa.array(sig, pa.binary()),
                                              "cells": pa.array(cells, pa.binary())})

    return rows.select("doc_id", "key", "text").mapInArrow(
        sign, "doc_id long, key long, digest binary, sig binary, cells binary")


def _bands(batches):
    """(band key, doc_id, short samples) rows: 32 bits of each sample are enough to estimate."""
    for batch in batches:
        if not batch.num_rows:
            continue
        full = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        short = pa.array([x.tobytes() for x in (full >> np.uint64(32)).astype("<u4")], pa.binary())
        for b in range(BANDS):
            key = np.full(len(full), b + 1, np.uint64)
            for c in full[:, b * ROWS:(b + 1) * ROWS].T:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
            yield pa.RecordBatch.from_pydict({"band": pa.array(key.view(np.int64)), "doc_id": batch["doc_id"], "sig": short})


def pairs_of(ids: np.ndarray, sigs: np.ndarray) -> tuple[set[tuple[int, int]], list[int]]:
    """Pairs to verify among the members of a bucket, and its centres.

    Everybody meets the centre; who is unlike it meets a centre of the rest; everybody
    also meets its nearest members of all."""
    n, width = sigs.shape
    order = np.argsort(ids)
    ids, sigs = ids[order], sigs[order]
    pairs: set[tuple[int, int]] = set()
    left, centres = np.ones(n, bool), []
    while left.any():
        members = np.flatnonzero(left)
        votes = np.zeros(len(members), np.int64)
        for c in range(width):
            values, inverse, counts = np.unique(sigs[members, c], return_inverse=True, return_counts=True)
            votes += counts[inverse] == counts.max()
        middle = int(members[votes.argmax()])
        alike = (sigs == sigs[middle]).mean(axis=1)
        near = np.flatnonzero(alike >= HOPE)
        pairs.update((min(middle, int(i)), max(middle, int(i))) for i in near if i != middle)
        left[near] = left[middle] = False
        if not centres or len(near) > 1:
            centres.append(int(ids[middle]))
        else:
            break  # strangers: nearest neighbours alone
    for start in range(0, n, 64):
        block = sigs[start:start + 64]
        alike = np.zeros((len(block), n), np.int16)
        for c in range(width):
            alike += block[:, c:c + 1] == sigs[:, c]
        alike[np.arange(len(block)), np.arange(start, start + len(block))] = -1
        best = np.argsort(-alike, axis=1, kind="stable")[:, :NEAREST]
        for i, others in enumerate(best):
            pairs.update((min(start + i, int(o)), max(start + i, int(o))) for o in others if alike[i, o] >= HOPE * width)
    return {(int(ids[a]), int(ids[b])) for a, b in pairs}, centres


def _meet(table):
    """One shuffle group holds many small buckets: the pairs of each, and the centres of hot ones or their parts."""
    band, part, split = table["band"].to_numpy(), table["part"].to_numpy(), table["split"].to_numpy()
    ids = table["doc_id"].to_numpy()
    sigs = table["sig"].to_pylist()
    order = np.lexsort((part, band))
    cuts = np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(part[order]) != 0)) + 1
    rows = []
    for group in np.split(order, cuts):
        if 1 < len(group) <= NEAREST + 1 and not split[group[0]]:  # everybody's nearest are all the others
            own = np.frombuffer(b"".join(sigs[i] for i in group), "<u4").reshape(len(group), -1)
            for x, y in combinations(range(len(group)), 2):
                if np.count_nonzero(own[x] == own[y]) >= HOPE * own.shape[1]:
                    a, b = sorted((int(ids[group[x]]), int(ids[group[y]])))
                    rows.append((a, b, None, None))
            continue
        if len(group) > 1:
            own = np.frombuffer(b"".join(sigs[i] for i in group), "<u4").reshape(len(group), -1)
            found, centres = pairs_of(ids[group], own)
            rows += [(a, b, None, None) for a, b in found]
        else:
            centres = [int(ids[group[0]])]
        if split[group[0]]:
            where = dict(zip(ids[group].tolist(), group.tolist()))
            rows += [(None, c, int(band[group[0]]), sigs[where[c]]) for c in centres]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)],
                    names=["a", "b", "band", "sig"])


def _near_centres(batches):
    """Members of hot buckets with those of their buckets' centres that they may resemble."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own, middle = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(batch.num_rows, -1)
                       for c in ("sig", "centre_sig"))
        a, b = batch["doc_id"].to_numpy(), batch["centre"].to_numpy()
        near = ((own == middle).mean(axis=1) >= HOPE) & (a != b)
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)[near]), "b": pa.array(np.maximum(a, b)[near])})


def candidates(signed: DataFrame) -> DataFrame:
    """Distinct (a, b) pairs that some band brought together, by the rules of ``pairs_of``.

    A bucket of more than ``LIMIT`` rows is dealt into parts by document; the parts' centres form the
    next, smaller bucket, until one part is left, and then all its members meet its centres."""
    spark = signed.sparkSession
    all_rows = rows = signed.select("doc_id", "sig").mapInArrow(_bands, "band long, doc_id long, sig binary")
    found, paths, level = None, [], 0
    while True:
        counts, path = stage(rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1" if not level else "n > 0"),
                             "band-counts")
        size, most = counts.agg(F.sum("n"), F.max("n")).first()
        hot = F.col("n") > LIMIT
        part = F.when(hot, F.pmod(F.xxhash64("doc_id", F.lit(level)), F.ceil(F.col("n") / LIMIT))).otherwise(F.lit(-1))
        groups = int((size or 0) // (2 * LIMIT)) + 1
        shuffle = F.pmod(F.xxhash64("band", "part"), F.lit(groups))
        met = (rows.join(counts, "band").withColumns({"part": part.cast("long"), "split": hot | F.lit(level > 0)})
               .withColumn("g", shuffle).repartition(groups, "g").groupBy("g").applyInArrow(_meet, "a long, b long, band long, sig binary"))
        met, path2 = stage(met, "band-pairs")
        paths += [path, path2]
        own = met.filter("a is not null").select("a", "b")
        found = own if found is None else found.unionByName(own)
        centres = met.filter("a is null").select("band", F.col("b").alias("doc_id"), "sig")
        if (most or 0) <= LIMIT:
            break
        rows, level = centres, level + 1
    if level:
        centres, path = stage(centres.select("band", F.col("doc_id").alias("centre"), F.col("sig").alias("centre_sig")),
                              "band-centres")
        paths.append(path)
        found = found.unionByName(all_rows.join(centres, "band").mapInArrow(_near_centres, "a long, b long"))
    pairs, _ = stage(found.distinct(), "near-pairs")
    release(spark, *paths)
    return pairs


def _places(batches):
    """(band key, doc_id, label) rows of (doc_id, label, sig) rows."""
    for batch in batches:
        label = batch["label"]
        for out in _bands([batch]):
            yield pa.RecordBatch.from_pydict({"band": out["band"], "doc_id": out["doc_id"], "label": label})


def _short(batches):
    """(doc_id, short samples, added weights)."""
    for batch in batches:
        full = (np.frombuffer(x, np.uint64) for x in batch["sig"].to_pylist())
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "sig": pa.array(
            [(x >> np.uint64(32)).astype("<u4").tobytes() for x in full], pa.binary()), "cells": batch["cells"]})


def _cross(table, threshold):
    """One shuffle group holds many blocks: all hopeful pairs of each block whose ends have different labels
    (and come from different sides, unless the block has but one, 2) and that can reach the threshold."""
    block = table["block"].combine_chunks().dictionary_encode()
    block = (block.combine_chunks() if isinstance(block, pa.ChunkedArray) else block).indices.to_numpy(zero_copy_only=False)
    ids, labels, side = (table[c].to_numpy() for c in ("doc_id", "label", "side"))
    sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(len(ids), -1)
    cells = np.frombuffer(b"".join(table["cells"].to_pylist()), np.float16).reshape(len(ids), -1)
    order = np.argsort(block, kind="stable")
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for group in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        own = cells[group].astype(np.float32)
        for start in range(0, len(group), 64):
            some = group[start:start + 64]
            alike = np.zeros((len(some), len(group)), np.int16)
            for c in range(sigs.shape[1]):
                alike += sigs[some, c][:, None] == sigs[group, c]
            alike[(labels[some][:, None] == labels[group]) | (ids[some][:, None] >= ids[group])] = 0
            alike[(side[some][:, None] == side[group]) & (side[group] != 2)] = 0
            i, j = np.nonzero(alike >= HOPE * sigs.shape[1])
            near = can_reach(own, i + start, j, threshold)
            i, j = i[near], j[near]
            left.append(ids[some[i]])
            right.append(ids[group[j]])
    return pa.table({"a": pa.array(np.concatenate(left)), "b": pa.array(np.concatenate(right))})


def blocks_of(places: DataFrame) -> DataFrame:
    """(block, side, doc_id, label): the rows of (band, doc_id, label, n) in blocks in which all pairs of a bucket meet.

    A bucket of at most ``LIMIT`` rows is a block.  The rows of a larger one are dealt into parts, each class of
    more than ``LIMIT`` into its own, and two parts make a block, but not two of one such class."""
    small = places.filter(F.col("n") <= LIMIT).select(F.col("band").cast("string").alias("block"), F.lit(2).alias("side"),
                                                      "doc_id", "label")
    hot = places.filter(F.col("n") > LIMIT)
    counts = hot.groupBy("band", "label").agg(F.count("*").alias("m"))
    own = F.when(F.col("m") > LIMIT, F.col("label"))
    large = counts.select("band", "label", own.alias("own")).filter("own is not null")
    parts = (counts.groupBy("band", own.alias("own")).agg(F.ceil(F.sum("m") / LIMIT).alias("parts"))
             .select("band", "own", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    one, two = (parts.select("band", F.col("own").alias(f"own{i}"), F.col("part").alias(f"part{i}"),
                             F.concat_ws(":", "own", "part").alias(f"name{i}")) for i in (1, 2))
    meet = one.join(two, "band").filter("name1 <= name2 AND NOT (own1 is not null AND own1 <=> own2)")
    block = F.concat_ws("|", "band", "name1", "name2").alias("block")
    both = F.expr("name1 = name2")
    sides = meet.select("band", block, F.col("name1").alias("name"), F.when(both, 2).otherwise(0).alias("side")).unionByName(
        meet.filter(~both).select("band", block, F.col("name2").alias("name"), F.lit(1).alias("side")))
    number = parts.groupBy("band", "own").agg(F.first("parts").alias("parts"))
    hot = (hot.join(F.broadcast(large), ["band", "label"], "left")
           .join(F.broadcast(number.withColumnsRenamed({"band": "band_", "own": "own_"})),
                 (F.col("band") == F.col("band_")) & F.col("own").eqNullSafe(F.col("own_"))))
    name = F.concat_ws(":", "own", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    hot = hot.select("band", name.alias("name"), "doc_id", "label").join(sides, ["band", "name"])
    return small.unionByName(hot.select("block", "side", "doc_id", "label"))


def remaining(signed: DataFrame, labels: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b) pairs of a bucket that may be near copies, are not in one class yet and not in ``tried``."""
    spark = signed.sparkSession
    label = F.coalesce("label", "doc_id").alias("label")
    labelled, path = stage(signed.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                           .select("doc_id", label, "sig", "cells"), "near-labelled")
    places = labelled.mapInArrow(_places, "band long, doc_id long, label long")
    mixed, path2 = stage(places.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"),
                                                    F.max("label").alias("high"))
                         .filter("low != high").select("band", "n"), "near-mixed")
    # one plan at every size: neither the buckets nor the samples are ever broadcast
    places, path3 = stage(places.join(mixed.hint("merge"), "band"), "near-places")
    blocks, path4 = stage(blocks_of(places), "near-blocks")
    rows = blocks.join(labelled.mapInArrow(_short, "doc_id long, sig binary, cells binary").hint("merge"), "doc_id")
    groups = blocks.count() // (2 * LIMIT) + 1

    def cross(table):
        return _cross(table, threshold)

    found = (rows.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups))).repartition(groups, "g").groupBy("g")
             .applyInArrow(cross, "a long, b long"))
    pairs, _ = stage(found.distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"), "near-remaining")
    release(spark, path, path2, path3, path4)
    return pairs


def verify(pairs: DataFrame, texts: DataFrame, members: DataFrame, rarity, threshold: float) -> DataFrame:
    """The pairs of ``members`` (node, rep, rep_key) whose weighted Jaccard similarity reaches ``threshold``.

    The end with more links is the hub.  Hubs are spread over parts of at most about ``FAN``
    links, so neither a task nor a text's copies grow with a hub's links."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    degree, path = stage(ends.groupBy("node").agg(F.count("*").alias("n")), "near-degrees")
    both = (pairs.join(degree.withColumnsRenamed({"node": "a", "n": "na"}), "a")
            .join(degree.withColumnsRenamed({"node": "b", "n": "nb"}), "b"))
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    parts = F.ceil(F.greatest("na", "nb") / FAN)
    links = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"),
                        F.when(first, F.col("b")).otherwise(F.col("a")).alias("leaf"),
                        F.pmod(F.xxhash64("a", "b"), parts).alias("part"))
    links, path2 = stage(links, "near-links")
    # one plan at every size: the paired documents grow with the input, so they are never broadcast
    needed, path4 = stage(members.join(degree.hint("merge"), "node").select(
        "node", F.col("rep").alias("doc_id"), F.col("rep_key").alias("key")), "near-needed")
    texts, path3 = stage(texts.join(needed.hint("merge"), ["doc_id", "key"]).groupBy("doc_id", "key").agg(
        F.min("node").alias("node"), F.min("text").alias("text")).select("node", "text"), "near-texts")
    leaves = links.join(texts.withColumnsRenamed({"node": "leaf", "text": "leaf_text"}), "leaf")
    hubs = links.select("hub", "part").distinct().join(
        texts.withColumnsRenamed({"node": "hub", "text": "hub_text"}), "hub")

    def compare(batches):
        name, vector = None, None
        for batch in batches:
            out = []
            for hub, leaf, hub_text, leaf_text in zip(batch["hub"].to_pylist(), batch["leaf"].to_pylist(),
                                                      batch["hub_text"], batch["leaf_text"]):
                if hub != name:
                    h, tf = shingles(words_of(hub_text.as_py()))
                    name, vector = hub, (h, weighted(h, tf, rarity.value))
                h, tf = shingles(words_of(leaf_text.as_py()))
                out.append(similarity(vector, (h, weighted(h, tf, rarity.value))))
            yield pa.RecordBatch.from_pydict({"a": batch["hub"], "b": batch["leaf"], "similarity": pa.array(out, pa.float64())})

    links = (leaves.join(hubs, ["hub", "part"]).select("hub", "leaf", "hub_text", "leaf_text")
             .mapInArrow(compare, "a long, b long, similarity double").filter(F.col("similarity") >= threshold))
    links, _ = stage(links, "near-verified")
    release(texts.sparkSession, path, path2, path3, path4)
    return links


def classes(links: DataFrame) -> DataFrame:
    """(node, label): each linked node with the smallest id of its class.

    Labels go to neighbours and then along the labels themselves, so long chains halve at each round;
    every round is written, so lineage stays short."""
    spark = links.sparkSession
    edges, edge_path = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "near-edges")
    labels, path = stage(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label"))
                         .withColumnRenamed("u", "node"), "near-labels")
    while True:
        heard = (edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("heard"))
                 .withColumnRenamed("u", "node"))
        lower = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"),
                                                      (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("moved"))
        new, new_path = stage(new, "near-labels")
        moved = new.filter("moved").limit(1).count()
        release(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not moved:
            release(spark, edge_path)
            return labels


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
               with_key: bool = False) -> DataFrame:
    """One row per document: its class (the smallest id in it), whether it is the one that stays, its copies.

    ``with_key`` adds the hash of its text, which tells rows under one id or without any apart."""
    rows = keyed(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    spark = rows.sparkSession
    rarity = spark.sparkContext.broadcast(rarities(rows))
    signed, path = stage(signatures(rows, rarity), "near-signatures")
    total = signed.count()
    members = signed.filter("digest is not null").groupBy("digest").agg(
        F.min(F.struct("doc_id", "key", "sig", "cells")).alias("m"), F.count("*").alias("n"))
    # written at once: the numbers do not change when a task runs again
    members, member_path = stage(members.select(
        F.monotonically_increasing_id().alias("node"), "digest", F.col("m.doc_id").alias("rep"),
        F.col("m.key").alias("rep_key"), F.col("m.sig").alias("sig"), F.col("m.cells").alias("cells"), "n"), "near-members")
    signatures_of = members.select(F.col("node").alias("doc_id"), "sig", "cells")
    pairs = candidates(signatures_of)
    links = verify(pairs, rows, members, rarity, threshold)
    labels = classes(links)
    more = verify(remaining(signatures_of, labels, pairs, threshold), rows, members, rarity, threshold)
    labels = classes(links.unionByName(more))
    reps = members.select("node", "digest", "rep", "rep_key", "n").join(labels, "node", "left")
    reps, rep_path = stage(reps.select("digest", F.coalesce("label", "node").alias("label"), "rep", "rep_key", "n"), "near-reps")
    first = reps.groupBy("label").agg(F.min(F.struct("rep", "rep_key")).alias("first"), F.count("*").alias("size"))
    first = first.select("label", F.col("first.rep").alias("class"), F.col("first.rep_key").alias("class_key"), "size")
    reps, _ = stage(attach(reps.select("digest", "label", "n"), first, "label", "size", total)
                    .select("digest", "class", "class_key", "n"), "near-classes")
    slim, _ = stage(signed.select("doc_id", "key", "digest"), "near-digests")
    release(spark, path, member_path, rep_path)
    out = attach(slim, reps, "digest", "n", total)
    own = F.coalesce("class", "doc_id")
    kept = (own == F.col("doc_id")) & (F.coalesce("class_key", "key") == F.col("key"))
    return out.select(public_id(), *(["key"] if with_key else []), F.nullif(own, F.lit((1 << 63) - 1)).alias("class_id"),
                      kept.alias("kept"), F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"))
