"""Operator 11: toxicity by a string-subsequence-kernel support vector machine on Nyström landmarks.

The kernel of two units (words, or letters written apart) counts their common
subsequences of three letters, each weighted by ``DECAY`` to the power of its
span in both, and is normalised; letters may stand apart by other characters or
inserted letters, so gapped insults stay close to plain ones.  Spans are at most
``SPAN`` letters long, units over ``WINDOW`` characters are taken in overlapping windows.
Kernel values with the landmarks, whitened by the landmarks' own kernel matrix
(Nyström), are a unit's features; a squared-hinge machine over them gives it a
score, and a sentence scores as its highest unit.

The machine learns from labelled sentences.  Which sentences make a document
toxic is not known, so they are chosen anew in each of ``ROUNDS`` rounds: of a toxic document the
highest sentence and further ones that already score as toxic, of a clean one the
sentences that come nearest to toxic, ``SENTENCES`` at most.  A document's score is a logistic function of its
``SENTENCES`` highest sentences, fitted on the training documents.

Landmarks are the units that tell toxic documents best by a likelihood ratio
beyond ``CHANCE``, units of clean documents that look like them, and frequent ones.  Training reads at most ``SAMPLE``
labelled rows, chosen by a hash of id and text among those with a label and not held out;
landmarks, sentences and the logistic function come from them alone.

Null and empty texts score as texts without a unit.  Rows without an id
are held out.  Several labels of one id are averaged, a tie is toxic; labels
that are null are none.  Where no unit tells (no training rows of both classes, or too few of them) every
score is the share of toxic ones among the training rows (0 if there are none).  Repeated rows and ids
score each; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import keyed, public_id, stage

#: Labelled rows used for training, rounds of choosing sentences, sentences that count of a document.
SAMPLE, ROUNDS, SENTENCES = 10_000, 5, 3
#: Landmarks: most telling units and the likelihood ratio they must exceed; clean units like them, out of so many frequent ones; frequent ones.
TELLING, CHANCE, ALIKE, OUT_OF, PLAIN = 128, 20.0, 32, 5000, 16
#: Letters a subsequence may span, weight per letter of span, characters of a window.
SPAN, DECAY, WINDOW = 7, 0.8, 24
#: Penalty of the machine's errors, least eigenvalue in whitening.
COST, LEAST = 10.0, 0.01
#: Units whose scores a worker remembers; words handled at a time.
MEMO, PIECE = 300_000, 20_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS, _NONE = 32, 0
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+").split
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


@cache
def _kind_table() -> np.ndarray:
    """The kind of each character below U+0250: 1-26 for letters by their base letter, 27-31 other letters, 0 none."""
    out = np.zeros(0x250, np.int64)
    for c in range(len(out)):
        base = unicodedata.normalize("NFKD", chr(c).lower())[0]
        out[c] = ord(base) - 96 if "a" <= base <= "z" else 27 + c % 5 if base.isalpha() else _NONE
    return out


def _kinds(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    table = _kind_table()
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 27 + points % 5)


def windows_of(units: list[str]):
    """(owner, windows of one length): letter kinds of the units without the marks around them, long ones in overlapping
    windows; units of fewer than three letters have none."""
    kinds = _kinds("".join(units))
    owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
    at = np.nonzero(kinds)[0]
    first = np.nonzero(np.concatenate([[True], np.diff(owner[at]) != 0]))[0] if len(at) else at
    letters = np.diff(first, append=len(at))
    first, last = first[letters >= 3], (first + letters - 1)[letters >= 3]
    start, length, unit = at[first], at[last] - at[first] + 1, owner[at[first]]
    step = WINDOW // 2
    long = np.nonzero(length > WINDOW)[0]
    more = [(start[i] + lo, min(WINDOW, length[i] - lo), unit[i]) for i in long.tolist() for lo in range(0, length[i] - step, step)]
    keep = length <= WINDOW
    start, length, unit = (np.concatenate([x[keep], [m[k] for m in more]]).astype(np.int64)
                           for k, x in enumerate((start, length, unit)))
    for n in np.unique(length).tolist():
        own = np.nonzero(length == n)[0]
        yield unit[own], kinds[start[own][:, None] + np.arange(n)]


@cache
def _triples(n: int) -> np.ndarray:
    """Positions (i, j, k) of all subsequences of three in ``n`` letters, and their spans less 3."""
    found = [(i, j, k, k - i - 2) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    return np.array(found, np.int64).reshape(-1, 4).T


def subsequences(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, code, weight) of windows of one length, each code of a window once; windows have norm 1."""
    one, two, three, span = _triples(windows.shape[1])
    one, two, three = (windows[:, at] for at in (one, two, three))
    key = (((np.arange(len(windows))[:, None] * _KINDS + one) * _KINDS + two) * _KINDS + three) * 8 + span
    key = np.sort(key[(one > 0) & (two > 0) & (three > 0)])  # the span in the last bits carries the weight
    value, key = (DECAY ** np.arange(3, 11.0))[key & 7], key >> 3
    if not len(key):
        return key, key, value
    start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    key, value = key[start], np.add.reduceat(value, start)
    row = key // _KINDS ** 3
    norm = np.sqrt(np.bincount(row, value * value, len(windows)))
    return row, key % _KINDS ** 3, value / norm[row]


def _by_length(units: list[str]):
    """(owner, windows, their subsequences) of the units' windows, some of one length at a time."""
    for owner, windows in windows_of(units):
        step = max(1, 100_000 // max(1, _triples(windows.shape[1]).shape[1]))
        for lo in range(0, len(windows), step):
            yield owner[lo:lo + step], windows[lo:lo + step], subsequences(windows[lo:lo + step])


class Kernel:
    """The kernel between units and the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.m = len(landmarks)
        self.table = np.zeros((_KINDS ** 3, self.m), np.float32)
        for owner, _, (row, code, value) in _by_length(landmarks):
            self.table[code, owner[row]] = value

    def compute(self, units: list[str], weights: np.ndarray | None = None) -> np.ndarray:
        """Kernel values of the units: of a long one's windows that of the highest weight."""
        out = np.zeros((len(units), self.m), np.float32)
        best = np.full(len(units), -np.inf)
        for owner, windows, (row, code, value) in _by_length(units):
            step = max(1, 4_000_000 // (self.m + 1))
            found = np.zeros((len(windows), self.m), np.float32)
            for lo in range(0, len(row), step):
                np.add.at(found, row[lo:lo + step], self.table[code[lo:lo + step]] * value[lo:lo + step, None].astype(np.float32))
            weight = found @ weights if weights is not None else found.sum(1)
            for w in np.argsort(weight, kind="stable"):
                if weight[w] > best[owner[w]]:
                    best[owner[w]], out[owner[w]] = weight[w], found[w]
        return out

    def weigher(self, weights: np.ndarray) -> np.ndarray:
        """The weight of each subsequence: scores of units are sums over their subsequences."""
        return self.table.astype(np.float64) @ weights


def scores_of(units: list[str], weigher: np.ndarray) -> np.ndarray:
    """Scores: the highest of a unit's windows, 0 without any."""
    out = np.full(len(units), -np.inf)
    for owner, windows, (row, code, value) in _by_length(units):
        np.maximum.at(out, owner, np.bincount(row, weigher[code] * value, len(windows)))
    return np.where(np.isinf(out), 0.0, out)


def sentences_of(text: str):
    """Lists of units; none of them is empty."""
    for sentence in _SENTENCE(text.lower()):
        units = sentence.split()
        if units:
            yield units + [m[0].replace(" ", "").replace("\t", "") for m in _SPACED.finditer(sentence)]


class Scorer:
    """Unit scores, remembered, and the highest sentences of documents."""

    def __init__(self, landmarks, weights: np.ndarray):
        self.weigher, self.known = Kernel(list(landmarks)).weigher(weights), {}

    def units(self, units: list[str]) -> np.ndarray:
        fresh = list(set(units).difference(self.known))
        if len(self.known) + len(fresh) > MEMO:
            self.known, fresh = {}, list(set(units))
        if fresh:
            self.known.update(zip(fresh, scores_of(fresh, self.weigher).tolist()))
        return np.fromiter(map(self.known.__getitem__, units), np.float64, len(units))

    def _pieces(self, texts, named: bool):
        """(document, score, highest unit if ``named``) of sentences, some at a time."""
        owner, start, units = [], [], []

        def flush():
            score, at = self.units(units), np.array(start)
            best = np.maximum.reduceat(score, at)
            if not named:
                return np.array(owner), best, None
            hit = np.nonzero(score == np.repeat(best, np.diff(at, append=len(score))))[0]
            first = hit[np.searchsorted(hit, at)]
            return np.array(owner), best, [units[i] for i in first.tolist()]

        for doc, text in enumerate(texts):
            for sentence in sentences_of(text):
                for lo in range(0, len(sentence), PIECE):  # a sentence without end is taken in parts
                    owner.append(doc)
                    start.append(len(units))
                    units += sentence[lo:lo + PIECE]
                if len(units) >= PIECE:
                    yield flush()
                    owner, start, units = [], [], []
        if units:
            yield flush()

    def highest(self, texts, named: bool = False) -> list[list[tuple[float, str]]]:
        """Per document its ``SENTENCES`` highest sentences: score and highest unit (empty unless ``named``), falling."""
        out: list[list] = [[] for _ in texts]
        for owner, score, unit in self._pieces(texts, named):
            order = np.lexsort((-score, owner))
            start = np.nonzero(np.concatenate([[True], np.diff(owner[order]) != 0]))[0]
            rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
            for i in order[rank < SENTENCES].tolist():
                out[owner[i]].append((float(score[i]), unit[i] if named else ""))
        return [sorted(found, key=lambda x: (-x[0], x[1]))[:SENTENCES] for found in out]


_SCORERS: dict[bytes, Scorer] = {}


def scorer_of(landmarks: tuple[str, ...], weights: np.ndarray) -> Scorer:
    """One scorer per Python worker."""
    key = repr(landmarks).encode() + weights.tobytes()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(landmarks, weights)
    return _SCORERS[key]


def _contexts(batches):
    """Rows (doc, text, toxic) -> (unit, around, doc, toxic): units of three letters or more and a hash of the words around them."""
    for batch in batches:
        unit, around, doc, toxic = [], [], [], []
        for own, text, label in zip(*(batch[c].to_pylist() for c in ("doc", "text", "toxic"))):
            met = set()
            for words in sentences_of(text):
                words = [w.strip(_MARKS) for w in words]
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    if 3 <= len(word) <= WINDOW and (context := (word, zlib.crc32(f"{before} {after}".encode()))) not in met:
                        met.add(context)
            unit += [m[0] for m in met]
            around += [m[1] for m in met]
            doc += [own] * len(met)
            toxic += [label] * len(met)
        yield pa.RecordBatch.from_pydict({"unit": pa.array(unit, pa.string()), "around": pa.array(around, pa.int64()),
                                          "doc": pa.array(doc, pa.int64()), "toxic": pa.array(toxic, pa.int32())})


def landmarks_of(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """The landmarks and how well each tells toxic documents (0 for those of clean text).

    A context that several documents share counts for one of them, and a unit once per document: neither
    copies nor one long document make a unit tell.
    """
    once = sample.mapInArrow(_contexts, "unit string, around long, doc long, toxic int").groupBy("unit", "around").agg(
        F.min(F.struct("doc", "toxic")).alias("one"))
    units = once.select("unit", "one.doc", "one.toxic").distinct().groupBy("unit").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    units, _ = stage(units, "units")
    share, n = F.lit(sample.agg(F.avg("toxic").alias("share")).first()["share"]), F.col("a") + F.col("b")
    ratio = 2 * (F.col("a") * F.log(F.col("a") / (n * share)) +
                 F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - share)))).otherwise(0.0))
    told = units.filter(F.col("a") > n * share).select("unit", ratio.alias("ratio")).filter(F.col("ratio") > CHANCE).orderBy(
        F.col("ratio").desc(), "unit").limit(TELLING).collect()
    usual = units.filter(F.col("b") > 0).orderBy(F.col("b").desc(), "unit").limit(OUT_OF).collect()
    telling = [r["unit"] for r in told]
    usual = [(r["unit"], r["b"]) for r in usual if r["unit"] not in set(telling)]
    if not telling or not usual:
        return [], np.zeros(0)
    near = Kernel(telling).compute([u for u, _ in usual]).max(1) * np.log1p([b for _, b in usual])
    alike = [usual[i][0] for i in np.argsort(-near, kind="stable")[:ALIKE]]
    plain = [u for u, _ in usual if u not in set(alike)][:PLAIN]
    told = np.array([r["ratio"] for r in told]) / told[0]["ratio"]
    return telling + alike + plain, np.concatenate([told, np.zeros(len(alike) + len(plain))])


def _whitening(landmarks: list[str]) -> np.ndarray:
    """Inverse square root of the landmarks' kernel matrix."""
    own = Kernel(landmarks).compute(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    return vectors / np.sqrt(np.maximum(values, LEAST)) @ vectors.T


def support_vector_machine(x: np.ndarray, y: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights (the last a bias, not punished) of the squared-hinge machine, by Newton's method; ``y`` is ±1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([*np.ones(x.shape[1] - 1), 1e-6])
    w = np.zeros(x.shape[1])

    def loss(v):
        return v @ ridge @ v / 2 + cost * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    for _ in range(50):
        slack = np.maximum(0, 1 - y * (x @ w))
        gradient = ridge @ w - 2 * cost * x.T @ (y * slack)
        inside = x[slack > 0]
        step = np.linalg.solve(ridge + 2 * cost * inside.T @ inside, gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(gradient).max() < 1e-6 * max(1, len(y)):
            break
    return w


def logistic(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights (the last an offset) of the chance of a label given the scores, with smoothed targets."""
    n = toxic.sum()
    target = np.where(toxic > 0, (n + 1) / (n + 2), 1 / (len(toxic) - n + 2))
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(w)), z.T @ (p - target) + 0.01 * w)
        w = w - step / max(1.0, np.abs(step).max())
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc, text, toxic): a bounded sample of the labelled rows that are not held out."""
    told = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.avg("toxic") >= 0.5).cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    hashed = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    chosen, _ = stage(hashed.select("doc_id", "h").join(told, "doc_id").dropDuplicates(["doc_id", "h"]).orderBy(
        "h", "doc_id").limit(sample), "toxicity-sample")  # at most ``sample`` rows: safe to broadcast
    return hashed.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select(
        F.xxhash64("doc_id", "h").alias("doc"), "text", "toxic")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


class Model:
    """What training finds: landmarks, weights of the kernel values, the logistic function, and the score of a
    usual sentence, which stands for those that a short text does not have."""

    def __init__(self, landmarks=(), weights=None, chance=None, usual=0.0, share=0.0):
        self.landmarks, self.weights, self.chance = tuple(landmarks), weights, chance
        self.usual, self.share = usual, share

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(texts), self.share)
        x = _padded(scorer_of(self.landmarks, self.weights).highest(texts), self.usual)
        return 1 / (1 + np.exp(-np.clip(x @ self.chance[:-1] + self.chance[-1], -500, 500)))


def _padded(found, usual: float) -> np.ndarray:
    return np.array([[s for s, _ in f] + [usual] * (SENTENCES - len(f)) for f in found]).reshape(-1, SENTENCES)


def _witnesses(landmarks: tuple, weights: np.ndarray):
    def witnesses(batches):
        for batch in batches:
            found = scorer_of(landmarks, weights).highest(batch["text"].to_pylist(), named=True) if batch.num_rows else []
            yield pa.RecordBatch.from_pydict({
                "toxic": batch["toxic"], "scores": pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())),
                "units": pa.array([[u for _, u in f] for f in found], pa.list_(pa.string()))})
    return witnesses


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """``docs`` (doc_id, text without nulls), ``labels`` (doc_id, toxic)."""
    rows, _ = stage(training_rows(docs, labels, sample), "toxicity-texts")
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = seen.get(1, 0) / max(1, sum(seen.values()))
    landmarks, weights = landmarks_of(rows) if len(seen) == 2 else ([], None)
    if not landmarks:
        return Model(share=share)
    kernel, whitening, edge = Kernel(landmarks), _whitening(landmarks), np.inf
    for _ in range(rounds):  # at most SENTENCES units of each of at most ``sample`` rows come to the driver
        found = rows.mapInArrow(_witnesses(tuple(landmarks), weights), "toxic int, scores array<double>, units array<string>").collect()
        found.sort(key=lambda r: (r["toxic"], r["units"], r["scores"]))  # the order of tasks must not matter
        chosen = [(r["toxic"], u) for r in found for k, (s, u) in enumerate(zip(r["scores"], r["units"]))
                  if k == 0 or not r["toxic"] or s > edge]
        number = {u: i for i, u in enumerate(dict.fromkeys(u for _, u in chosen))}
        x = (kernel.compute(list(number), weights).astype(np.float64) @ whitening)[[number[u] for _, u in chosen]]
        w = support_vector_machine(x, np.where(np.array([t for t, _ in chosen]) > 0, 1.0, -1.0))
        weights, edge = whitening @ w[:-1], -w[-1]
    last = rows.mapInArrow(_witnesses(tuple(landmarks), weights), "toxic int, scores array<double>, units array<string>").collect()
    last.sort(key=lambda r: (r["toxic"], r["units"], r["scores"]))
    plain = [r["scores"][-1] for r in last if r["scores"] and not r["toxic"]]
    usual = float(np.median(plain)) if plain else 0.0
    x = _padded([list(zip(r["scores"], r["units"])) for r in last], usual)
    return Model(landmarks, weights, logistic(x, np.array([r["toxic"] for r in last])), usual, share)


def _scorer(model: Model):
    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(
                model.scores(batch["text"].to_pylist()) if batch.num_rows else [], pa.float64())})
    return score


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (0 or 1)."""
    rows = keyed(docs, id_col, text_col)
    model = train(rows, labels.select("doc_id", "toxic"), sample)
    return rows.mapInArrow(_scorer(model), "doc_id long, score double").select(
        public_id(), held_out(public_id()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
