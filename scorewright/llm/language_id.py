"""Operator 3: language identification with error-correcting output codes.

Each language gets a codeword; for every bit a classifier over hashed byte
n-grams tells the languages with a 1 from those with a 0 (mean log-odds of a
text's n-grams, each language weighing the same).  The n-gram counts come from
all training rows; a bounded sample of them calibrates each bit and measures its
error.  Decoding adds up each bit's logistic loss, weighted by how far the bit
does better than chance, and takes the nearest codeword; the share of the second
nearest flags ambiguous texts.

Null texts and texts without a letter are ``und`` with score 0; so is everything
when nothing could be learned.  Rows without a language are no training rows.
Repeated rows count each; other columns, and clashing names, are never read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import keyed, public_id

#: Hashed n-grams, their lengths in bytes, rows of the calibration sample, most languages told apart.
FEATURES, LENGTHS, CALIBRATION, MOST_LANGUAGES = 1 << 14, (2, 3), 4000, 500
#: Bytes of one text that are turned into n-grams at a time.
PIECE = 1 << 20


def codewords(k: int) -> np.ndarray:
    """A codeword of ±1 per language: all ways to part up to six languages, else fixed random ones."""
    if k <= 6:
        bits = [(1, *rest) for rest in itertools.product((1, 0), repeat=k - 1) if not all(rest)]
        return np.array(bits or [(1,) * k], np.int8).T * 2 - 1
    rng = np.random.default_rng(20)
    while True:
        code = rng.integers(0, 2, (k, 12 * int(np.ceil(np.log2(k))))) * 2 - 1
        if len(np.unique(code, axis=0)) == k and (abs(code.sum(0)) < k).all():
            return code.astype(np.int8)


def grams(text: str):
    """Arrays of hashed n-grams of the lower-cased text."""
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    for at in range(0, len(raw), PIECE):
        part = raw[at:at + PIECE + max(LENGTHS) - 1].astype(np.uint32)
        for n in LENGTHS:
            code = np.full(max(0, len(part) - n + 1), n, np.uint32)
            for j in range(n):
                code = (code << np.uint32(8)) ^ (code >> np.uint32(21)) ^ part[j:len(code) + j]
            yield ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def margins(text: str, weights: np.ndarray) -> np.ndarray:
    """Mean weight of the text's n-grams for each bit."""
    total, n = np.zeros(weights.shape[1]), 0
    for codes in grams(text):
        for at in range(0, len(codes), 1 << 16):
            total += weights[codes[at:at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        n += len(codes)
    return total / max(1, n)


def ngram_counts(training: DataFrame) -> dict[str, np.ndarray]:
    """n-gram counts of each language over all training rows: at most MOST_LANGUAGES x FEATURES numbers."""
    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                own = seen.setdefault(lang, np.zeros(FEATURES, np.int64))
                for codes in grams(text.as_py()):
                    own += np.bincount(codes, minlength=FEATURES)
        for lang, own in seen.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()),
                                              "feature": pa.array(some), "n": pa.array(own[some])})

    rows = (training.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature")
            .agg(F.sum("n").alias("n")).limit(MOST_LANGUAGES * FEATURES + 1).toPandas())
    if rows["lang"].nunique() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for lang, part in rows.groupby("lang"):
        out[lang] = np.zeros(FEATURES)
        out[lang][part["feature"].to_numpy()] = part["n"].to_numpy()
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic regression (Newton steps with a small ridge)."""
    scale = x.std() or 1.0
    z = np.stack((x / scale, np.ones_like(x)), 1)
    b = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = z.T @ (y - p) - 1e-2 * b
        curve = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        b = b + np.linalg.solve(curve, slope)
    return b[0] / scale, b[1]


class Model:
    """Languages, codewords, n-gram weights per bit, calibration and weight of each bit."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        if not self.languages:
            return
        self.code = codewords(len(self.languages))
        share = np.stack([(counts[x] + 0.5) / (counts[x] + 0.5).sum() for x in self.languages])
        weights = []
        for bit in self.code.T:
            yes, no = share[bit > 0].mean(0), share[bit < 0].mean(0) if (bit < 0).any() else share[bit > 0].mean(0)
            weights.append(np.log(yes) - np.log(no))
        self.weights = np.stack(weights, 1).astype(np.float32)
        self.slope, self.intercept = np.full(self.code.shape[1], 20.0), np.zeros(self.code.shape[1])
        self.trust = np.ones(self.code.shape[1])

    def calibrate(self, rows: list[tuple[str, list[float]]]) -> None:
        rows = [r for r in rows if r[0] in self.languages]
        if not rows:
            return
        x = np.array([r[1] for r in rows])
        y = self.code[[self.languages.index(r[0]) for r in rows]] > 0
        for b in range(self.code.shape[1]):
            if y[:, b].any() and not y[:, b].all():
                self.slope[b], self.intercept[b] = _logistic(x[:, b], y[:, b].astype(float))
            wrong = (((x[:, b] * self.slope[b] + self.intercept[b]) > 0) != y[:, b]).mean()
            self.trust[b] = max(1e-3, 1 - 2 * wrong)

    def decode(self, margin: np.ndarray) -> tuple[str, float, bool]:
        """Nearest codeword, its share, ambiguous or not."""
        z = margin * self.slope + self.intercept
        loss = (self.trust * np.logaddexp(0, -self.code * z)).sum(1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        second = share[order[1]] if len(order) > 1 else 0.0
        return self.languages[order[0]], float(share[order[0]]), bool(second > 0.25)


def train(docs: DataFrame, training: Column, lang_col: str = "lang", id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """Learn from the rows where ``training`` holds and the language is known."""
    known = docs.filter(training & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    rows = known.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    model = Model(ngram_counts(rows))
    if len(model.languages) < 2:
        return model
    every = max(1, rows.count() // CALIBRATION)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    weights = rows.sparkSession.sparkContext.broadcast(model.weights)

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"lang": batch["lang"], "margin": pa.array(
                [margins(t.as_py(), weights.value).tolist() for t in batch["text"]], pa.list_(pa.float64()))})

    model.calibrate([(r[0], r[1]) for r in sample.mapInArrow(measure, "lang string, margin array<double>").collect()])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row."""
    rows = keyed(docs, id_col, text_col).withColumn("letter", F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            out = []
            for text, letter in zip(batch["text"], batch["letter"].to_pylist()):
                out.append(own.decode(margins(text.as_py(), own.weights)) if letter and own.languages else ("und", 0.0, False))
            lang, score, ambiguous = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "lang_pred": pa.array(lang, pa.string()),
                "score": pa.array(score, pa.float64()), "ambiguous": pa.array(ambiguous, pa.bool_())})

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean").withColumn(
        "doc_id", public_id())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, predict every row."""
    model = train(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                                       "ambiguous")
