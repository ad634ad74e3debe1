"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the folded text (letters in lower case, everything else a space). A
text's weight for a gram is its TF-IDF, scaled so that all weights of the text add up to SCALE. The regression is
trained with follow-the-regularised-leader (FTRL-proximal) under an elastic net (L1 and L2), and its probabilities are
calibrated with a temperature fitted to labelled rows that the training did not see.

Document frequencies cover every learnable document, which are those with a label. The regression is fitted on a bounded sample of
them: `per_language` different texts of each language in expectation. The weights take BUCKETS numbers a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_value, held, prepare, texts_of

#: Hash buckets of the grams.
BITS = 15
BUCKETS = 1 << BITS
SCALE = 32.0
#: Labelled rows of each language that the regression is fitted on, in expectation.
PER_LANGUAGE = 600
#: Code points of a text that are folded at a time.
PIECE = 1 << 20

_fold: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Code points of the basic plane folded: letters in lower case, everything else a space."""
    if not _fold:
        lower = (chr(c).lower() if chr(c).isalpha() else " " for c in range(65536))
        _fold.append(np.array([ord(x[0]) for x in lower], dtype=np.uint32))
    return _fold[0]


def _folded(text: str) -> np.ndarray:
    """The text's code points, letters in lower case and everything else a space, with two spaces that are no part of it behind."""
    u = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    out = np.full(len(u) + 2, 32, np.uint32)
    out[:-2] = _table()[np.minimum(u, 65535)]
    if u.max(initial=0) > 65535:
        at = np.flatnonzero(u > 65535)
        high, back = np.unique(u[at], return_inverse=True)
        out[at] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in high.tolist()], dtype=np.uint32)[back]
    return out


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's 1-, 2- and 3-grams, ascending, and how often each occurs; none for a text without a letter.

    Grams that begin with two spaces, or are a single one, don't count. A long text is gone through piece by piece.
    """
    total = np.zeros(BUCKETS + 1, np.int64)
    mix, shift = np.uint32(0xC2B2AE3D), np.uint32(32 - BITS)
    for i in range(0, max(1, len(text)), PIECE):
        # Two characters of the next piece, so that no gram is lost between them.
        c = _folded(text[i : i + PIECE + 2])
        n = min(PIECE, len(text) - i)
        a, b, d = c[:n], c[1 : n + 1], c[2 : n + 2]
        two = a * np.uint32(0x9E3779B1) + b
        three = two * np.uint32(0x85EBCA77) + d
        letter = a != 32
        some = letter | (b != 32)
        for gram, ok in (((a * np.uint32(0x27D4EB2F)) >> shift, letter), ((two * mix) >> shift, some), ((three * mix) >> shift, some)):
            total += np.bincount(gram[ok], minlength=BUCKETS + 1)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    """A fitted identifier; `table` holds each bucket's weights times its IDF, and `idf` the latter."""

    languages: list[str]
    table: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) probabilities, and whether each text has a letter. Work and memory follow the buckets that a text has."""
        logits, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        for k, t in enumerate(texts):
            at, n = _counts(t)
            letters[k] = len(at) > 0
            x = n.astype(np.float64)
            logits[k] = SCALE * (x @ self.table[at]) / max(float(x @ self.idf[at]), 1e-9) + self.bias
        return _softmax(logits / self.temperature), letters


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows, and the number of rows. BUCKETS counts reach the driver."""

    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for b in bounded(batches, 0):
            for t in texts_of(b.column(0)):
                df[_counts(t)[0]] += 1
            rows += b.num_rows
        df[BUCKETS] = rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], names=["bucket", "n"])

    got = docs.select(F.col(text).alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in got.collect():
        df[r.bucket] = r.n
    return df[:BUCKETS], int(df[BUCKETS])


def _sample(docs: DataFrame, text: str, label: str, per_language: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Languages, and for the sampled texts their buckets, counts and language: `per_language` different ones of each in expectation.

    Rates are of different texts, and each text is drawn once: copies take no other text's place, and reruns agree.
    """
    labelled = docs.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y"), F.col(text).alias("t"))
    sizes = labelled.select("y", F.xxhash64("t").alias("t")).distinct().groupBy("y").count()
    part = F.pmod(F.xxhash64("t", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    languages = sorted(r.y for r in sizes.select("y").collect())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "t"):
            got = [_counts(t) for t in texts_of(b["t"])]
            cells = [[x.astype(np.int32).tobytes() for x in column] for column in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([b["y"], *[pa.array(c, pa.binary()) for c in cells]], names=["y", "at", "n"])

    chosen = labelled.join(F.broadcast(sizes), "y").filter(part < per_language / F.col("count")).select("y", "t").distinct()  # a row a language
    got = chosen.mapInArrow(features, "y string, at binary, n binary").collect()
    got.sort(key=lambda r: (r.y, bytes(r.at), bytes(r.n)))
    where = {y: i for i, y in enumerate(languages)}
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)) for r in got]
    return languages, rows, np.array([where[r.y] for r in got], dtype=int)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """(BUCKETS + 1, classes) weights, the bias last; each row is (buckets, weights)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, x = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 11) -> Model | None:
    """An identifier of the label column's values; None if no row has a label.

    docs are the learnable rows. Null texts count as empty. With one language only that one can be predicted.
    """
    docs = docs.filter(F.col(label).isNotNull())
    df, total = document_frequencies(docs, text)
    languages, rows, y = _sample(docs, text, label, per_language)
    if not rows:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1
    weighted = [(at, SCALE * n * idf[at] / max(1e-9, float(n @ idf[at]))) for at, n in rows]
    calibrate = np.random.default_rng(seed).random(len(rows)) < 0.2
    calibrate[[int(np.flatnonzero(y == k)[0]) for k in np.unique(y)]] = False  # each language trains with one text at least
    # A language with many rows of few texts trains as often as one with many texts.
    copies = {r.y: r["count"] for r in docs.groupBy(F.col(label).cast("string").alias("y")).count().collect()}
    parts = []
    for k, language in enumerate(languages):
        own, asked = np.flatnonzero((y == k) & ~calibrate), min(int(0.8 * per_language), copies[language])
        parts.append(np.resize(own, asked) if 0 < 2 * len(own) < asked else own)
    train = np.sort(np.concatenate(parts))
    w = _ftrl([weighted[i] for i in train], y[train], len(languages), epochs, alpha, beta, l1, l2, seed)
    held = np.flatnonzero(calibrate) if calibrate.any() else train
    logits = np.stack([weighted[i][1] @ w[weighted[i][0]] + w[-1] for i in held])
    # The negative log-likelihood has one minimum in the inverse temperature; it is searched on a fixed logarithmic grid.
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
    return Model(languages, (w[:-1] * idf[:, None]).astype(np.float32), idf.astype(np.float32), w[-1], float(grid[int(np.argmin(loss))]))


def predict(docs: DataFrame, model: Model | None, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the columns `out`: the predicted language and the calibrated probability of that language; all whole texts are read.

    A null text, a text without a letter, and every text if there is no model get `und` and the score 0. Columns of these
    names in docs are replaced; rows, repeats included, are kept as they are.
    """
    kept = [c for c in docs.columns if c not in out]
    quoted = [F.col(f"`{c}`") for c in kept]
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(by_value(model))  # its size is BUCKETS times the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(sent)
        for b in bounded(batches, "t"):
            texts = texts_of(b["t"])
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if m is not None:
                p, letters = m.probabilities(texts)
                best = p.argmax(axis=1)
                lang = [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, p[np.arange(len(texts)), best], 0.0).clip(0, 1).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, *out])

    got = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted)], F.col(text).alias("t"))  # names with dots don't pass
    schema = docs.select(*quoted).withColumns({out[0]: F.lit(""), out[1]: F.lit(0.0)}).schema
    return got.mapInArrow(run, schema)


def learnable(docs: DataFrame, held_out: Column) -> DataFrame:
    """The rows that a model may learn from."""
    return docs.filter(~held_out)
