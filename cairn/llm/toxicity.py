"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding maps every letter to a skeleton: accents go, homoglyphs of other scripts become the Latin letter they look like, digits and
signs that stand for letters become those, `l` and `1` become `i`; everything else is a space. A lexicon term is the beginning
of a word or a whole word. A match inside an exception phrase doesn't count. The weights of a text's matches are summed,
also per hundred words, and a logistic curve of both gives the score.

Terms, weights, exception phrases and the curve are learned from labelled texts only, of which a bounded sample is taken:
`per_class` of either label in expectation. All terms and phrases of the sample that have the support are in the lexicon.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, by_value, held, prepare, texts_of

PER_CLASS = 3000
#: Sampled texts are counted by so many tasks.
SAMPLE_TASKS = 16
#: Toxic texts of the sample that a term must occur in, its least weight (the logarithm of the ratio of its rates), and the least
#: likelihood ratio statistic of its counts, which keeps out terms that are rare among the others by chance.
SUPPORT = 3
LEAST_WEIGHT = 1.5
LEAST_EVIDENCE = 8.0
#: L1 penalty of the joint weights: a term that other terms of the same texts make superfluous gets none.
PENALTY = 1e-3
#: A superfluous term stays after all if it alone is this heavy and this well supported: another text may have it by itself.
ALONE_WEIGHT = 4.5
ALONE_EVIDENCE = 60.0
STEMS = range(4, 9)

#: Letters that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "ѕ": "s", "т": "t",
    "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ь": "b", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ʀ": "r", "ɴ": "n", "ⅼ": "l", "ӏ": "l", "օ": "o", "ս": "u", "ո": "n", "հ": "h",
}
#: Digits and signs that stand for a letter.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}

_fold: list[np.ndarray] = []


def _skeleton(c: str) -> str:
    base = unicodedata.normalize("NFKD", c.lower())[:1].lower()
    base = HOMOGLYPHS.get(c.lower(), HOMOGLYPHS.get(base, base))
    base = SUBSTITUTIONS.get(base, base)
    if not base or not base.isalpha():
        return " "
    return "i" if base == "l" else base


def _table() -> np.ndarray:
    if not _fold:
        surrogate = range(0xD800, 0xE000)
        _fold.append(np.array([32 if c in surrogate else ord(_skeleton(chr(c))) for c in range(65536)], dtype=np.uint32))
    return _fold[0]


def fold_all(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts folded, each between spaces, in one string; where the space before each is; each one's number of words.

    Two spaces part two texts, so that no phrase reaches from one into the next.
    """
    u = np.frombuffer(("\n" + "\n\n".join(texts) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    c = _table()[np.minimum(u, 65535)]
    high = u > 65535
    if high.any():
        values, back = np.unique(u[high], return_inverse=True)
        c[high] = np.array([ord(_skeleton(chr(x))) for x in values.tolist()], dtype=np.uint32)[back]
    starts = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))[:-1]))
    begins = np.append((c[:-1] == 32) & (c[1:] != 32), False)
    return c.tobytes().decode("utf-32-le"), starts, np.add.reduceat(begins, starts, dtype=np.int64)


def fold(text: str) -> str:
    """One text folded; its length in code points is unchanged."""
    return fold_all([text])[0][1:-1]


@dataclass
class Lexicon:
    """Folded terms with weights (a leading space binds a term to a word's beginning, a trailing one to its end), phrases, and the curve."""

    terms: dict[str, float]
    exceptions: list[str]
    curve: np.ndarray

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        a.make_automaton()
        return a


def _matches(whole: str, automaton: ahocorasick.Automaton) -> tuple[np.ndarray, list]:
    """Where the matches of terms outside exception phrases begin, and their values."""
    ends, begins, values, spans = [], [], [], []
    for end, (length, value) in automaton.iter(whole) if len(automaton) else ():
        if value is None:
            spans.append((end + 1 - length, end))
        else:
            ends.append(end)
            begins.append(end + 1 - length)
            values.append(value)
    b = np.array(begins, dtype=np.int64)
    if not (spans and ends):
        return b, values
    spans.sort()
    left, right = np.array([s for s, _ in spans]), np.maximum.accumulate([x for _, x in spans])
    at = np.searchsorted(left, b, side="right") - 1
    outside = ~((at >= 0) & (right[np.maximum(at, 0)] >= np.array(ends)))
    return b[outside], [v for v, keep in zip(values, outside.tolist(), strict=True) if keep]


def sums(texts: list[str], automaton: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each text's matches outside exception phrases, and its number of words."""
    if not texts:
        return np.zeros(0), np.zeros(0, np.int64)
    whole, starts, words = fold_all(texts)
    begins, weights = _matches(whole, automaton)
    total = np.zeros(len(texts))
    np.add.at(total, np.searchsorted(starts, begins, side="right") - 1, np.array(weights, dtype=float))
    return total, words


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], axis=1)


def _score(weight: np.ndarray, words: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(weight, words) @ curve, -30, 30)))


def _curve(weight: np.ndarray, words: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method. each: how many labelled rows a row stands for, so that the classes weigh as they do in the whole table."""
    x, w, each = _features(weight, words), np.zeros(3), each / each.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + ridge * w
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    # A heavier match never lowers the score.
    w[1:] = np.maximum(w[1:], 0)
    return w


def _joint(sample: DataFrame, lexicon: Lexicon) -> dict[str, float]:
    """The lexicon's terms with weights of their own: a logistic regression on all of them at once, non-negative and with an L1
    penalty, by accelerated proximal gradients. Terms of weight 0 are left out. The driver holds the terms of each sampled text."""
    names = sorted(lexicon.terms)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Lexicon({term: i for i, term in enumerate(names)}, lexicon.exceptions, lexicon.curve).automaton()
        for b in bounded(batches, "t"):
            found = [sorted(set(_matches(f" {fold(t)} ", a)[1])) for t in texts_of(b["t"])]
            yield pa.RecordBatch.from_arrays([b["y"], pa.array(found, pa.list_(pa.int32()))], names=["y", "found"])

    got = sample.mapInArrow(present, "y int, found array<int>").collect()
    y = np.array([r.y for r in got], dtype=float)
    row = np.repeat(np.arange(len(got)), [len(r.found) for r in got])
    term = np.array([i for r in got for i in r.found], dtype=np.int64)
    w, bias = np.zeros(len(names)), 0.0
    v, v_bias, t = w, bias, 1.0
    # The largest curvature is at most a quarter of the mean squared length of a row times its terms' overlap; rows are short.
    step = 4 / (1 + max(1, np.bincount(row, minlength=1).max(initial=1)) * max(1, np.bincount(term, minlength=1).max(initial=1)) / len(got))
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[term], len(got)) + v_bias, -30, 30)))
        r = (p - y) / len(got)
        new = np.maximum(v - step * (np.bincount(term, r[row], len(names)) + PENALTY), 0)
        new_bias, t_next = v_bias - step * r.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = max(np.abs(new - w).max(initial=0), abs(new_bias - bias))
        v, v_bias = new + (t - 1) / t_next * (new - w), new_bias + (t - 1) / t_next * (new_bias - bias)
        w, bias, t = new, new_bias, t_next
        if moved < 1e-4:
            break
    return {n: float(x) for n, x in zip(names, w, strict=True) if x > 1e-3}


def _terms(folded_words: set[str]) -> set[str]:
    out = {f" {w} " for w in folded_words if len(w) >= 3}
    for w in folded_words:
        out.update(f" {w[:k]}" for k in STEMS if len(w) >= k)
    return out


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled documents. labels are the rows that may be learned from; a document labelled both ways counts as toxic.

    exceptions: phrases given beforehand, beside those that are learned. Rows with a null id or label teach nothing; of documents that share an
    id one teaches, that of the least text hash. Without toxic rows the lexicon is empty and every score is near 0.
    """
    y = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.max(label) > 0).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in y.groupBy("y").count().collect()}
    part = F.pmod(F.xxhash64(F.lit(5), "__id"), F.lit(1 << 30)) / float(1 << 30)
    take = F.coalesce(*[F.when(F.col("y") == k, F.lit(per_class / n)) for k, n in sorted(counts.items())], F.lit(0.0))
    chosen = y.filter(part < take)  # 2 * per_class rows in expectation: small enough to broadcast
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("t")).join(F.broadcast(chosen), "__id")
    sample = sample.groupBy("__id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("t", "y")
    sample = scratch.cut(sample.repartition(SAMPLE_TASKS), "sample")

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that each term occurs in."""
        have = Counter()
        for b in bounded(batches, "t"):
            for t in texts_of(b["t"]):
                folded = f" {fold(t)} "
                for phrase in lexicon.exceptions:
                    folded = folded.replace(phrase, "  ")
                have.update(_terms(set(folded.split())))
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64())], names=["term", "n"])

    def counted(k: int) -> DataFrame:
        return sample.filter(F.col("y") == k).select("t").mapInArrow(count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    def count_phrases(lexicon: Lexicon):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, have = lexicon.automaton(), (Counter(), Counter())
            for b in bounded(batches, "t"):
                for t, k in zip(texts_of(b["t"]), b["y"].to_pylist(), strict=True):
                    words = fold(t).split()
                    hit = {i for i, w in enumerate(words) if any(True for _ in a.iter(f" {w} "))} if len(a) else set()
                    have[k].update({f" {' '.join(words[i - d : i - d + 2])} " for i in hit for d in (0, 1) if 0 <= i - d < len(words) - 1})
            names = list(have[0] | have[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([have[1][t] for t in names], pa.int64()), pa.array([have[0][t] for t in names], pa.int64())], names=["term", "pos", "neg"])

        return run

    lexicon = Lexicon({}, [f" {fold(p).strip()} " for p in exceptions], np.array([-5.0, 0.0, 0.0]))
    n = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos:
        return lexicon
    both = counted(1).filter(F.col("n") >= min(SUPPORT, n_pos)).select("term", F.col("n").alias("pos")).join(counted(0).withColumnRenamed("n", "neg"), "term", "left").na.fill(0, ["neg"])
    pos, neg = F.col("pos"), F.col("neg")
    expected = (pos + neg) * n_pos / (n_pos + n_neg)
    weight = F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))
    evidence = 2 * (pos * F.log(pos / expected) + neg * F.log(F.greatest(neg, F.lit(0.5)) / F.greatest(pos + neg - expected, F.lit(0.5))))
    kept = both.select("term", weight.alias("w"), evidence.alias("e")).filter((F.col("w") >= LEAST_WEIGHT) & ((F.col("e") >= LEAST_EVIDENCE) | F.lit(not n_neg)))
    rows = kept.orderBy(F.desc("w"), "term").collect()  # of the sample's terms
    # The shortest of the terms that begin alike and weigh about the same stands for the longer ones.
    for r in sorted(rows, key=lambda r: (len(r.term.strip()), r.term)):
        word = r.term.strip()
        shorter = (lexicon.terms.get(f" {word[:k]}") for k in STEMS if k <= len(word) and f" {word[:k]}" != r.term)
        if not any(w is not None and w >= r.w - 1.0 for w in shorter):
            lexicon.terms[r.term] = float(r.w)
    # Phrases are learned for well supported terms only: those of chance would turn their own negatives into exceptions.
    sure = Lexicon({r.term: lexicon.terms[r.term] for r in rows if r.e >= ALONE_EVIDENCE and r.term in lexicon.terms}, [], lexicon.curve)
    phrases = sample.mapInArrow(count_phrases(sure), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    safe = phrases.filter(f"neg >= {SUPPORT} AND neg > 20 * pos").orderBy(F.desc("neg"), "term").collect()  # of the sample's word pairs
    lexicon.exceptions += [r.term for r in safe]
    joint = _joint(sample, lexicon)
    usual = float(np.median(list(joint.values()) or [1.0]))
    alone = {r.term: 0.7 * usual for r in rows if r.w >= ALONE_WEIGHT and r.e >= ALONE_EVIDENCE and r.term in lexicon.terms}
    lexicon.terms = alone | joint

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in bounded(batches, "t"):
            w, words = sums(texts_of(b["t"]), a)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(words), b["y"]], names=["w", "words", "y"])

    got = sample.mapInArrow(measure, "w double, words long, y int").toPandas()  # three numbers for each sampled row
    each = got.y.map({k: max(1.0, n / per_class) for k, n in counts.items()}).to_numpy()
    lexicon.curve = _curve(got.w.to_numpy(), got.words.to_numpy(), got.y.to_numpy(), each)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with `score` and `predicted`; whole texts are read, null ones as empty; rows are kept as they are.

    Columns of these names in docs are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    quoted = [F.col(f"`{c}`") for c in kept]
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(by_value(lexicon))  # bounded by the sample that it was learned from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(sent)
        a = known.automaton()
        for b in bounded(batches, "t"):
            s = _score(*sums(texts_of(b["t"]), a), known.curve)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    got = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted)], F.col(text).alias("t"))  # names with dots don't pass
    schema = docs.select(*quoted).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return got.mapInArrow(run, schema)
