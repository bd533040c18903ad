"""Toxicity grades by a cumulative-link ordinal model.

Sparse features are a text's distinct lower-cased words and their beginnings of four to six
letters. All thresholds share one weight for each feature: P(grade > j) = sigmoid(w.x - theta_j)
with theta_0 < theta_1 < ... The severity of a text is the expected grade, sum over j of
P(grade > j); it is toxic if P(grade > 0) is at least one half.

Labels tell toxic (1) from clean (0). Grades 1 to ``GRADES`` of toxic training texts are the
quantile bins of how many of their distinct words carry a toxic feature. The model is fitted on a
bounded sample of labelled texts, of each at most ``SAMPLE_WORDS`` distinct words; scoring sees all rows and whole texts.

Null and empty texts have severity near the model's floor and are clean. Rows with a null label
are not learned from; a document labelled twice counts as toxic if one label says so. Without
a toxic label every text has severity 0. Repeated rows each give a row; extra columns stay.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import parts

#: The sample: so many texts of each label at most. Features kept, and how many and what share of the toxic texts must have one.
MAX_TOXIC, MAX_CLEAN = 2000, 4000
#: Distinct words learned from one text, and letters of such a word, at most; scoring takes all words.
SAMPLE_WORDS, SAMPLE_LETTERS = 20_000, 100
MAX_FEATURES, MIN_TEXTS, MIN_SHARE = 4000, 5, 0.01
GRADES = 3
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
KNOWN_WORDS = 200_000


def features(word: str) -> list[str]:
    """A word as a whole, marked by its end, and its beginnings."""
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) > n)]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Ordinal:
    weights: dict[str, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=list)

    def scorer(self):
        """A function from a text to w.x; it remembers words' features, up to a number of words."""
        known: dict[str, tuple[str, ...]] = {}
        get, weights = known.get, self.weights

        def score(text: str | None) -> float:
            has: set[str] = set()
            for word in distinct_words(text):
                own = get(word)
                if own is None:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    own = known[word] = tuple(f for f in features(word) if f in weights)
                if own:
                    has.update(own)
            return sum(weights[f] for f in sorted(has))

        return score

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score (rows) and threshold (columns)."""
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts)[None] - scores[:, None], -50, 50)))


def select_features(toxic: list[str], clean: list[str]) -> list[str]:
    """Features of MIN_TEXTS and of MIN_SHARE of the toxic texts or more whose share there is ten times that among clean texts; the most telling ones."""
    of = lambda text: {f for w in distinct_words(text) for f in features(w)}
    counts: Counter[str] = Counter()
    for text in toxic:
        counts.update(of(text))
    counts = Counter({f: c for f, c in counts.items() if c >= max(MIN_TEXTS, MIN_SHARE * len(toxic))})
    other: Counter[str] = Counter()
    for text in clean:
        other.update(f for f in of(text) if f in counts)
    odds = {f: np.log((c + 0.5) / (len(toxic) + 1)) - np.log((other[f] + 0.5) / (len(clean) + 1)) for f, c in counts.items()}
    return sorted((f for f, o in odds.items() if o > np.log(10)), key=lambda f: (-odds[f], f))[:MAX_FEATURES]


def likelihood(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, w: np.ndarray, first: np.ndarray, gaps: np.ndarray, ridge: float = 0.0):
    """Mean negative log likelihood of the grades, with the ridge, and its gradient by w, the first threshold and the logarithms of the gaps between thresholds.

    ``rows`` and ``cols`` say which text has which feature; ``grade`` is 0 to ``len(gaps) + 1``.
    """
    n, top = len(grade), len(gaps) + 1
    s = np.bincount(rows, w[cols], n)
    cuts = first[0] + np.concatenate(([0], np.cumsum(np.exp(gaps))))
    g = 1 / (1 + np.exp(np.clip(cuts[None] - s[:, None], -50, 50)))  # P(grade > j)
    # P(grade = y) = g[y - 1] - g[y] with g[-1] = 1 and g[top] = 0
    low = np.where(grade > 0, np.take_along_axis(g, np.maximum(grade - 1, 0)[:, None], 1)[:, 0], 1.0)
    high = np.where(grade < top, np.take_along_axis(g, np.minimum(grade, top - 1)[:, None], 1)[:, 0], 0.0)
    p = np.maximum(low - high, 1e-9)
    d_low, d_high = low * (1 - low) / p, high * (1 - high) / p  # d log P / d(s - cut)
    d_s = -(d_low - d_high) / n
    d_cuts = np.zeros(top)
    np.add.at(d_cuts, np.maximum(grade - 1, 0), np.where(grade > 0, d_low, 0) / n)
    np.add.at(d_cuts, np.minimum(grade, top - 1), -np.where(grade < top, d_high, 0) / n)
    grads = [np.bincount(cols, d_s[rows], len(w)) + ridge * w, np.array([d_cuts.sum()]), np.exp(gaps) * np.cumsum(d_cuts[::-1])[::-1][1:]]
    return -np.log(p).mean() + ridge * (w * w).sum() / 2, grads


def train(toxic: list[str], clean: list[str], steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> Ordinal:
    """Fit weights and thresholds by maximum likelihood with Adam; deterministic."""
    names = select_features(toxic, clean)
    if not toxic or not names:
        return Ordinal({}, [50.0] * GRADES)
    index = {f: i for i, f in enumerate(names)}
    rows, cols, hits = [], [], []
    for i, text in enumerate([*toxic, *clean]):
        words = [[index[f] for f in features(w) if f in index] for w in distinct_words(text)]
        own = sorted({j for w in words for j in w})
        rows += [i] * len(own)
        cols += own
        hits.append(sum(map(bool, words)))
    rows, cols, n = np.array(rows, int), np.array(cols, int), len(toxic) + len(clean)
    bins = np.quantile(hits[: len(toxic)], [(j + 1) / GRADES for j in range(GRADES - 1)])
    grade = np.zeros(n, int)
    grade[: len(toxic)] = 1 + np.searchsorted(bins, hits[: len(toxic)], "left")
    w, first, gaps = np.zeros(len(names)), np.array([1.0]), np.zeros(GRADES - 1)
    params, moments = [w, first, gaps], [[np.zeros_like(p), np.zeros_like(p)] for p in (w, first, gaps)]
    for step in range(1, steps + 1):
        _, grads = likelihood(rows, cols, grade, w, first, gaps, ridge)
        for q, d, m in zip(params, grads, moments, strict=True):
            m[0] += 0.1 * (d - m[0])
            m[1] += 0.001 * (d * d - m[1])
            q -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    cuts = first[0] + np.concatenate(([0], np.cumsum(np.exp(gaps))))
    return Ordinal({f: float(x) for f, x in zip(names, w, strict=True) if x}, cuts.tolist())


def sample_text(text: str | None, most: int = SAMPLE_WORDS) -> str | None:
    """What is learned from a text: its distinct words, of a longer list the ``most`` of least CRC-32; longer words than SAMPLE_LETTERS are left out."""
    if text is None:
        return None
    words = sorted(w for w in distinct_words(text) if len(w) <= SAMPLE_LETTERS)
    if len(words) > most:
        words = sorted(sorted(words, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))[:most])
    return " ".join(words)


def _shortened(batches):
    for batch in parts(batches, column="text"):
        short = pa.array([sample_text(t) for t in batch.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), short], ["doc_id", "toxic", "text"])


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Ordinal:
    """Train on at most ``max_toxic`` toxic and ``max_clean`` clean texts, chosen by a hash of doc_id. ``labels`` has doc_id and toxic."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = [marks.filter(F.col("toxic") == v).orderBy(draw, "doc_id").limit(n) for v, n in ((1, max_toxic), (0, max_clean))]
    ids = picked[0].unionByName(picked[1])  # bounded by max_toxic + max_clean rows
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id")  # of rows of one id always the same
    rows = own.agg(F.first("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("doc_id", "toxic", "x.text")
    rows = rows.mapInArrow(_shortened, rows.schema).collect()  # at most MAX_TOXIC + MAX_CLEAN rows of SAMPLE_WORDS words
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows if r["toxic"]], [r["text"] for r in rows if not r["toxic"]])


def _scored(docs: DataFrame, model: Ordinal, text_col: str, names: list[str], keep: bool):
    added = [] if keep else ["severity", "p_toxic", "grade", "toxic"]

    def per_batch(batches):
        score = model.scorer()
        for batch in parts(batches, column=text_col):
            p = model.exceed(np.array([score(t) for t in batch.column(text_col).to_pylist()], float))
            if keep:
                yield batch.filter(pa.array(p[:, 0] < 0.5))
            else:
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)], [*names, *added])

    schema = docs.schema if keep else docs.select(names).selectExpr("*", "0d severity", "0d p_toxic", "0 grade", "false toxic").schema
    return docs.mapInArrow(per_batch, schema)


def grade(docs: DataFrame, model: Ordinal, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with severity (expected grade), p_toxic, grade (thresholds passed with probability one half) and toxic; columns of these names are replaced."""
    docs = docs.drop("severity", "p_toxic", "grade", "toxic")
    return _scored(docs, model, text_col, [c for c in docs.columns if keep_text or c != text_col], False)


def drop_toxic(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text isn't toxic."""
    return _scored(docs, model, text_col, docs.columns, True)


def grade_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, p_toxic, grade, toxic of every document."""
    return grade(docs.select("doc_id", "text"), fit(docs, labels), keep_text=False)
