"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes (A-Z lowered) are cut into windows of 256 bytes. In each window, filters of
two, three and four bytes' width slide over the bytes, every filter keeps its largest answer,
and a softmax over these gives the window's language. A text's language is the one with the
largest mean log probability over all its windows, weighted by the bytes in each.

The network is trained in numpy on windows of a bounded sample of labelled texts (see ``fit``);
everything else sees all rows and whole texts. A null text, or one without a letter, is ``und``
with score 0. Null, repeated or extra columns make no difference: each row is judged by its text
alone. With no labelled text at all every row is ``und``; with one language, every row that has
a letter is of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import LOWER, parts, text_bytes

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: The sample: so many texts in all and a language, and windows of each.
MAX_TEXTS, PER_LANG, PER_TEXT = 4000, 800, 4
BLOCK = 128
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    taps: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    out_bias: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in windows, each text filled up with zeros (three at least), and each text's number of windows."""
    size = np.diff(offsets)
    n = -(-(size + 3) // WINDOW)
    begin = np.concatenate(([0], np.cumsum(n)))[:-1] * WINDOW
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(begin - offsets[:-1], size)] = LOWER[data]
    return out, n


def softmax_log(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(texts: list[bytes], labels: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit the network to labelled windows (at most WINDOW - 3 bytes each) with Adam; deterministic for given input."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(texts), WINDOW + 4), np.uint8)
    for i, t in enumerate(texts):
        t = t[: WINDOW - 3]
        x[i, : len(t)] = LOWER[np.frombuffer(t, np.uint8)]
    k, f = len(langs), len(WIDTHS) * FILTERS
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for p in params:
        p[:, 0] = 0
    params += [np.zeros(f, np.float32), rng.normal(0, 0.1, (f, k)).astype(np.float32), np.zeros(k, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            b, y = x[pick], labels[pick]
            rows = np.arange(len(b))
            top, where = [], []
            for w, p in zip(WIDTHS, params, strict=False):
                z = sum(p[j][b[:, j : j + WINDOW]] for j in range(w))
                where.append(z.argmax(1))
                top.append(np.take_along_axis(z, where[-1][:, None], 1)[:, 0])
            top = np.concatenate(top, 1) + params[-3]
            live = np.maximum(top, 0)
            prob = np.exp(softmax_log(live @ params[-2] + params[-1]))
            prob[rows, y] -= 1
            prob /= len(b)
            back = (prob @ params[-2].T) * (top > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g, own = np.zeros_like(params[i]), back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (b[rows[:, None], where[i] + j], np.arange(FILTERS)), own)
                grads.append(g)
            grads += [back.sum(0), live.T @ prob, prob.sum(0)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(langs, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


class Reader:
    """The network with its taps joined in pairs, so that two bytes cost one look-up."""

    def __init__(self, net: Network):
        self.net = net
        pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, FILTERS))
        two, three, four = net.taps
        self.two, self.three = pair(*two), (pair(three[0], three[1]), three[2])
        self.four = pair(four[0], four[1]), pair(four[2], four[3])

    def log_probs(self, stream: np.ndarray) -> np.ndarray:
        """Of each window of the stream, the log probability of each language."""
        n = len(stream) // WINDOW
        padded = np.concatenate((stream, np.zeros(4, np.uint8)))
        pairs = (padded[:-1].astype(np.uint16) << 8) | padded[1:]
        out = np.empty((n, len(self.net.langs)), np.float32)
        a, b = np.empty((BLOCK * WINDOW, FILTERS), np.float32), np.empty((BLOCK * WINDOW, FILTERS), np.float32)
        for at in range(0, n, BLOCK):
            m = min(BLOCK, n - at)
            lo, size = at * WINDOW, m * WINDOW
            cut = lambda x, shift: x[lo + shift : lo + shift + size]  # noqa: B023, E731
            tops = []
            for first, second, source, shift in ((self.two, None, None, 0), (*self.three, padded, 2), (*self.four, pairs, 2)):
                z = np.take(first, cut(pairs, 0), axis=0, out=a[:size], mode="clip")
                if second is not None:
                    z += np.take(second, cut(source, shift), axis=0, out=b[:size], mode="clip")
                z, left = z.reshape(m, WINDOW, FILTERS), WINDOW
                while left > 1:
                    left //= 2
                    z = np.maximum(z[:, :left], z[:, left:], out=z[:, :left])
                tops.append(z[:, 0].copy())
            live = np.maximum(np.concatenate(tops, 1) + self.net.bias, 0)
            out[at : at + m] = softmax_log(live @ self.net.out + self.net.out_bias)
        return out

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's best language (its number) and the probability of it."""
        data, offsets = text_bytes(column)
        stream, n = windows(data, offsets)
        weight = np.count_nonzero(stream.reshape(-1, WINDOW), axis=1) + 1e-6
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        z = np.add.reduceat(self.log_probs(stream) * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
        p = np.exp(softmax_log(z))
        return p.argmax(1), np.clip(p.max(1).astype(np.float64), 0, 1)


def fit(labelled: DataFrame, max_texts: int = MAX_TEXTS, per_lang: int = PER_LANG) -> Network:
    """Train on about ``per_lang`` texts of each language, ``max_texts`` in all at most, and PER_TEXT windows of each.

    ``labelled`` has doc_id, text and a non-null lang. Which texts, and which windows of them, follows from hashes of doc_id.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in labelled.filter("lang is not null").groupBy("lang").count().collect()}
    if not counts:
        return Network([], [], np.zeros(0), np.zeros(0), np.zeros(0))
    langs = sorted(counts)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, min(per_lang, max_texts / len(langs)) / counts[k]))) for k in langs])
    draw = F.xxhash64(F.lit("sample"), "doc_id")
    picked = usable.filter(F.pmod(draw, F.lit(1_000_000)) < share * 1_000_000)
    reach = F.greatest(F.length("text") - WINDOW, F.lit(1))
    pieces = F.array(*[F.substring("text", F.pmod(F.xxhash64(F.lit(i), "doc_id"), reach).cast("int") + 1, F.lit(WINDOW)) for i in range(PER_TEXT)])
    rows = picked.select("lang", draw.alias("draw"), pieces.alias("pieces")).orderBy("draw", "lang").limit(max_texts).collect()
    number = {k: i for i, k in enumerate(langs)}
    pairs = sorted({(p, number[r["lang"]]) for r in rows for p in r["pieces"] if any(c.isalpha() for c in p)})
    return train([p.encode() for p, _ in pairs], np.array([y for _, y in pairs], int), langs)


def identify(docs: DataFrame, net: Network, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    names = [c for c in docs.columns if keep_text or c != text_col]
    has = "letters"
    while has in {c.lower() for c in docs.columns}:
        has = f"_{has}"
    docs = docs.withColumn(has, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    def per_batch(batches):
        reader = Reader(net) if len(net.langs) > 1 else None
        langs = np.array([*net.langs, UNKNOWN], object)
        for batch in parts(batches, column=text_col):
            letters = np.asarray(batch.column(has).to_numpy(zero_copy_only=False), bool)
            best, score = np.zeros(batch.num_rows, int), np.ones(batch.num_rows)
            if reader:
                best, score = reader.texts(batch.column(text_col))
            best, score = np.where(letters, best, len(langs) - 1), np.where(letters & (len(net.langs) > 0), score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(langs[best], pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(per_batch, docs.select(names).selectExpr("*", "'' lang_pred", "0d score").schema)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the documents whose crc32(doc_id) mod 5 isn't 0, applied to all. A null doc_id isn't held out, nor learned from."""
    docs = docs.select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"))
    net = fit(docs.filter("not held_out").select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"), net, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")
