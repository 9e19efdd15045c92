"""Operator 2: document quality by a linear-chain conditional random field over lines.

Every line of a whole text is labelled good or bad. A line's features are its own shape (length, signs, capitals,
digits, word lengths, repeated words, whether the line occurred before in the text) and the same of the lines before
and after it; transition weights tie neighbouring labels. Forward-backward gives each line's probability of being
good; their average, weighted by line length, is the document's quality, which a logistic curve maps to the score.

Lines carry no labels of their own, so in training each line has its document's label (distant supervision); the
field is fitted by gradient steps on the conditional log-likelihood, the curve on the training documents' averages.
At most `max_docs` labelled documents are learnt from, those with the least hashes of their key. Every whole text is
scored; long texts cost time in proportion to their length.

Null text counts as empty and is one empty line, and so has a score like any other. Rows with a null label are not
learnt from; without any labelled row every score is 0.5. Repeated rows give repeated results; an empty table gives
an empty result. Key, labels, language, source and further columns are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import keyed, bytes_of, held_out, map_texts, table
from symdex.llm.wordhash import BY_SPACE

#: Labelled documents that are learnt from.
MAX_DOCS, MAX_BYTES = 2000, 64 << 20

#: Byte classes that lines are described by.
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_LOWER = np.array([97 <= b < 123 for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_SIGN = np.array([chr(b) in "#*$%&|<>{}[]=_~^@\\+/" for b in range(256)])
_MARK = np.array([chr(b) in ".,;:!?\"'()-" for b in range(256)])
_LOUD = np.array([chr(b) in "!|" for b in range(256)])
_HIGH = np.array([b >= 0xC0 for b in range(256)])


def line_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes and one, first line of each text and one more)."""
    h, _, starts, ends, data = BY_SPACE.hashes(raws)
    buf = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(buf == 10)
    begin = np.concatenate(([0], breaks[:-1] + 1))
    text_end = np.cumsum([len(r) + 1 for r in raws])
    first = np.concatenate(([0], np.searchsorted(breaks, text_end - 1) + 1)).astype(np.int64)
    length = breaks - begin

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (sums[breaks] - sums[begin]).astype(np.float64)

    size = np.maximum(length, 1)
    upper, lower = total(_UPPER[buf]), total(_LOWER[buf])
    word_line = np.searchsorted(breaks, starts)
    n_words = np.bincount(word_line, minlength=len(breaks)).astype(np.float64)
    text_of_line = np.repeat(np.arange(len(raws)), np.diff(first))
    again = _seen_before(text_of_line[word_line] if len(word_line) else word_line, h)
    repeated = np.bincount(word_line, again, minlength=len(breaks))
    next_same = np.zeros(len(h))
    if len(h) > 1:
        next_same[1:] = (h[1:] == h[:-1]) & (word_line[1:] == word_line[:-1])
    stutter = np.bincount(word_line, next_same, minlength=len(breaks))
    line_hash = np.zeros(len(breaks), np.uint64)
    if len(h):
        sums = np.concatenate(([0], np.cumsum(h * (np.arange(1, len(h) + 1, dtype=np.uint64) - np.searchsorted(word_line, word_line).astype(np.uint64)), dtype=np.uint64)))
        at = np.searchsorted(word_line, np.arange(len(breaks) + 1))
        line_hash = sums[at[1:]] - sums[at[:-1]]
    copied = _seen_before(text_of_line, line_hash) * (n_words > 0)
    words = np.maximum(n_words, 1)
    signs = total(_SIGN[buf])
    own = np.stack(
        [
            length == 0,
            np.log1p(length) / 6,
            np.log1p(n_words) / 4,
            np.minimum(signs / words, 3),
            np.minimum(total(_LOUD[buf]) / words, 2),
            np.minimum(total(_MARK[buf]) / words, 3) / 2,
            upper / np.maximum(upper + lower, 1),
            total(_DIGIT[buf]) / size,
            np.minimum((size - n_words) / words, 20) / 10,
            repeated / words,
            stutter / words,
            copied,
            total(_HIGH[buf]) / size,
            (n_words > 0) & (n_words < 4),
        ],
        1,
    ).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    heads, tails = first[:-1], first[1:] - 1
    before[heads], after[tails] = 0, 0
    edge = np.zeros((len(own), 2))
    edge[heads, 0] = 1
    edge[tails, 1] = 1
    # squares let a linear weight tell "some" from "most"
    return np.concatenate([own, own**2, before, after, edge, np.ones((len(own), 1))], 1), length + 1, first


def _seen_before(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 where the same value came earlier in its group."""
    out = np.zeros(len(value))
    if len(value):
        order = np.lexsort((np.arange(len(value)), value, group))
        same = (value[order][1:] == value[order][:-1]) & (group[order][1:] == group[order][:-1])
        out[order[1:][same]] = 1
    return out


def forward_backward(good: np.ndarray, first: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability that each line is good, log partition of each text, expected transitions 2 x 2).

    `good` is each line's score of being good against bad, `stay` the 2 x 2 transition scores. Texts advance
    together, longest first, so that each step is one array operation.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, size = first[:-1][order], n[order]
    scores = np.stack([np.zeros(len(good)), good], 1)
    fwd, bwd = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than i lines
    for i in range(longest):
        at = begin[: active[i]] + i
        if i == 0:
            fwd[at] = scores[at]
        else:
            v = fwd[at - 1][:, :, None] + stay
            m = v.max(1)
            fwd[at] = m + np.log(np.exp(v - m[:, None, :]).sum(1)) + scores[at]
    for i in range(longest - 2, -1, -1):
        at = begin[: active[i + 1]] + i
        v = (scores[at + 1] + bwd[at + 1])[:, None, :] + stay
        m = v.max(2)
        bwd[at] = m + np.log(np.exp(v - m[:, :, None]).sum(2))
    last = first[1:] - 1
    m = fwd[last].max(1)
    z = m + np.log(np.exp(fwd[last] - m[:, None]).sum(1))
    zl = np.repeat(z, n)
    p = np.exp(fwd[:, 1] + bwd[:, 1] - zl)
    inner = np.ones(len(good), bool)
    inner[last] = False
    a = np.flatnonzero(inner)
    pairs = np.exp(fwd[a][:, :, None] + stay + (scores[a + 1] + bwd[a + 1])[:, None, :] - zl[a][:, None, None]).sum(0)
    return p, z, pairs


@dataclass
class Model:
    weights: np.ndarray
    stay: np.ndarray
    slope: float
    middle: float

    def averages(self, raws: list[bytes]) -> np.ndarray:
        x, size, first = line_features(raws)
        p, _, _ = forward_backward(np.clip(x @ self.weights, -30, 30), first, self.stay)
        return np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1])

    def score(self, raws: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.averages(raws) - self.middle), -40, 40)))


def fit(raws: list[bytes], labels: list[int], rounds: int = 150, l2: float = 1e-3) -> Model:
    if not raws:
        return Model(np.zeros(line_features([b""])[0].shape[1]), np.zeros((2, 2)), 0.0, 0.0)
    x, size, first = line_features(raws)
    y_doc = np.asarray(labels, float)
    y = np.repeat(y_doc, np.diff(first))
    n = np.diff(first)
    share = np.where(y_doc > 0, 0.5 / max(1, (y_doc > 0).sum()), 0.5 / max(1, (y_doc == 0).sum()))
    line_weight = np.repeat(share / n, n)
    same = np.array([[((1 - y_doc) * (n - 1)).sum(), 0], [0, (y_doc * (n - 1)).sum()]]) / max(1, (n - 1).sum())
    w, stay = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for t in range(1, rounds + 1):  # Adam
        p, _, pairs = forward_backward(np.clip(x @ w, -30, 30), first, stay)
        g = np.concatenate([x.T @ ((y - p) * line_weight) - l2 * w, 0.1 * ((same - pairs / max(1, (n - 1).sum())) - l2 * stay).reshape(-1)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, stay = w + step[:-4], np.clip(stay + step[-4:].reshape(2, 2), -1.5, 1.5)
    model = Model(w, stay, 1.0, 0.0)
    a = model.averages(raws)
    s, c = 1.0, 0.0
    for _ in range(200):  # Newton steps of a one-feature logistic fit, slope kept positive
        q = 1 / (1 + np.exp(-np.clip(s * a + c, -40, 40)))
        r, v = y_doc - q, np.maximum(q * (1 - q), 1e-6)
        grad = np.array([(r * a).sum() - 1e-2 * s, r.sum()])
        hess = np.array([[(v * a * a).sum() + 1e-2, (v * a).sum()], [(v * a).sum(), v.sum() + 1e-6]])
        ds, dc = np.linalg.solve(hess, grad)
        s, c = max(0.5, s + np.clip(ds, -2, 2)), c + np.clip(dc, -2, 2)
    return Model(w, stay, float(s), float(-c / s))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on up to `max_docs` labelled documents, and of those on as many as have `max_bytes` of text together; a key
    with several labels counts as its largest, and one with several texts as the least."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    least = known.select(key, "label", F.xxhash64(key).alias("h")).orderBy("h", key).limit(max_docs)
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("t")).join(F.broadcast(least), key)
    rows = rows.groupBy("h", key).agg(F.min("t").alias("t"), F.max("label").alias("label")).orderBy("h", key)
    texts, labelled, size = [], [], 0
    for r in rows.toLocalIterator():
        raw = r["t"].encode()
        size += len(raw)
        if size > max_bytes:
            break
        texts.append(raw)
        labelled.append(int(r["label"] > 0))
    return fit(texts, labelled)


def scores(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = own.score(bytes_of(batch, "text"))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["key", "score", "predicted"])

        return each

    return map_texts(df.select(df[key].alias("key"), df[text].alias("text")), "text", make, keyed(df, key, "score double, predicted int")).withColumnRenamed("key", key)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = held_out(F.col("doc_id"), 3, 1)
    model = train(docs.where(~own), labels.where(~own))
    return scores(docs, model).select("doc_id", own.alias("held_out"), "score", "predicted")
