"""Operator 3: language identification by hierarchical discrimination.

A linear support vector machine first tells a text's language family; within the family, one-versus-one linear
support vector machines separate the closely related languages, and the pairwise confidences are averaged per
language. Features are hashed character n-grams of the lower-cased letters, with one space between words, as
square roots of their shares, so that a text's length plays no part.

Families are a parameter (language -> family); a language without an entry is a family of its own. The machines
are fitted on a bounded sample of labelled texts (`per_language`); every whole text is then scored. A text that is
null or has no letters is `und` with score 0. Rows with null language are never learnt from. Repeated rows
give repeated results; an empty table gives an empty result; with no labelled text at all every text is `und`.
The key, the language, the source and further columns are never inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from symdex.llm.shared import keyed, held_out, map_texts, table, texts_of
from symdex.llm.wordhash import U, mix

#: Language families by ISO 639-1 code.
FAMILIES = {
    **dict.fromkeys(["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"], "germanic"),
    **dict.fromkeys(["fr", "es", "pt", "it", "ro", "ca", "gl", "oc"], "romance"),
    **dict.fromkeys(["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"], "slavic"),
}
DIMENSIONS = 1 << 13
#: Text and rows that are turned into features at once.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 128
#: Texts that are learnt from, for each language.
PER_LANGUAGE = 400


def _letter_table() -> np.ndarray:
    codes = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            codes[c] = c
    return codes


_LETTERS: np.ndarray | None = None


def features(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, letters in each text)."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[: len(codes)]
    letter = _LETTERS[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes >= 0x10000)
    if len(high):
        found, which = np.unique(codes[high], return_inverse=True)
        letter[high] = np.array([c if chr(c).isalpha() else 0 for c in found.tolist()], np.uint32)[which]
    first = np.ones(len(codes), bool)
    first[1:] = (letter[1:] != 0) | (letter[:-1] != 0)  # one gap between words
    letter, text = letter[first].astype(U), text[first]
    n_letters = np.bincount(text[letter > 0], minlength=len(texts))
    out = np.zeros((len(texts), dimensions), np.float32)
    for size in (1, 2, 3):
        if len(letter) < size:
            continue
        n = len(letter) - size + 1
        h = np.full(n, U(size))
        inside = np.ones(n, bool)
        gap = np.zeros(n, np.int8)
        for i in range(size):
            part = letter[i : i + n]
            h = h * U(0x100000001B3) ^ part
            inside &= text[i : i + n] == text[:n]
            gap += part == 0
        inside &= gap < size
        at = (mix(h[inside]) & U(dimensions - 1)).astype(np.int64)
        out += np.bincount(text[:n][inside] * dimensions + at, minlength=out.size).reshape(out.shape)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0), n_letters


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps, classes weighted alike; y is -1 or 1."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step, vw, vb, t = 0.25, w.copy(), b, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * y * weight
        nw, nb = vw - step * (l2 * vw - 2 * (x.T @ slack)), vb + step * 2 * slack.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class Model:
    families: dict[str, list[str]]
    #: Machines of families (one against the rest), then of each pair of languages in a family.
    family_w: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS, 0), np.float32))
    family_b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    pairs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    pair_w: dict[str, np.ndarray] = field(default_factory=dict)
    pair_b: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.families or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        x, n_letters = features(texts)
        names = list(self.families)
        p = 1 / (1 + np.exp(-3 * (x @ self.family_w + self.family_b)))
        p = p / p.sum(1, keepdims=True)
        family = p.argmax(1)
        langs, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for f, name in enumerate(names):
            rows = np.flatnonzero((family == f) & (n_letters > 0))
            if not len(rows):
                continue
            members = self.families[name]
            votes = np.ones((len(rows), len(members)))
            if len(members) > 1:
                q = 1 / (1 + np.exp(-3 * (x[rows] @ self.pair_w[name] + self.pair_b[name])))
                votes[:] = 0
                for i, (a, b) in enumerate(self.pairs[name]):
                    votes[:, a] += q[:, i]
                    votes[:, b] += 1 - q[:, i]
                votes /= len(members) - 1
            best = votes.argmax(1)
            langs[rows] = np.array(members, object)[best]
            score[rows] = p[rows, f] * votes[np.arange(len(rows)), best]
        return langs.tolist(), np.clip(score, 0, 1)


def fit(texts: list[str], langs: list[str], families: dict[str, str] = FAMILIES) -> Model:
    tree: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        tree.setdefault(families.get(lang, f"only {lang}"), []).append(lang)
    model = Model(tree)
    if not texts:
        return model
    parts = [features(texts[i : i + 64]) for i in range(0, len(texts), 64)]
    x, n = np.concatenate([p for p, _ in parts]), np.concatenate([k for _, k in parts])
    keep = n > 0
    x, y = x[keep], np.array(langs, object)[keep]
    own = np.array([families.get(v, f"only {v}") for v in y], object)
    machines = [fit_svm(x, np.where(own == f, 1, -1)) for f in tree] if len(tree) > 1 else [(np.zeros(x.shape[1]), 1.0)] * len(tree)
    model.family_w = np.stack([w for w, _ in machines], 1).astype(np.float32)
    model.family_b = np.array([b for _, b in machines], np.float32)
    for f, members in tree.items():
        if len(members) < 2:
            continue
        model.pairs[f] = list(combinations(range(len(members)), 2))
        machines = []
        for a, b in model.pairs[f]:
            rows = (y == members[a]) | (y == members[b])
            machines.append(fit_svm(x[rows], np.where(y[rows] == members[a], 1, -1)))
        model.pair_w[f] = np.stack([w for w, _ in machines], 1).astype(np.float32)
        model.pair_b[f] = np.array([b for _, b in machines], np.float32)
    return model


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, families: dict[str, str] = FAMILIES) -> Model:
    """Fit on up to `per_language` rows of each language, those with the least hashes of their key. Rows beyond a
    threshold that about twice as many stay under are left out first. A key counts once a language, with its least text."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.approx_count_distinct(key)).collect()}
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    wanted = F.lit(False)
    for name, n in counts.items():
        wanted = wanted | ((F.col(lang) == name) & (hashed < int((1 << 30) * min(1.0, 2.0 * per_language / n))))
    rows = rows.where(wanted).select(hashed.alias("h"), F.col(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.groupBy("lang", "h").agg(F.min("t").alias("t"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))).where(F.col("n") <= per_language)
    found = sorted((name, n, t) for name, n, t in rows.select("lang", "n", "t").toLocalIterator())
    return fit([t for _, _, t in found], [name for name, _, _ in found], families)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, score = own.predict(texts_of(batch, "text"))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

        return each

    return map_texts(df.select(df[key].alias("key"), df[text].alias("text")), "text", make, keyed(df, key, "lang_pred string, score double"), SLICE_BYTES, SLICE_ROWS).withColumnRenamed("key", key)


def label_rows(df: DataFrame, model: Model, text: str = "text", name: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All rows and columns of df, with the predicted language and its score added."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    names = schema.names

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = own.predict([x or "" for x in batch.column(at).to_pylist()])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

        return each

    return map_texts(df, text, make, schema, SLICE_BYTES, SLICE_ROWS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~own))
    return predict(docs, model).select("doc_id", own.alias("held_out"), "lang_pred", "score")
