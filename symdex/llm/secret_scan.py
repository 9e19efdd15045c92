"""Operator 8: secrets, by fixed patterns and by character Markov models of random strings and identifiers.

Every whole text is scanned. Three base kinds are patterns: `assign` (a keyword, a separator and a value of 8 or
more characters), `access` (AKIA and upper-case letters or digits, 16 or more characters) and `hex` (32 or more of
[0-9a-f]); matches are leftmost and without overlap within a kind, and those that are too short are dropped after
matching. The fourth kind, `random`, is looked for in runs of [A-Za-z0-9+/_=-], in each part of 20 or more characters
that is outside the base spans: the whole part, if a first-order Markov model of random strings explains it better
than one of identifiers, by a log-likelihood ratio a character; else its best stretches of 20 or more characters,
each widened to the separators around it, as long as their ratio also makes up for the number of stretches there
are to choose from. Spans are code points, end exclusive.

The models are fitted on labelled samples that a seeded rule generates: random strings over several alphabets,
and identifiers, paths, words and numbers. Null text counts as empty and has no spans; repeated rows give repeated
results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from symdex.llm.shared import keyed, map_texts, table

KINDS = ("assign", "access", "hex", "random")
#: The keyword letters may have either case, ASCII only.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
_SEPARATORS = frozenset("+/_=-")
_HINTS = ("password", "passwd", "secret", "token", "api")
_RUN = np.array([chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-" for b in range(256)])

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
_SYLLABLES = "an ar at be ch co con de der die do du ed el en er es est for ge ha he ie in ing is it ja la le lich ly ma ment mi nd ne no nt of on or os ou par qu que ra re ri ro sch se sh si st ta te th ti tion to tr un ung ur ve ver vi wh".split()
_TERMS = "get set user name value index path file config client server request response handler factory builder manager service data list map key type error log test init update delete create read write open close start stop http json xml id url".split()


def labelled_samples(seed: int = 7, n: int = 4000) -> tuple[dict[str, list[str]], list[str]]:
    """Random strings by alphabet, and ordinary strings of the same run characters."""
    r = random.Random(seed)
    noise = {k: ["".join(r.choices(a, k=r.randint(20, 64))) for _ in range(n)] for k, a in ALPHABETS.items()}
    ordinary = []
    for _ in range(3 * n):
        kind = r.randrange(6)
        words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 6))) if r.random() < 0.6 else r.choice(_TERMS) for _ in range(r.randint(2, 6))]
        if kind == 0:
            s = "_".join(words)
        elif kind == 1:
            s = words[0] + "".join(w.capitalize() for w in words[1:])
        elif kind == 2:
            s = "/".join(words) + r.choice(("", "/" + str(r.randrange(10**4))))
        elif kind == 3:
            s = "-".join(words) + r.choice(("", "-" + str(r.randrange(10**6))))
        elif kind == 4:
            s = "".join(words).upper() if r.random() < 0.5 else "".join(words)
        else:
            s = r.choice(("-", "=", "_", "/", "")).join(str(r.randrange(10 ** r.randint(1, 8))) for _ in range(r.randint(3, 8))) if r.random() < 0.4 else r.choice("-=_+/0123456789abcdefxyzABCXYZ") * r.randint(20, 80)
        ordinary.append(s)
    return noise, ordinary


class Markov:
    """First-order log probabilities of characters, smoothed; row 0 stands for the start."""

    def __init__(self, samples: list[str], smoothing: float = 0.2):
        n = np.full((128, 128), smoothing)
        for s in samples:
            c = np.frombuffer(b"\0" + s.encode("ascii"), np.uint8)
            np.add.at(n, (c[:-1], c[1:]), 1)
        self.logp = np.log(n / n.sum(1, keepdims=True))

    def of(self, codes: np.ndarray) -> float:
        return float(self.logp[codes[:-1], codes[1:]].sum())


class Scanner:
    """`margin` is the log-likelihood ratio a character that a run must reach."""

    def __init__(self, margin: float = 0.9, seed: int = 7):
        noise, ordinary = labelled_samples(seed)
        self.noise = [Markov(x) for x in noise.values()]
        self.ordinary, self.margin = Markov(ordinary), margin

    def ratio(self, s: str) -> float:
        """Log-likelihood ratio a character: the best random model against the ordinary one."""
        c = np.frombuffer(b"\0" + s.encode("ascii"), np.uint8)
        return (max(m.of(c) for m in self.noise) - self.ordinary.of(c)) / len(s)

    def stretch(self, s: str) -> tuple[int, int] | None:
        """(start, end) of the stretch of s that lies farthest above the margin, or nothing if none stands out."""
        c = np.frombuffer(b"\0" + s.encode("ascii"), np.uint8)
        n = len(s) - LEAST + 1  # starts, and ends, of a stretch
        best = (np.log(n * (n + 1) / 2), -1, -1)
        for m in self.noise:
            total = np.concatenate(([0.0], np.cumsum(m.logp[c[:-1], c[1:]] - self.ordinary.logp[c[:-1], c[1:]] - self.margin)))
            gain = total[LEAST:] - np.minimum.accumulate(total[:n])
            end = int(gain.argmax())
            if gain[end] >= best[0]:
                best = (gain[end], int(total[: end + 1].argmin()), end + LEAST)
        _, a, b = best
        if a < 0:
            return None
        while a > 0 and s[a] not in _SEPARATORS and s[a - 1] not in _SEPARATORS:
            a -= 1
        while b < len(s) and s[b - 1] not in _SEPARATORS and s[b] not in _SEPARATORS:
            b += 1
        return a, b

    def random_spans(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of the random parts of a run without base spans."""
        found, todo = [], [(0, len(s))]
        while todo:
            a, b = todo.pop()
            if b - a < LEAST:
                continue
            part = s[a:b]
            got = (0, b - a) if self.ratio(part) >= self.margin else self.stretch(part)
            if got:
                found.append((a + got[0], a + got[1]))
                todo += [(a, a + got[0]), (a + got[1], b)]
        return found

    def scan(self, raws: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, kind number, end) of each text's spans, sorted. Only runs of 16 or more run characters are looked into."""
        data = b"\n".join(raws) + b"\n"
        inside = _RUN[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        starts, ends = edges[0::2], edges[1::2]
        long = ends - starts >= 16
        starts, ends = starts[long], ends[long]
        first = np.cumsum([0] + [len(x) + 1 for x in raws])
        of_text = np.searchsorted(starts, first)
        out = []
        for i, raw in enumerate(raws):
            spans: list[tuple[int, int, int]] = []
            low = raw.lower()
            if (b":" in raw or b"=" in raw) and any(h.encode() in low for h in _HINTS):
                spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw.decode()) if m.end(2) - m.start(2) >= 8]
            maybe: list[tuple[int, str]] = []
            ascii_only = raw.isascii()
            for a, b in zip(starts[of_text[i] : of_text[i + 1]].tolist(), ends[of_text[i] : of_text[i + 1]].tolist(), strict=True):
                run = data[a:b].decode("ascii")
                at = a - int(first[i])
                at = at if ascii_only else len(raw[:at].decode())
                spans += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run)]
                spans += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run)]
                maybe += [(at + m.start(), m[0]) for m in CANDIDATE.finditer(run)]
            base = sorted(spans)
            k, done = 0, 0
            for at, run in maybe:
                while k < len(base) and base[k][0] < at:
                    k, done = k + 1, max(done, base[k][2])
                begin, end = max(at, done), at + len(run)
                while begin < end:
                    while k < len(base) and base[k][0] <= begin:
                        k, done = k + 1, max(done, base[k][2])
                    if done > begin:
                        begin = done
                        continue
                    stop = min(end, base[k][0]) if k < len(base) else end
                    spans += [(begin + a, 3, begin + b) for a, b in self.random_spans(run[begin - at : stop - at])]
                    begin = stop
            out.append(sorted(spans))
        return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SCANNERS: dict[float, Scanner] = {}


def scanner(margin: float) -> Scanner:
    if margin not in _SCANNERS:
        _SCANNERS[margin] = Scanner(margin)
    return _SCANNERS[margin]


def scan_texts(df: DataFrame, key: str = "doc_id", text: str = "text", margin: float = 0.9) -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each row."""

    def make():
        own = scanner(margin)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = own.scan([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
            counts = [pa.array([sum(k == kind for _, k, _ in x) for x in found], pa.int64()) for kind in range(4)]
            base = pa.array([hashlib.sha256(_joined([y for y in x if y[1] < 3]).encode()).hexdigest() for x in found])
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, base, pa.array(list(map(_joined, found)))], ["key", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

        return each

    schema = keyed(df, key, "n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")
    return map_texts(df.select(df[key].alias("key"), df[text].alias("text")), "text", make, schema).withColumnRenamed("key", key)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", margin: float = 0.9) -> DataFrame:
    """The same rows and columns with every span of the text replaced by a mark; null stays null."""
    names, schema = df.columns, df.schema
    at = names.index(text)

    def make():
        own = scanner(margin)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raws = batch.column(at).cast(pa.binary()).to_pylist()
            texts = []
            for raw, spans in zip(raws, own.scan([x or b"" for x in raws]), strict=True):
                if raw is None or not spans:
                    texts.append(None if raw is None else raw.decode())
                    continue
                whole, parts, done = raw.decode(), [], 0
                for s, _, e in spans:
                    if s >= done:
                        parts += [whole[done:s], mark]
                    done = max(done, e)
                texts.append("".join(parts) + whole[done:])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    return map_texts(df, text, make, schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_texts(table(spark, sf_dir, "documents"))
