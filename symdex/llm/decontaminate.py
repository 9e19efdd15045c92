"""Operator 4: benchmark passages in documents, by a prefix-filtered set join.

A benchmark item's windows are its runs of `window` words (all its words, where it has fewer). A document that
contains a window contains each of the window's shingles (runs of `shingle` words), so for full containment the
necessary prefix of a window, in an order of its shingles from rare to common, is its one rarest shingle. Two
passes over the documents:

1. count how often each benchmark shingle occurs in all documents (partial counts are added up per task before
   they are shuffled; one row a shingle comes back);
2. look only for each window's rarest shingle. The shingle's place in the window fixes where the window would
   begin (position bound); it must fit between the text's first and last word (length bound); then all the words
   are compared. A window whose rarest shingle never occurs is not looked for.

The benchmark is dealt into blocks of a bounded size; a block is sorted arrays, which each task gets once. One block
marks its words in one pass. With several, each block by itself finds the texts that it hits, by their digests, and
stores them; the finds are united by digest and joined to the texts, which move only if the finds are too many to send.

Words are compared by 64-bit hashes, a window by the hashes of all its words. Letters A-Z are lower-cased; words
are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. Null or empty text has no words, is never contaminated, and as an item has
no window. Repeated rows give repeated results; repeated item ids count once; a null item id counts as the empty
string. Empty tables give no rows, or no hits. Further columns of either table are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import Workspace, bytes_of, keyed, map_texts, slices, table
from symdex.llm.wordhash import BY_SIGN, U, runs

WINDOW, SHINGLE = 13, 4
#: Bytes of benchmark text to a block, which bounds what is collected and broadcast at once: about six bytes for each.
BLOCK_BYTES = 16 << 20
#: Places of windows that are looked at together.
CHUNK = 1 << 18


class Windows:
    """The distinct windows of one block of the benchmark, as arrays: where each begins in the block's words, its length and its items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, shingle: int = SHINGLE):
        self.words, first, _, _, _ = BY_SIGN.hashes([t for _, t in items])
        self.names = [n for n, _ in items]
        size = np.diff(first)
        length = np.minimum(size, window)
        many = np.where(size > 0, size - length + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[:-1][item]
        length = length[item]
        name = np.empty(len(item), U)
        for n in np.unique(length):
            rows = length == n
            name[rows] = runs(self.words, int(n))[start[rows]]
        order = np.lexsort((item, name, length))
        item, start, length, name = item[order], start[order], length[order], name[order]
        new = np.ones(len(item), bool)
        new[1:] = (name[1:] != name[:-1]) | (length[1:] != length[:-1])
        again = ~new
        again[1:] &= item[1:] == item[:-1]
        window_of = np.cumsum(new) - 1
        self.start, self.length = start[new].astype(np.int32), length[new].astype(np.int16)
        self.items, window_of = item[~again].astype(np.int32), window_of[~again]
        self.items_at = np.searchsorted(window_of, np.arange(len(self.start) + 1)).astype(np.int32)
        self.shingle = shingle
        #: Sorted distinct shingles by shingle size.
        self.shingles = {k: np.unique(runs(self.words, k)[self._places(k)]) for k in np.unique(np.minimum(self.length, shingle)).tolist()}
        self.anchors: dict[int, tuple] = {}

    def _places(self, k: int) -> np.ndarray:
        """Where shingles of k words begin that lie in a window of that shingle size."""
        mine = np.minimum(self.length, self.shingle) == k
        steps = np.bincount(self.start[mine], minlength=len(self.words) + 1) - np.bincount(self.start[mine] + self.length[mine] - k + 1, minlength=len(self.words) + 1)
        return np.flatnonzero(np.cumsum(steps) > 0)

    def order_by_rarity(self, counts: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle, of equals the one with the least hash: its hash, and the windows and places that belong to it."""
        for k, known in self.shingles.items():
            own, places = runs(self.words, k), self._places(k)
            often = np.zeros(len(own), np.int64)
            often[places] = counts[k][np.searchsorted(known, own[places])]
            keys, windows, at = [], [], []
            for n in np.unique(self.length[np.minimum(self.length, self.shingle) == k]):
                same = np.flatnonzero(self.length == n)
                for part in np.array_split(same, -(-len(same) * int(n) // CHUNK)):
                    index = self.start[part, None] + np.arange(n - k + 1)
                    f, h = often[index], own[index]
                    place = np.where(f == f.min(1, keepdims=True), h, np.iinfo(np.uint64).max).argmin(1)
                    rows = np.arange(len(part))
                    there = f[rows, place] > 0
                    keys.append(h[rows, place][there])
                    windows.append(part[there].astype(np.int32))
                    at.append(place[there].astype(np.int16))
            keys, windows, at = np.concatenate(keys), np.concatenate(windows), np.concatenate(at)
            order = np.argsort(keys, kind="stable")
            distinct, begin = np.unique(keys[order], return_index=True)
            if len(distinct):
                self.anchors[k] = (distinct, np.append(begin, len(keys)), windows[order], at[order])
        self.shingles = {}

    def count(self, raws: list[bytes], into: dict[int, np.ndarray]) -> None:
        h, first, _, _, _ = BY_SIGN.hashes(raws)
        for k, known in self.shingles.items():
            own = _inside(runs(h, k), first, k)[1]
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            into[k] += np.bincount(at[known[at] == own], minlength=len(known))

    def find(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each text and one more, text, start word and window of each occurrence)."""
        h, first, _, _, _ = BY_SIGN.hashes(raws)
        text_at, word_at, window_at = [], [], []
        for k, (keys, begin, windows, places) in self.anchors.items():
            spots, own = _inside(runs(h, k), first, k)
            at = np.searchsorted(keys, own)
            at[at == len(keys)] = 0
            hit = keys[at] == own
            spots, at = spots[hit], at[hit]
            upto = np.cumsum(begin[at + 1] - begin[at])
            for low in range(0, int(upto[-1]) if len(upto) else 0, CHUNK):  # pairs of a place and a window, a part at a time
                pair = np.arange(low, min(low + CHUNK, int(upto[-1])))
                which = np.searchsorted(upto, pair, side="right")
                row = begin[at[which] + 1] - (upto[which] - pair)
                position, w = spots[which], windows[row]
                text = np.searchsorted(first, position, side="right") - 1
                start, size = position - places[row], self.length[w].astype(np.int64)
                fits = (start >= first[text]) & (start + size <= first[text + 1])
                text, start, w, size = text[fits], start[fits], w[fits], size[fits]
                for n in np.unique(size):
                    same = np.flatnonzero(size == n)
                    for part in np.array_split(same, -(-len(same) * int(n) // CHUNK)):
                        steps = np.arange(n)
                        equal = (h[start[part, None] + steps] == self.words[self.start[w[part], None] + steps]).all(1)
                        text_at.append(text[part[equal]])
                        word_at.append(start[part[equal]])
                        window_at.append(w[part[equal]])
        empty = [np.empty(0, np.int64)]
        return first, np.concatenate(text_at or empty), np.concatenate(word_at or empty), np.concatenate(window_at or empty)

    def marks(self, raws: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[list[int], list[str]]]]:
        """(words of each text, by the number of a text with hits: its spans as start and end words in turn, and its items)."""
        first, text, start, window = self.find(raws)
        order = np.lexsort((start, text))
        text, start, window = text[order], start[order], window[order]
        end = start + self.length[window]
        found = {}
        for i in np.unique(text):
            a, b = np.searchsorted(text, [i, i + 1])
            mine = np.unique(np.concatenate([self.items[self.items_at[w] : self.items_at[w + 1]] for w in np.unique(window[a:b])]))
            found[int(i)] = _union(zip((start[a:b] - first[i]).tolist(), (end[a:b] - first[i]).tolist(), strict=True)), sorted({self.names[x] for x in mine})
        return np.diff(first), found


def _inside(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs that don't cross a text's end."""
    ok = np.ones(len(hashes), bool)
    for i in range(1, k):
        ends = first[1:] - i
        ok[ends[(ends >= 0) & (ends < len(ok)) & (ends >= first[:-1])]] = False
    at = np.flatnonzero(ok)
    return at, hashes[at]


def _shingle_counts(texts: DataFrame, windows: Windows, spark: SparkSession) -> dict[int, np.ndarray]:
    shared = spark.sparkContext.broadcast(windows)

    def run(batches):
        own = shared.value
        into = {k: np.zeros(len(x), np.int64) for k, x in own.shingles.items()}
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                own.count(bytes_of(part, "text"), into)
        for k, n in into.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], ["size", "at", "n"])

    counts = {k: np.zeros(len(x), np.int64) for k, x in windows.shingles.items()}
    for k, at, n in texts.select("text").mapInArrow(run, "size int, at bigint, n bigint").groupBy("size", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[k][at] = n
    shared.unpersist()
    return counts


def _mark(texts: DataFrame, windows: Windows, spark: SparkSession, keep_text: bool) -> DataFrame:
    """(key, text, n_words, spans, items) of (key, text); the text is null unless it is kept."""
    shared = spark.sparkContext.broadcast(windows)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, found = own.marks(bytes_of(batch, "text"))
            rows = [found.get(i, ([], [])) for i in range(batch.num_rows)]
            text = batch.column(1) if keep_text else pa.nulls(batch.num_rows, pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(n_words), pa.array([x for x, _ in rows], pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.list_(pa.string()))], ["key", "text", "n_words", "spans", "items"])

        return each

    return map_texts(texts.select("key", "text"), "text", make, keyed(texts, "key", "text string, n_words bigint, spans array<bigint>, items array<string>"))


def _union(pairs) -> list[int]:
    """Spans without overlap, as start and end in turn."""
    out: list[int] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _found_by_block(spark: SparkSession, texts: DataFrame, blocks: list, window: int, shingle: int) -> DataFrame:
    """(digest, spans, items) of the texts that any block hits: spans of all blocks one after the other."""
    work = Workspace(spark, "benchmark")
    all_found = None
    for n, block in enumerate(blocks):
        windows = _windows(texts, block, window, shingle, spark)
        hit = _mark(texts.select(F.md5("text").alias("key"), "text"), windows, spark, False).where(F.size("items") > 0)
        found = work.write(hit.select(F.col("key").alias("digest"), "spans", "items").dropDuplicates(["digest"]), f"block-{n}")
        all_found = found if all_found is None else all_found.unionByName(found)
    united = all_found.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return work.write(united, "found")


def _windows(texts: DataFrame, bench: DataFrame, window: int, shingle: int, spark: SparkSession) -> Windows:
    items = sorted({(r["item"], r["text"].encode()) for r in bench.select("item", "text").toLocalIterator()})
    windows = Windows(items, window, shingle)
    windows.order_by_rarity(_shingle_counts(texts, windows, spark) if len(windows.start) else {})
    return windows


#: The union of spans given as start and end in turn, in any order; and how many words spans cover.
_UNITED = """flatten(transform(aggregate(array_sort(transform(sequence(0, size(spans) - 1, 2), i -> struct(spans[i] AS a, spans[i + 1] AS b))), CAST(array() AS ARRAY<STRUCT<a: BIGINT, b: BIGINT>>),
    (out, x) -> IF(size(out) > 0 AND x.a <= element_at(out, -1).b, concat(slice(out, 1, size(out) - 1), array(struct(element_at(out, -1).a AS a, greatest(element_at(out, -1).b, x.b) AS b))), concat(out, array(x)))), x -> array(x.a, x.b)))"""
_COVERED = "aggregate(transform(spans, (x, i) -> IF(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)"


def contaminated_words(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """(key, n_words, n_hit, spans, items) of each document: the word spans hit and the ids of the items found; on request the text too."""
    texts = documents.select(documents[key].alias("key"), "text")
    bench = benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        out = _mark(texts, _windows(texts, bench, window, shingle, spark), spark, keep_text)
    else:
        bench = bench.withColumn("b", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
        found = _found_by_block(spark, texts, [bench.where(F.col("b") == b) for b in range(blocks)], window, shingle)
        out = _mark(texts, Windows([], window, shingle), spark, True).drop("spans", "items").withColumn("digest", F.md5("text"))
        out = (out if keep_text else out.drop("text")).join(found, "digest", "left").drop("digest")
        out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("spans", F.when(F.size("spans") > 0, F.expr(_UNITED)).otherwise(F.array().cast("array<bigint>")))
    return out.select(F.col("key").alias(key), *["text"] * keep_text, "n_words", F.expr(_COVERED).alias("n_hit"), "spans", "items")


def drop_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, item: str = "item_id", share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows and columns of documents, without contaminated ones. Each text goes through once, beside the other columns."""
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*[documents[c] for c in others] or [F.lit(0)]).alias("row"), "text")
    found = contaminated_words(spark, rows, benchmark, "row", item, block_bytes=block_bytes, keep_text=True)
    found = found.where(~((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))
    return found.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns])


def contamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", share: int = 20) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated): contaminated if at least one word in `share` is hit."""
    found = contaminated_words(spark, documents, benchmark, key, item)
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
occ AS (SELECT doc_id, i, grams.k, item FROM grams JOIN win ON grams.k = win.k AND grams.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
