"""Operator 13: exact Jaccard join of word n-gram sets, by set-relation skipping.

1. Each whole text's set of distinct word shingles is hashed. Shingles are ordered from rare to common by a sketch of how
   many texts hold them: 2^SKETCH_BITS counters over all texts, summed in the shared folder, told apart in eighths of a
   power of two, so that what each task gets is 2^SKETCH_BITS bytes at any size. Equal counters are ordered by hash. The
   order has no part in what is found, only in how much is looked at.
2. Texts with equal sets are one class. Two sets that reach the threshold share a shingle of their prefixes (the first
   n - ceil(t * n) + 1 in the order). Each two classes of a bucket (those with one prefix shingle) are candidates if sizes,
   places and parity bitmaps don't rule it out; a bucket of more than SMALL classes is looked at in cells of bounded size,
   which give as many candidates as join what their filters leave. Sets of more than LONG shingles have prefixes so long
   that unlike ones share some: a bucket of theirs is a range of sizes, and their bitmaps are as wide as they have shingles.
   Families are the components of candidates; only their sets are made again and moved. Their texts are picked by a bitmap
   of hashed ids, which has at most 2^FILTER_BITS bits at any size, so that no text is ever moved.
3. Families are dealt to blocks of a bounded number of shingles. A block has an inverted list for each shingle, in stretches
   of one place in the set, by size in a stretch. A set that leads reads the lists of its own prefix and skips each
   stretch that place and size rule out (index-level skipping), then counts exactly what it shares with the candidates.
   Sets that differ from it in few shingles follow it: what they share with its candidates is its counts, less the lists
   of what they lack and plus the lists of what they add (answer-level skipping). The leader reads with so much slack
   that no answer of a follower is missed. Sets in one component need no test, and a set whose component holds most of a
   block reads lists of the others alone.
4. A family wider than a block is first joined by one verified pair a class. Members of a larger bucket stay only if sizes,
   places and bitmaps leave them one of another component, so that no set moves for a bucket in vain; then classes outside its largest component
   are searched against all, in a grid of blocks, the family as one or bucket by bucket, whichever is less work.
5. Links, at most one for each set and component that a block finds, become components by large-star and small-star
   contraction.

What is stored is deleted after its last use, and what a stored table was shuffled from as soon as it is stored.

No pair in the threshold is missed: filters are necessary conditions, and nothing is capped. Shingles are compared by
64-bit hashes; two different ones of a pair of texts with a million shingles each agree by chance with a probability
below 1e-7.

Null or empty text, or text without words, has an empty set and is linked with nothing, also where other rows of its key
have words. Fewer words than a shingle make one shingle of them all. Rows that repeat a key are one node: all their sets
are linked through it. A null key keeps a null component and links nothing. An empty table gives no rows. Further columns
are not looked at. The key is of an integer type and keeps it; keys of other types are refused.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symdex.llm.near_duplicates import _blocks, _set_sums, _signed, _verified, components, shingle_sets
from symdex.llm.shared import Workspace, bytes_of, map_texts, slices, table
from symdex.llm.wordhash import U, mix

SKETCH_BITS = 22
#: Bits of a row of the sketch, and rows to a counter that are summed apart before the last sum.
_CHUNK_BITS, _SALTS = 16, 16
#: Bits of the bitmap of ids by which texts are picked.
FILTER_BITS = 26
#: Classes of a bucket up to which each two are looked at by themselves.
SMALL = 8
#: Shingles to a block of a search.
BLOCK_SHINGLES = 1 << 20
#: 64-bit words of a parity bitmap.
BITMAP_WORDS = 16
#: Shingles up to which two sets meet through their prefixes.
LONG = 2048
#: Classes to a side of a cell in which a larger bucket's bitmaps are compared, and about how many bytes of cells go to one call.
CELL, CELLS_BYTES = 4096, 1 << 23
#: A set follows a leader if they differ in at most one of so many shingles.
FOLLOW = 12


def packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold the largest, compressed."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes(), 1)


def unpacked(x: bytes, width: int) -> np.ndarray:
    raw = zlib.decompress(x)
    return np.frombuffer(raw, f"<u{len(raw) // width}").astype(np.uint64)


def rarity(docs: DataFrame, work: Workspace, shingle: int, bits: int = SKETCH_BITS) -> bytes:
    """A byte for each value of a hash's first bits: how many texts hold such a shingle, in eighths of a power of two."""
    chunks = max(0, bits - _CHUNK_BITS)
    width = 1 << (bits - chunks)

    def count(batches) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            counts = np.zeros(1 << bits, np.uint32) if counts is None else counts
            for part in slices(batch, "text", 1 << 21):
                values, _ = shingle_sets(bytes_of(part, "text"), shingle)
                np.add.at(counts, (values >> U(64 - bits)).astype(np.int64), 1)
        if counts is not None:
            salt = TaskContext.get().partitionId() % _SALTS
            for c, chunk in enumerate(counts.reshape(-1, width)):
                if chunk.any():
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([salt], pa.int32()), pa.array([packed(chunk)], pa.binary())], ["c", "s", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for x in rows.column("counts"):
            total += unpacked(x.as_py(), width)
        return rows.slice(0, 1).select(["c", "s"]).append_column("counts", pa.array([packed(total)], pa.binary()))

    schema = "c int, s int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).groupBy("c", "s").applyInArrow(add, schema)
    whole = work.write(parts.groupBy("c").applyInArrow(add, schema), "rarity")
    out = np.zeros((1 << chunks, width), np.uint8)
    for row in whole.collect():
        out[row["c"]] = np.minimum(8 * np.log2(unpacked(row["counts"], width) + 1.0), 255)
    work.drop(whole)
    return out.tobytes()


def in_order(values: np.ndarray, first: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The sets' shingles, of each set from rare to common. `values` are sorted in each set."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = U(64 - (len(levels).bit_length() - 1))
    return values[np.argsort(text * 256 + levels[(values >> shift).astype(np.int64)], kind="stable")]


def prefix_sizes(n: np.ndarray, threshold: int) -> np.ndarray:
    return np.where(n > 0, n + (-threshold * n) // 100 + 1, 0)


def parities(values: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bitmaps of so many 64-bit words for each set, one after the other."""
    start = np.concatenate(([0], np.cumsum(64 * words)))
    text = np.repeat(np.arange(len(words)), np.diff(first))
    bit = (mix(values ^ U(0x5851F42D4C957F2D)) >> U(32)).astype(np.int64) % (64 * words[text])
    odd = np.bincount(start[text] + bit, minlength=start[-1]) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bitmaps(values: np.ndarray, first: np.ndarray, words: int = BITMAP_WORDS) -> np.ndarray:
    """For each set the parity of its shingles by bit: two sets differ in at least as many shingles as their bitmaps in bits."""
    return parities(values, first, np.full(len(first) - 1, words)).reshape(len(first) - 1, words)


def long_words(n: np.ndarray, threshold: int, long: int) -> np.ndarray:
    """Words of a long set's bitmap, a power of two: a bit to a shingle, more where a low threshold allows many differences."""
    bits = n * max(1.0, 8 * (100 - threshold) / (100 + threshold))
    return np.where(n > long, 1 << np.ceil(np.log2(np.maximum(bits / 64, 1))).astype(np.int64), 0)


def folded(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bitmaps of powers of two of words (n of them from `start`) as rows of the fewest: halves laid over each other have the same parities."""
    least = n.min() if len(n) else 1
    out = np.empty((len(n), least), words.dtype)
    for width in np.unique(n):
        rows = np.flatnonzero(n == width)
        out[rows] = np.bitwise_xor.reduce(words[start[rows][:, None] + np.arange(width)].reshape(len(rows), -1, least), axis=1)
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.view(np.int64)))


def profiles(docs: DataFrame, levels, shingle: int, threshold: int) -> DataFrame:
    """(id, n, h1, h2, bits, long, prefix) of (id, text): two sums name the set; `long` has a long set's bitmap, whose prefix is
    left out where it can only meet long ones."""
    long = LONG

    def make():
        level = np.frombuffer(levels.value, np.uint8)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, first = shingle_sets(bytes_of(batch, "text"), shingle)
            n = np.diff(first)
            ordered, p = in_order(values, first, level), np.where(n * threshold <= 100 * long, prefix_sizes(n, threshold), 0)
            at = np.arange(p.sum()) + np.repeat(first[:-1] - (np.cumsum(p) - p), p)
            bits, words = bitmaps(values, first).reshape(-1), long_words(n, threshold, long)
            own = np.flatnonzero(words)
            wide = parities(values[_ranges(first[own], n[own])], np.concatenate(([0], np.cumsum(n[own]))), words[own])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *map(_signed, _set_sums(values, first)), _lists(bits, np.full(len(n), BITMAP_WORDS)), _lists(wide, words), _lists(ordered[at], p)], ["id", "n", "h1", "h2", "bits", "long", "prefix"])

        return each

    return map_texts(docs, "text", make, "id bigint, n bigint, h1 bigint, h2 bigint, bits array<bigint>, long array<bigint>, prefix array<bigint>")


def _ordered_sets(docs: DataFrame, levels, shingle: int) -> DataFrame:
    """(id, h1, h2, shingles) of (id, text), shingles from rare to common."""

    def make():
        level = np.frombuffer(levels.value, np.uint8)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, first = shingle_sets(bytes_of(batch, "text"), shingle)
            return pa.RecordBatch.from_arrays([batch.column(0), *map(_signed, _set_sums(values, first)), _lists(in_order(values, first, level), np.diff(first))], ["id", "h1", "h2", "shingles"])

        return each

    return map_texts(docs, "text", make, "id bigint, h1 bigint, h2 bigint, shingles array<bigint>")


def picked(docs: DataFrame, ids: DataFrame, work: Workspace) -> DataFrame:
    """Rows of docs of the given ids, and a few others: those whose hash hits a bitmap of them, which is sent to the rows."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    mask = lambda b: F.expr(f"shiftleft(1L, cast({b} & 63 AS int))")
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(mask("bit")).alias("bits"))
    words = work.write(words, "filter")
    return docs.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(mask("bit")) != 0).select(*docs.columns)


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... for each low, n of them."""
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


class Sets:
    """Sets as one array: shingles of a set in the common order, and the same by value."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray):
        self.tokens, self.offsets, self.n = tokens, offsets, np.diff(offsets)
        self.by_value = tokens[np.lexsort((tokens, np.repeat(np.arange(len(self.n)), self.n)))]

    def ordered(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]

    def sorted(self, i: int) -> np.ndarray:
        return self.by_value[self.offsets[i] : self.offsets[i + 1]]

    def shared(self, i: int, rows: np.ndarray) -> np.ndarray:
        """How many shingles each row shares with set i."""
        own, n = self.sorted(i), self.n[rows]
        theirs = self.by_value[_ranges(self.offsets[rows], n)]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        return np.bincount(np.repeat(np.arange(len(rows)), n)[hit], minlength=len(rows))


class Lists:
    """Inverted lists of some sets: a list has stretches of one place in the set, a stretch is sorted by size."""

    def __init__(self, sets: Sets, rows: np.ndarray):
        n = sets.n[rows]
        row = np.repeat(rows, n)
        place = _ranges(np.zeros(len(rows), np.int64), n)
        token = sets.tokens[_ranges(sets.offsets[rows], n)]
        order = np.lexsort((sets.n[row], place, token))
        self.row, place, token = row[order], place[order], token[order]
        size = sets.n[self.row]
        if len(token):
            new = np.concatenate(([True], token[1:] != token[:-1]))
            start = np.flatnonzero(new | np.concatenate(([True], place[1:] != place[:-1])))
        else:
            new, start = np.empty(0, bool), np.empty(0, np.int64)
        self.ends = np.concatenate((start, [len(token)]))
        self.place, self.least = place[start], size[start]
        self.most = size[self.ends[1:] - 1]
        self.token = token[new]
        self.stretch = np.concatenate((np.flatnonzero(new[start]), [len(start)]))
        self.key = np.repeat(np.arange(len(start)), np.diff(self.ends)) << 32 | size

    def _found(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the tokens have a list, number of the list)."""
        if not len(self.token):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
        hit = np.flatnonzero(self.token[at] == tokens)
        return hit, at[hit]

    def candidates(self, ordered: np.ndarray, slack: int, t: int) -> np.ndarray:
        """Rows that may reach t hundredths with a set, or with one that differs from it in up to `slack` shingles.

        A row that does has its first common shingle at place i here and j there with enough shingles after both.
        """
        n = len(ordered)
        low, high = -(-t * (n - slack) // 100), 100 * (n + slack) // t
        enough = -(-(t * (n + low) - 100 * slack) // (100 + t))
        i, at = self._found(ordered[: max(0, min(n, n - enough + 1))])
        m = self.stretch[at + 1] - self.stretch[at]
        b, i = _ranges(self.stretch[at], m), np.repeat(i, m)
        highs = np.minimum(high, ((100 + t) * (n - i) + 100 * slack) // t - n)
        lows = np.maximum(low, -(-((100 + t) * self.place[b] + t * n - 100 * slack) // 100))
        live = (highs >= self.least[b]) & (lows <= self.most[b]) & (lows <= highs)
        b, lows, highs = b[live], lows[live], highs[live]
        begin, end = np.searchsorted(self.key, b << 32 | lows, "left"), np.searchsorted(self.key, b << 32 | highs, "right")
        return np.unique(self.row[_ranges(begin, end - begin)])

    def entries(self, tokens: np.ndarray) -> np.ndarray:
        """Rows of the whole lists of tokens."""
        _, at = self._found(tokens)
        begin, end = self.ends[self.stretch[at]], self.ends[self.stretch[at + 1]]
        return self.row[_ranges(begin, end - begin)]


def led(sets: Sets, asked: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """(leader and its followers, most shingles that one of them differs in) of the asked sets."""
    least = np.minimum.reduceat(mix(sets.tokens.view(U).copy()), sets.offsets[:-1])
    order = asked[np.lexsort((sets.n[asked], least[asked]))].tolist()
    group, slack = [], 0
    for r in order:
        if group:
            far = sets.n[group[0]] // FOLLOW
            if least[r] == least[group[0]] and abs(sets.n[r] - sets.n[group[0]]) <= far:
                d = len(np.setxor1d(sets.sorted(group[0]), sets.sorted(r), assume_unique=True))
                if d <= far:
                    group.append(r)
                    slack = max(slack, d)
                    continue
            yield group, slack
        group, slack = [r], 0
    if group:
        yield group, slack


class Forest:
    def __init__(self, labels: np.ndarray):
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[of]

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.up[rows]
        while len(at) and (self.up[at] != at).any():
            at = self.up[at]
        self.up[rows] = at
        return at

    def root(self, row: int) -> int:
        return int(self.roots(np.array([row]))[0])

    def join(self, a: int, b: int) -> None:
        self.up[max(a, b)] = min(a, b)


def search(sets: Sets, labels: np.ndarray, asked: np.ndarray, held: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Links (asked row, held row) that join all components which a pair of an asked and a held set at the threshold joins.

    `labels` say what is joined already. A link is given for each two components that meet, not for each pair.
    """
    forest, whole, others, most = Forest(labels), Lists(sets, held), None, 0
    place, links = np.full(len(sets.n), -1), []
    for number, (group, slack) in enumerate(led(sets, asked), 1):
        members = np.array(group)
        own = forest.roots(members)
        alone = (own == own[0]).all()
        lists = others if others is not None and alone and own[0] == forest.root(most) else whole
        leader = group[0]
        rows = lists.candidates(sets.ordered(leader), slack, t)
        rows = rows[rows != leader] if len(group) == 1 else rows
        if alone and len(rows):
            rows = rows[forest.roots(rows) != own[0]]
        if len(rows):
            counts = sets.shared(leader, rows)
            place[rows] = np.arange(len(rows))
            for r in group:
                same = counts
                if r != leader:
                    same = counts.copy()
                    for sign, more, less in ((1, r, leader), (-1, leader, r)):
                        at = place[lists.entries(np.setdiff1d(sets.sorted(more), sets.sorted(less), assume_unique=True))]
                        np.add.at(same, at[at >= 0], sign)
                near = rows[(100 + t) * same >= t * (sets.n[r] + sets.n[rows])]
                roots, first = np.unique(forest.roots(near), return_index=True)
                for root, s in zip(roots.tolist(), near[first].tolist(), strict=True):
                    mine, root = forest.root(r), forest.root(root)
                    if mine != root:
                        forest.join(mine, root)
                        links.append((r, s))
            place[rows] = -1
        if number & (number - 1) == 0:  # after 1, 2, 4, ... groups: lists of what the largest component doesn't hold
            roots = forest.roots(held)
            common, n = np.unique(roots, return_counts=True)
            if 2 * n.max() > len(held):
                most = int(common[n.argmax()])
                others = Lists(sets, held[roots != most])
    return links


#: What a row of a block is there for.
BOTH, HELD, ASKED = 0, 1, 2


def _searcher(threshold: int):
    def run(block: pa.Table) -> pa.Table:
        node, role = block.column("node").to_numpy(), block.column("role").to_numpy()
        lists = block.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sets = Sets(lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py())
        found = search(sets, block.column("c").to_numpy(), np.flatnonzero(role != HELD), np.flatnonzero(role != ASKED), threshold)
        a, b = [node[x] for x, _ in found], [node[x] for _, x in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _size_and_place(threshold: int):
    """Whether sizes and places of a common shingle let two sets reach the threshold: (node, n, pos) beside (node2, n2, pos2)."""
    enough = F.lit(100 + threshold) * F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= threshold * (F.col("n") + F.col("n2"))
    return (100 * F.least("n", "n2") >= threshold * F.greatest("n", "n2")) & enough


def spanned(n: np.ndarray, pos: np.ndarray, bits: np.ndarray, side: np.ndarray, t: int) -> tuple[list[int], list[int]]:
    """Pairs of rows that join all which sizes, places and bitmaps leave of a cell; `n` ascends.

    Rows of two sides meet across them, those of one side each other. A row that a component's first row leaves is not
    looked at beside the others of it.
    """
    label, low, across = np.arange(len(n)), np.searchsorted(100 * n, t * n), len(n) > 0 and (side != side[0]).any()
    a, b = [], []
    for i in range(1, len(n)):
        rows = np.arange(low[i], i)
        total = n[i] + n[rows]
        live = (100 + t) * np.minimum(n[i] - pos[i], n[rows] - pos[rows]) >= t * total
        if across:
            live &= side[rows] != side[i]
        rows = rows[live]
        first = label[rows] == rows
        for part in (rows[first], rows[~first]):
            part = part[label[part] != label[i]]
            for at in range(0, len(part), 1 << 12):
                near = part[at : at + (1 << 12)]
                differ = np.bitwise_count(bits[near] ^ bits[i]).sum(1, dtype=np.int64)
                total = n[i] + n[near]
                near = near[(100 + t) * (total - differ) >= 2 * t * total]
                roots, at_root = np.unique(label[near], return_index=True)
                for root, j in zip(roots.tolist(), near[at_root].tolist(), strict=True):
                    mine = label[i]
                    if root != mine:
                        a.append(j)
                        b.append(i)
                        label[label == max(root, mine)] = min(root, mine)
    return a, b


def _in_cells(large: DataFrame, bits: DataFrame, work: Workspace, threshold: int) -> DataFrame:
    """Candidates (a, b) that join, in each larger bucket, the members which the filters leave each other."""

    def run(block: pa.Table) -> pa.Table:
        k, x, y, side, node, n, pos = (block.column(c).to_numpy() for c in ("k", "x", "y", "side", "node", "n", "pos"))
        words, start, size = _flat(block.column("bits"))
        order = np.lexsort((n, y, x, k))
        new = np.any([c[order][1:] != c[order][:-1] for c in (k, x, y)], axis=0)
        a, b = [], []
        for rows in np.split(order, np.flatnonzero(new) + 1):
            found = spanned(n[rows], pos[rows].astype(np.int64), folded(words, start[rows], size[rows]), side[rows], threshold)
            a.append(node[rows[found[0]]])
            b.append(node[rows[found[1]]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    heavy = F.when(F.col("wide"), F.col("n") / 4).otherwise(F.lit(0)) + 8 * BITMAP_WORDS + 48
    grid = large.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("g"), F.sum(heavy).alias("heavy"))
    grid = work.write(grid, "grid")
    bins = max(1, int((grid.agg(F.sum(F.col("heavy") * F.col("g"))).first()[0] or 0) // CELLS_BYTES))
    own, other = F.pmod(F.xxhash64("node"), F.col("g")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    dealt = large.join(grid.select("k", "g"), "k").join(bits, ["node", "wide"]).select("k", own.alias("side"), other.alias("other"), "node", "n", "pos", "bits")
    dealt = dealt.select("k", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "node", "n", "pos", "bits")
    found = dealt.groupBy(F.pmod(F.xxhash64("k", "x", "y"), F.lit(bins)).alias("bin")).applyInArrow(run, "a bigint, b bigint")
    found = work.write(found.distinct(), "joined-cells")
    work.drop(grid)
    return found


def candidates(classes: DataFrame, work: Workspace, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, members, bits): candidate edges (a, b) whose components hold every pair at the threshold, (k, wide, node, n, pos) of the larger buckets and their bitmaps."""
    tokens = classes.select("node", "n", F.posexplode("prefix").alias("pos", "k"))
    buckets = tokens.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = work.write(buckets, "buckets")
    members = work.write(tokens.join(buckets, "k").select("k", "node", "n", "pos", "size"), "members")
    work.drop(buckets)
    small = members.where(F.col("size") <= SMALL).select("k", "node", "n", "pos")
    other = small.select("k", *[F.col(c).alias(c + "2") for c in ("node", "n", "pos")])
    small_pairs = work.write(small.join(other, "k").where(F.col("node") < F.col("node2")).where(_size_and_place(threshold)).select("node", "node2", "n", "n2").distinct(), "pairs")
    short = classes.select("node", "bits")
    pairs = small_pairs.join(short, "node").join(short.select(F.col("node").alias("node2"), F.col("bits").alias("bits2")), "node2")
    differ = " + ".join(f"bit_count(bits[{i}] ^ bits2[{i}])" for i in range(BITMAP_WORDS))
    near = pairs.where(f"{100 + threshold} * (n + n2 - ({differ})) >= {2 * threshold} * (n + n2)").select(F.col("node").alias("a"), F.col("node2").alias("b"))
    near = work.write(near, "near")
    work.drop(small_pairs)
    # two long sets whose sizes allow the threshold are in one range of sizes or in neighbouring ones, and so in one bucket
    of = F.floor(F.log("n") / max(1e-3, (1 + 1e-9) * math.log(100 / threshold)))
    ranges = classes.where(F.size("long") > 0).select(F.explode(F.array(of, of + 1)).alias("of"), "node", "n")
    large = members.where(F.col("size") > SMALL).select("k", F.lit(False).alias("wide"), "node", "n", "pos")
    large = work.write(large.unionByName(ranges.select(F.xxhash64(F.lit("long"), "of").alias("k"), F.lit(True).alias("wide"), "node", "n", F.lit(0).alias("pos"))), "large")
    work.drop(members)
    bits = short.withColumn("wide", F.lit(False)).unionByName(classes.where(F.size("long") > 0).select("node", F.col("long").alias("bits"), F.lit(True).alias("wide")))
    bits = work.write(bits.join(large.select("node", "wide").distinct(), ["node", "wide"], "left_semi"), "bits")
    edges = work.write(near.unionByName(_in_cells(large, bits, work, threshold)).distinct(), "edges")
    work.drop(near)
    return edges, large, bits


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, where each row's begin, how many) of a column of bitmaps."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    return lists.flatten().to_numpy().view(U), offsets[:-1], np.diff(offsets)


def partners(n: np.ndarray, pos: np.ndarray, c: np.ndarray, bits: np.ndarray, asked: np.ndarray, held: np.ndarray, t: int) -> np.ndarray:
    """The asked rows that sizes, places and bitmaps leave a held row of another component."""
    out = []
    for i in range(0, len(asked), 64):
        a = asked[i : i + 64]
        total, rest = n[a][:, None] + n[held], np.minimum((n - pos)[a][:, None], (n - pos)[held])
        near = (c[a][:, None] != c[held]) & (100 * np.minimum(n[a][:, None], n[held]) >= t * np.maximum(n[a][:, None], n[held])) & ((100 + t) * rest >= t * total)
        x, y = np.nonzero(near)
        for j in range(0, len(x), 1 << 16):
            part = slice(j, j + (1 << 16))
            differ = np.bitwise_count(bits[a[x[part]]] ^ bits[held[y[part]]]).sum(1, dtype=np.int64)
            far = (100 + t) * (total[x[part], y[part]] - differ) < 2 * t * total[x[part], y[part]]
            near[x[part][far], y[part][far]] = False
        out.append(a[near.any(1)])
    return np.concatenate(out) if out else asked


def _with_partners(large: DataFrame, bits: DataFrame, work: Workspace, threshold: int) -> DataFrame:
    """(k, node) of (k, wide, node, c, n, pos) with a member of another component in the bucket that the filters leave."""

    def run(block: pa.Table) -> pa.Table:
        node, n, pos, c, asked = (block.column(x).to_numpy() for x in ("node", "n", "pos", "c", "asked"))
        rows = partners(n, pos.astype(np.int64), c, folded(*_flat(block.column("bits"))), np.flatnonzero(asked == 1), np.flatnonzero(asked == 0), threshold)
        return pa.table({"k": pa.array(block.column("k").to_numpy()[rows], pa.int64()), "node": pa.array(node[rows], pa.int64())})

    mixed = large.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    mixed = work.write(mixed.select("k", F.ceil(F.col("m") / CELL).cast("int").alias("g")), "mixed")
    dealt = large.join(mixed, "k").join(bits, ["node", "wide"])
    own, each = F.pmod(F.xxhash64("node"), F.col("g")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    rest = ["node", "n", "pos", "c", "bits"]
    held = dealt.select("k", own.alias("x"), each.alias("y"), F.lit(0).alias("asked"), *rest)
    asked = dealt.select("k", each.alias("x"), own.alias("y"), F.lit(1).alias("asked"), *rest)
    found = held.unionByName(asked).groupBy("k", "x", "y").applyInArrow(run, "k bigint, node bigint")
    return work.write(found.distinct(), "partners")


def _wide(rows: DataFrame, edges: DataFrame, large: DataFrame, bits: DataFrame, sets: DataFrame, work: Workspace, threshold: int) -> DataFrame:
    """Links of families wider than a block; `rows` is (family, node, n)."""
    inside = edges.join(rows.select(F.col("node").alias("b")), "b", "left_semi")
    pairs = inside.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    known = sets.select(F.col("node").alias("id"), "shingles")
    found = work.write(_verified(work.write(pairs, "first"), known, threshold), "first-links")
    parts = work.write(components(found, work), "first-parts")
    rows = work.write(rows.join(parts.withColumnRenamed("id", "node"), "node", "left").select("family", "node", "n", F.coalesce("component", "node").alias("c")), "wide")
    pair_keys = inside.select(F.xxhash64("a", "b").alias("k"), F.explode(F.array("a", "b")).alias("node"))  # a candidate pair is a bucket of its own
    kept = _with_partners(large.join(rows.select("node", "c"), "node"), bits, work, threshold)
    apart = rows.join(kept.unionByName(pair_keys), "node").select("family", "k", "node", "c", "n")
    apart = work.write(apart, "apart")
    as_one = apart.select("family", F.lit(None).cast("bigint").alias("k"), "node", "c", "n").distinct()
    both = _blocks(as_one, "family").unionByName(_blocks(apart, "family", "k"))
    both = both.withColumn("work", F.col("s") * F.col("asked")).withColumn("whole", F.col("k").isNull())
    ways = both.groupBy("family").agg(F.sum(F.when(F.col("whole"), F.col("work"))).alias("together"), F.sum(F.when(~F.col("whole"), F.col("work"))).alias("apart"))
    chosen = both.join(ways.select("family", (F.col("together") <= F.col("apart")).alias("one")), "family").where(F.col("whole") == F.col("one")).where("rb > 0")
    chosen = work.write(chosen.select("family", "k", "top", "mb", "rb"), "grids")
    dealt = apart.join(chosen.where("k IS NOT NULL"), ["family", "k"]).select("family", "k", "node", "c", "top", "mb", "rb")
    dealt = dealt.unionByName(as_one.drop("k").join(chosen.where("k IS NULL"), "family").select("family", "k", "node", "c", "top", "mb", "rb")).join(sets, "node")
    own = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    held = dealt.select("family", "k", (own % F.col("mb")).cast("int").alias("x"), each("rb").alias("y"), F.lit(HELD).alias("role"), "node", "c", "shingles")
    asked = dealt.where("c <> top").select("family", "k", each("mb").alias("x"), (own % F.col("rb")).cast("int").alias("y"), F.lit(ASKED).alias("role"), "node", "c", "shingles")
    more = held.unionByName(asked).groupBy("family", "k", "x", "y").applyInArrow(_searcher(threshold), "a bigint, b bigint")
    return found.unionByName(work.write(more, "wide-links"))


def links(docs: DataFrame, classes: DataFrame, edges: DataFrame, large: DataFrame, bits: DataFrame, levels, work: Workspace, shingle: int, threshold: int, block: int) -> DataFrame:
    """Links (a, b) between classes (node, n, h1, h2, id) that connect every component of their candidates; `docs` is (id, text)."""
    families = components(edges, work)
    families = families.unionByName(families.select(F.col("component").alias("id"), "component").distinct())
    families = families.select(F.col("id").alias("node"), F.col("component").alias("family"))
    rows = work.write(families.join(classes, "node"), "families")
    sizes = work.write(rows.groupBy("family").agg(F.sum("n").alias("s")), "sizes")
    fits = F.col("s") <= block
    total = sizes.where(fits).agg(F.sum("s")).first()[0] or 0
    bins = max(1, -(-total // block))
    dealt = F.when(fits, F.pmod(F.xxhash64("family"), F.lit(bins)))  # null: in a family wider than a block
    rows = work.write(rows.join(sizes, "family").select("family", "node", "n", "h1", "h2", "id", dealt.alias("x")), "dealt")
    sets = _ordered_sets(picked(docs, rows.select("id"), work), levels, shingle)
    sets = work.write(sets.join(rows.select("id", "h1", "h2", "node", "x"), ["id", "h1", "h2"]).select("x", "node", "shingles"), "sets")
    fit = sets.where("x IS NOT NULL").select("x", "node", F.col("node").alias("c"), F.lit(BOTH).alias("role"), "shingles")
    found = work.write(fit.groupBy("x").applyInArrow(_searcher(threshold), "a bigint, b bigint"), "links")
    wide = rows.where("x IS NULL").select("family", "node", "n")
    if not wide.isEmpty():
        found = found.unionByName(_wide(wide, edges, large, bits, sets.where("x IS NULL").select("node", "shingles"), work, threshold))
    work.drop(sets)
    return found


def jaccard_join(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(key, n_shingles, component_id) of each row of docs: the smallest key that links at `threshold` hundredths reach."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{key} is {kind.simpleString()}, not an integer")
    work = Workspace(spark, "join", release=True)
    rows = docs.select(docs[key].cast("bigint").alias("id"), docs[text].alias("text"))
    levels = spark.sparkContext.broadcast(rarity(rows, work, shingle))
    whole = work.write(profiles(rows, levels, shingle, threshold), "profiles")
    name, nonempty = ["n", "h1", "h2"], "n > 0 AND id IS NOT NULL"
    wide = whole.where(nonempty).groupBy(*name).agg(F.min("id").alias("id"), F.first("bits").alias("bits"), F.first("long").alias("long"), F.first("prefix").alias("prefix"))
    wide = work.write(wide.withColumn("node", F.monotonically_increasing_id()), "classes")
    signed = work.write(whole.select("id", *name), "signed")  # what is used beyond the candidates
    work.drop(whole)
    edges, large, bits = candidates(wide, work, threshold)
    classes = work.write(wide.select("node", "id", *name), "names")
    work.drop(wide)
    found = links(rows, classes, edges, large, bits, levels, work, shingle, threshold, block)
    some = signed.where(nonempty)

    several = some.groupBy("id").agg(F.min(F.struct(*name)).alias("least"), F.max(F.struct(*name)).alias("most")).where("least <> most").select("id")
    several = work.write(several, "several")
    if not several.isEmpty():  # the classes of one key's sets are linked through it
        own = some.select("id", *name).join(several, "id", "left_semi").distinct().join(classes.select(*name, "node"), name)
        own = work.write(own.select("id", "node"), "own")
        found = found.unionByName(own.join(own.groupBy("id").agg(F.min("node").alias("a")), "id").where("node > a").select("a", F.col("node").alias("b")))
    parts = work.write(components(found, work), "parts")
    parts = parts.unionByName(parts.select(F.col("component").alias("id"), "component").distinct()).withColumnRenamed("id", "node")
    ids = parts.join(classes.select("node", "id", *name), "node")
    least = ids.groupBy("component").agg(F.min("id").alias("least"))
    joined = work.write(ids.join(least, "component").select(*name, "least"), "joined")
    named = classes.select(*name, "id").join(joined, name, "left").select(*name, F.coalesce("least", "id").alias("component"))
    full = signed.where("n > 0").select("id", *name).join(named, name, "left").select("id", "n", "component")
    out = full.unionByName(signed.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).cast(kind).alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, table(spark, sf_dir, "documents"), shingle=4, threshold=85)
