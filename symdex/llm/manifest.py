"""Operator 11: a Merkle tree over a table, with an authentication path for each row that a changed row fails.

1. Each row's leaf is a digest of its fields. Leaves are sorted by (source, id) over range partitions; a leaf's place in
   its source is its place in its partition plus what earlier partitions hold of the source, so no task holds a source.
2. A source's leaves are dealt to aligned blocks of 3^(HEIGHT * STACKED) leaves. The digests of blocks are leaves of the
   next tier, until one node, the subroot, is left of each source. Subroots are the leaves of one more such tree.
3. Paths come from above: the path of a block's own node is known before the block's leaves are traversed. In a block the
   fractal traversal holds STACKED subtrees of HEIGHT levels along the current leaf, and below the top one a desired
   subtree each, the next to its right, which grows by one leaf a step and is whole when the traversal gets there. So
   successive paths come out with nodes of a few subtrees held, and the upper path is appended to each.

A digest is the SHA-256 of its inputs, digests as lower-case hexadecimal text. A run of nodes at the end of a level may
have one or two nodes, and is hashed all the same; a source of one row has its leaf as subroot, a table of one source its
subroot as root, and neither adds a level to a path.

A field is `-` if it is null, else its length in bytes, a colon and its text. Leaves of a source ascend by id, null
first, and rows that repeat an id by leaf; equal rows are leaves of their own and each gets its own path. A null source
is a source, before all others; an empty one is another. A row with a null id is never tampered with. An empty table
gives no rows. Columns beyond the fields are not looked at. A text of any length is one digest, made where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from symdex.llm.shared import Workspace, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, levels of a stacked subtree, and stacked subtrees of a block.
ARITY, HEIGHT, STACKED = 3, 2, 3
#: The path of a leaf as text: for each level the siblings before and after, parted by the first sign, ended by the second.
BETWEEN, END = ".", ";"


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path give."""
    for level in path.split(END)[:-1]:
        before, _, after = level.partition(BETWEEN)
        leaf = digest((before, leaf, after))
    return leaf


def siblings(path: str) -> str:
    """All siblings of a path from left to right, level by level."""
    return path.replace(BETWEEN, "").replace(END, "")


class Subtree:
    """Nodes of the levels from `low` up to below `high`, over leaves from `first` on that come one at a time.

    Of lower levels only runs that aren't complete are held.
    """

    def __init__(self, first: int, low: int, high: int):
        self.first, self.low, self.high, self.root = first, low, high, None
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.nodes: list[list[str]] = [[] for _ in range(high - low)]

    def add(self, node: str, level: int = 0) -> None:
        while level < self.high:
            if level >= self.low:
                self.nodes[level - self.low].append(node)
            run = self.open[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node, level = digest(run), level + 1
            run.clear()
        self.root = node

    def finish(self) -> None:
        """Close runs that no more leaves complete."""
        for level, run in enumerate(self.open):
            if run:
                node = digest(run)
                run.clear()
                self.add(node, level + 1)


def root_of(leaves: Sequence[str], levels: int) -> str:
    tree = Subtree(0, levels, levels)
    for x in leaves:
        tree.add(x)
    tree.finish()
    return tree.root


def paths(leaves: Sequence[str], levels: int, height: int = HEIGHT) -> Iterator[str]:
    """The path of each leaf in turn, up to the node `levels` above."""
    spans = [(low, min(low + height, levels)) for low in range(0, levels, height)]
    existing = [Subtree(0, *s) for s in spans]
    for tree in existing:
        for x in leaves[: ARITY**tree.high]:
            tree.add(x)
        tree.finish()
    desired = [Subtree(ARITY**high, low, high) for low, high in spans[:-1]]
    for j in range(len(leaves)):
        out = []
        for tree in existing:
            for level, nodes in enumerate(tree.nodes, tree.low):
                i = (j - tree.first) // ARITY**level
                run = i - i % ARITY
                out += (*nodes[run:i], BETWEEN, *nodes[i + 1 : run + ARITY], END)
        yield "".join(out)
        for k, tree in enumerate(desired):
            span = ARITY**tree.high
            at = tree.first + j % span
            if at < len(leaves):
                tree.add(leaves[at])
            if (j + 1) % span == 0:
                tree.finish()
                existing[k], desired[k] = tree, Subtree(tree.first + span, tree.low, tree.high)


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*parts), 256)


class Tree:
    """One tree a group over the rows of `nodes` (g, digest and others), in the order of columns; g is text, never null.

    `tiers[0]` has the rows with their place `idx` in the group and the group's size n, each further one the nodes of
    its blocks; the last has one node a group.
    """

    def __init__(self, work: Workspace, nodes: DataFrame, order: Sequence[str], height: int = HEIGHT, stacked: int = STACKED):
        self.work, self.height, self.depth = work, height, height * stacked
        by = ["g", *order]
        rows = work.write(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "sorted")
        rows = rows.withColumn("p", F.shiftright("at", 33))
        parts = rows.groupBy("g", "p").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("m"))
        before = W.partitionBy("g").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
        places = parts.select("g", "p", F.col("low"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(W.partitionBy("g")).alias("n"))
        places = work.write(places, "places")
        first = rows.join(places, ["g", "p"]).withColumn("idx", F.expr("before + at - low")).drop("p", "low", "before", "at")
        self.tiers = [first]
        while True:
            up = work.write(self._roots(self.tiers[-1]), "tier")
            self.tiers.append(up)
            if up.where("n > 1").isEmpty():
                break

    def _dealt(self, nodes: DataFrame) -> DataFrame:
        """Nodes with their block and the levels of its tree: none where the group has one node."""
        levels = F.lit(0)
        for k in range(self.depth):
            levels = levels + (F.col("n") > ARITY**k).cast("int")
        return nodes.withColumn("block", F.expr(f"idx DIV {ARITY**self.depth}")).withColumn("levels", levels)

    def _roots(self, nodes: DataFrame) -> DataFrame:
        size = ARITY**self.depth

        def root(key, block):
            block = block.sort_by("idx")
            n = block.column("n")[0].as_py()
            top = root_of(block.column("digest").to_pylist(), block.column("levels")[0].as_py())
            return pa.table({"g": pa.array([key[0].as_py()]), "idx": pa.array([key[1].as_py()]), "n": pa.array([-(-n // size)]), "digest": pa.array([top])})

        rows = self._dealt(nodes).select("g", "block", "idx", "n", "levels", "digest")
        return rows.groupBy("g", "block").applyInArrow(root, "g string, idx bigint, n bigint, digest string")

    def proved(self, above: DataFrame, finish=None, schema: T.StructType | None = None) -> DataFrame:
        """The rows with their paths; `above` is (g, path, ...) of what stands above each group's last node.

        What `above` has besides g and path is carried down. `finish` makes the result of a block from its rows, its
        paths and the block's row from above; else (g, idx, path, ...) is given.
        """
        kept = [c for c in above.columns if c not in ("g", "path")]
        upper = above.select("g", F.lit(0).cast("bigint").alias("idx"), "path", *kept)
        for k in range(len(self.tiers) - 2, -1, -1):
            last = k == 0 and finish is not None
            upper = self._down(self.tiers[k], upper, finish if last else None, schema if last else upper.schema)
        return upper

    def _down(self, nodes: DataFrame, upper: DataFrame, finish, schema: T.StructType) -> DataFrame:
        height, names = self.height, [f.name for f in schema]

        def run(block, above):
            block, top = block.sort_by("idx"), above.slice(0, 1).to_pylist()[0]
            levels = block.column("levels")[0].as_py()
            own = [p + top["path"] for p in paths(block.column("digest").to_pylist(), levels, height)]
            if finish:
                return finish(block, own, top)
            rest = {c: pa.array([top[c]] * len(own), pa.string()) for c in names if c not in ("g", "idx", "path")}
            return pa.table({"g": block.column("g"), "idx": block.column("idx"), "path": pa.array(own, pa.string())} | rest).select(names)

        return self._dealt(nodes).groupBy("g", "block").cogroup(upper.withColumnRenamed("idx", "block").groupBy("g", "block")).applyInArrow(run, schema)


def manifest(spark: SparkSession, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", fields: Sequence[str] = FIELDS, tampered: Column | None = None, with_path: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, and on request its path.

    `tampered` says of which rows the text lost its line breaks since the manifest was made; their path is folded from
    what they are now. Without it every row is verified as it is.
    """
    work = Workspace(spark, "manifest")
    now = {text: F.replace(text, F.lit("\n"), F.lit(""))}
    changed = F.when((F.lit(False) if tampered is None else tampered) & F.contains(F.col(text), F.lit("\n")), leaf([now.get(c, F.col(c)) for c in fields]))
    group = F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0"))  # null before all, in the order of bytes
    rows = docs.select(group.alias("g"), F.col(key).alias("id"), leaf([F.col(c) for c in fields]).alias("digest"), changed.alias("changed"))
    tree = Tree(work, rows, ["id", "digest"])
    subroots = tree.tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
    over = Tree(work, subroots, ["of"])
    top = over.tiers[-1].select("g", F.lit("").alias("path"), F.col("digest").alias("root"))
    named = T.StructType([T.StructField(c, T.StringType()) for c in ("g", "path", "subroot", "root")])

    def of_source(block: pa.Table, own: list[str], above: dict) -> pa.Table:
        return pa.table({"g": block.column("of"), "path": pa.array(own, pa.string()), "subroot": block.column("digest"), "root": pa.array([above["root"]] * len(own), pa.string())})

    above = work.write(over.proved(top, of_source, named), "sources")

    def of_row(block: pa.Table, own: list[str], above: dict) -> pa.Table:
        leaves, n = block.column("digest").to_pylist(), block.num_rows
        folded = [fold(now or was, p) for now, was, p in zip(block.column("changed").to_pylist(), leaves, own, strict=True)]
        columns = {
            key: block.column("id"), "leaf": block.column("digest"), "subroot": pa.array([above["subroot"]] * n, pa.string()), "root": pa.array([above["root"]] * n, pa.string()),
            "proof_sha256": pa.array([digest((siblings(p),)) for p in own], pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == above["root"] for x in folded], pa.bool_()),
        }
        return pa.table(columns | ({"path": pa.array(own, pa.string())} if with_path else {}))

    text_field = lambda c: T.StructField(c, T.StringType())
    out = [T.StructField(key, docs.schema[key].dataType), *map(text_field, ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType()), *([text_field("path")] if with_path else [])]
    return tree.proved(above, of_row, T.StructType(out))


def even_crc(key: str = "doc_id") -> Column:
    """Rows that the query tampers with: 2 divides the CRC-32 of the id in decimal."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, F.lit(False))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, table(spark, sf_dir, "documents"), tampered=even_crc())


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"


_SQL_ROW = " || ".join(_sql_field(c) for c in FIELDS[:-1])
_SQL_LEVEL = "SELECT g, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {t}) x WHERE m > 1 GROUP BY g, lvl, idx // 3"
_SQL_SIBLINGS = """SELECT o.k, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < o.idx // 3 ** t.lvl), '') || '|' || coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > o.idx // 3 ** t.lvl), '') AS s
FROM {o} o JOIN {t} t ON o.g = t.g AND t.idx // 3 = o.idx // CAST(3 ** (t.lvl + 1) AS BIGINT) JOIN (SELECT g, max(lvl) AS top FROM {t} GROUP BY g) m ON m.g = t.g AND t.lvl < m.top GROUP BY o.k, t.lvl""".replace("3 ** t.lvl", "CAST(3 ** t.lvl AS BIGINT)")
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce('1' || source, '0') AS g, sha256({_SQL_ROW} || {_sql_field("text")}) AS leaf,
sha256({_SQL_ROW} || {_sql_field("replace(text, chr(10), '')")}) AS cut,
xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y // 2, 3988292384 * (y % 2)))), 4294967295) AS crc FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
t(g, lvl, idx, h) AS (SELECT g, 0, idx, leaf FROM r UNION ALL {_SQL_LEVEL.format(t="t")}),
sub AS (SELECT g, max_by(h, lvl) AS subroot FROM t GROUP BY g),
s AS (SELECT g AS k, '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, subroot FROM sub),
u(g, lvl, idx, h) AS (SELECT g, 0, idx, subroot FROM s UNION ALL {_SQL_LEVEL.format(t="u")}),
low AS ({_SQL_SIBLINGS.format(o="r", t="t")}),
high AS ({_SQL_SIBLINGS.format(o="s", t="u")}),
path AS (SELECT k, list(s ORDER BY part, lvl) AS p FROM (SELECT k, 0 AS part, lvl, s FROM low UNION ALL SELECT r.k, 1, high.lvl, high.s FROM r JOIN high ON r.g = high.k) x GROUP BY k),
whole AS (SELECT doc_id, leaf, subroot, (SELECT max_by(h, lvl) FROM u) AS root, coalesce(p, []) AS p, CASE WHEN crc % 2 = 0 THEN cut ELSE leaf END AS now FROM r JOIN sub ON r.g = sub.g LEFT JOIN path ON path.k = r.k),
f AS (SELECT *, list_reduce(list_prepend(now, p), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(p, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
