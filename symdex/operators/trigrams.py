"""A trigram index of source lines, and what a search needs of it.

`trigrams` has (gram, file_id): each three characters in a row that a file has on a line, letters A-Z in lower case. A
search for a literal or a small pattern names trigrams that each line that matches must have; only files that have all
of them are read. The index is a table of the facts, sorted by gram when it is saved, so a search reads few of its row groups.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.functions import relational as R
from symdex.functions.workdir import written

SIZE = 3
#: Pairs of a trigram and a file that a task holds before it gives them out.
HELD = 1 << 20


def made(lines: DataFrame) -> DataFrame:
    """(gram, file_id) of lines (file_id, text). A long line is taken as it is; a null one has none."""
    lower = {c: c + 32 for c in range(65, 91)}

    def run(batches):
        seen: dict[int, set[str]] = {}
        held = 0

        def given():
            for i, grams in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array([i] * len(grams), pa.int64())], ["gram", "file_id"])
            seen.clear()

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t is None or i is None:
                    continue
                own = seen.setdefault(i, set())
                before, t = len(own), t.translate(lower)
                own.update(map("".join, zip(t, t[1:], t[2:], strict=False)))
                held += len(own) - before
                if held >= HELD:
                    yield from given()
                    held = 0
        yield from given()

    return lines.select("file_id", "text").mapInArrow(run, "gram string, file_id bigint").distinct()


def index(f: Facts) -> DataFrame:
    """The stored index of the facts, made now if they have none."""
    return f.derived("trigrams", lambda: written(made(f.lines), "trigrams"))


def carried(before: Facts, after: Facts, changed: DataFrame) -> Facts:
    """`after` with the index of `before` brought up to date for some files (file_id), if it has one."""
    if not before.has("trigrams"):
        return after
    stay = before.trigrams.join(changed.select("file_id").distinct(), "file_id", "left_anti").select("gram", "file_id")
    return after.replaced(trigrams=stay.unionByName(made(after.lines.join(changed.select("file_id").distinct(), "file_id", "left_semi"))))


def of_literal(text: str) -> set[str]:
    text = text.translate(R._LOWER)
    return {text[i : i + SIZE] for i in range(len(text) - SIZE + 1)}


def runs_of(pattern: str) -> list[str]:
    """Texts that each line has which a small pattern of ^ $ . * + matches: characters in a row that can't be left out.

    A star leaves out what is before it; a plus says it once at least, and what follows needs not follow it at once.
    """
    out, now, i = [], "", 0
    while i < len(pattern):
        c, after = pattern[i], pattern[i + 1 : i + 2]
        if c in "^$.*+":
            out.append(now)
            now = ""
            i += 1
        elif after == "*":
            out.append(now)
            now = ""
            i += 2
        elif after == "+":
            out.append(now + c)
            now = c
            i += 2
        else:
            now += c
            i += 1
    return [t for t in [*out, now] if t]


def needed(query: str, use_regex: bool = False) -> set[str]:
    """Trigrams that a file must have to match; none if the query says too little, and then every file may match."""
    return {g for t in (runs_of(query) if use_regex else [query]) for g in of_literal(t)}


def candidates(f: Facts, grams: set[str]) -> DataFrame:
    """(file_id) of files that have all of some trigrams."""
    hit = index(f).where(F.col("gram").isin(*sorted(grams))).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return hit.where(F.col("n") == len(grams)).select("file_id")
