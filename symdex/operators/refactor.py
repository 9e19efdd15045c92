"""Text edits of single documents, and folding ranges. Places are 0-based lines and columns; an edit replaces a range."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from symdex.facts import Facts
from symdex.functions import relational as R

Edit = tuple[int, int, int, int, str]
_NAME = re.compile(r"[a-z_]\w*")
_WORDS = frozenset("alias and begin break case class def do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split())


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def _method_around(lines: list[str], at: int) -> tuple[int, int] | None:
    """First and last line of the method around a line, by the indent of its def and end."""
    for i in range(at, -1, -1):
        if re.match(r"^\s*def\b", lines[i]):
            for j in range(i + 1, len(lines)):
                if lines[j].strip() == "end" and _indent(lines[j]) == _indent(lines[i]):
                    return (i, j) if j >= at else None
            return None
    return None


def extract_method(text: str, first: int, last: int, name: str = "extracted_method") -> list[Edit]:
    """Lines become a method after the one around them; names that were set before and are used in them are its parameters."""
    lines = text.split("\n")
    if not 0 <= first <= last < len(lines):
        return []
    around = _method_around(lines, first)
    body = lines[first : last + 1]
    start = around[0] if around else 0
    set_before = {m for line in lines[start + 1 : first] for m in re.findall(r"^\s*([a-z_]\w*)\s*(?:\|\||&&|[+\-*/])?=(?![=~>])", line)}
    if around and (m := re.search(r"\((.*)\)", lines[start])):
        set_before |= set(_NAME.findall(re.sub(r"=[^,]*", "", m[1])))
    used = [n for n in dict.fromkeys(_NAME.findall("\n".join(body))) if n in set_before and n not in _WORDS]
    call = f"{name}({', '.join(used)})" if used else name
    pad = _indent(lines[start]) if around else ""
    shift = len(_indent(next((x for x in body if x.strip()), "")))
    inner = [pad + "  " + x[min(shift, len(_indent(x))) :] if x.strip() else x for x in body]
    after = around[1] if around else last
    method = "\n\n" + "\n".join([f"{pad}def {call}", *inner, f"{pad}end"])
    at = len(lines[after])
    return [(first, 0, last, len(lines[last]), _indent(body[0]) + call), (after, at, after, at, method)]


def extract_variable(text: str, line: int, begin: int, end: int, name: str = "extracted") -> list[Edit]:
    """An expression gets a name on a line of its own before."""
    lines = text.split("\n")
    if not (0 <= line < len(lines) and 0 <= begin < end <= len(lines[line])):
        return []
    return [(line, 0, line, 0, f"{_indent(lines[line])}{name} = {lines[line][begin:end].strip()}\n"), (line, begin, line, end, name)]


def extract_constant(text: str, line: int, begin: int, end: int, name: str = "EXTRACTED") -> list[Edit]:
    """A literal becomes a constant of the class or module around it, or of the file."""
    lines = text.split("\n")
    if not (0 <= line < len(lines) and 0 <= begin < end <= len(lines[line])):
        return []
    at = next((i for i in range(line, -1, -1) if re.match(r"^\s*(class|module)\b", lines[i])), -1)
    pad = _indent(lines[at]) + "  " if at >= 0 else ""
    return [(at + 1, 0, at + 1, 0, f"{pad}{name} = {lines[line][begin:end].strip()}\n"), (line, begin, line, end, name)]


def inline_variable(text: str, line: int) -> list[Edit]:
    """A variable that is set on the line and not set again is replaced by its value where it is used in its method."""
    lines = text.split("\n")
    m = re.match(r"^\s*([a-z_]\w*)\s*=(?![=~>])\s*(.+?)\s*$", lines[line]) if 0 <= line < len(lines) else None
    if not m:
        return []
    around = _method_around(lines, line)
    last = around[1] if around else len(lines) - 1
    word = re.compile(rf"(?<![\w@$:.]){m[1]}(?![\w?!:])")
    rest = [(i, x) for i in range(line + 1, last + 1) for x in word.finditer(lines[i])]
    if any(re.match(rf"^\s*{m[1]}\s*(\|\||&&|[+\-*/])?=(?![=~>])", lines[i]) for i in range(line + 1, last + 1)):
        return []
    value = f"({m[2]})" if re.search(r"\s[-+*/&|<>=?]", m[2]) else m[2]
    return [(line, 0, line + 1, 0, ""), *[(i, x.start(), i, x.end(), value) for i, x in rest]]


def convert_string_style(text: str, line: int, col: int) -> list[Edit]:
    """The string at a place changes its quotes, where that keeps what it says."""
    lines = text.split("\n")
    if not 0 <= line < len(lines):
        return []
    for m in re.finditer(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'", lines[line]):
        if m.start() <= col < m.end():
            inside = m[1] if m[1] is not None else m[2]
            if m[1] is not None and (re.search(r"#\{|\\[^\"\\]|'", inside)):
                return []
            if m[2] is not None and ('"' in inside or "#{" in inside):
                return []
            put = "'" + inside.replace('\\"', '"') + "'" if m[1] is not None else '"' + inside.replace("\\'", "'") + '"'
            return [(line, m.start(), line, m.end(), put)]
    return []


def apply_edits(text: str, edits: list[Edit]) -> str:
    """The text after edits; all places are of the text before them."""
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    at = lambda line, col: min(len(text), starts[min(line, len(lines))] + col)
    for a, b, c, d, put in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        text = text[: at(a, b)] + put + text[at(c, d) :]
    return text


def folding_ranges(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, kind): blocks by their end, runs of comments, and heredocs."""
    lines, out, stack, comment, i = text.split("\n"), [], [], None, 0
    while i < len(lines):
        line = lines[i].strip()
        if line.startswith("#"):
            comment = i if comment is None else comment
        else:
            if comment is not None and i - comment > 1:
                out.append((comment, i - 1, "comment"))
            comment = None
            if m := re.search(r"<<[~-]?([\"'`]?)([A-Z_]+)\1", line):
                end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() == m[2]), None)
                if end is not None:
                    out.append((i, end, "heredoc"))
                    i = end
            elif re.match(r"^end\b", line):
                if stack and i > (begin := stack.pop()):
                    out.append((begin, i, "region"))
            elif re.match(r"^(class|module|def|if|unless|while|until|case|for|begin)\b", line) and not re.search(r"\bend\s*$", line) and not re.match(r"^def\s+\S+(\(.*?\))?\s*=\s", line) or re.search(r"\bdo\b\s*(\|[^|]*\|)?$", line):
                stack.append(i)
        i += 1
    if comment is not None and len(lines) - comment > 1:
        out.append((comment, len(lines) - 1, "comment"))
    return sorted(out)


KINDS: dict[str, Callable[..., list[Edit]]] = {"extract_method": extract_method, "extract_variable": extract_variable, "extract_constant": extract_constant, "inline_variable": inline_variable, "convert_string_style": convert_string_style}


def refactor(documents: DataFrame, kind: str, **arguments) -> DataFrame:
    """(path, text): each document of (path, text) after one kind of edit with the same arguments."""
    f = KINDS[kind]

    def run(batches):
        for batch in batches:
            texts = [t if t is None else apply_edits(t, f(t, **arguments)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return documents.select("path", "text").mapInArrow(run, "path string, text string")


def documents_of(f: Facts, path: str | None = None) -> DataFrame:
    """(path, text) of the workspace's files, or of one, put together from their lines."""
    files = f.workspace() if path is None else f.file(path)
    return f.lines.join(files, "file_id").groupBy("path").agg(R.listed("text", ["n"], "\n").alias("text"))


def refactor_file(f: Facts, path: str, start_line: int, end_line: int, kind: str) -> DataFrame:
    """One file after an edit of 1-based lines: their extraction into a method, or of the first one's expression into a variable."""
    docs = documents_of(f, path)
    if kind == "extract_method":
        return refactor(docs, kind, first=start_line - 1, last=end_line - 1)

    def run(batches):
        for batch in batches:
            texts = []
            for t in batch.column(1).to_pylist():
                line = t.split("\n")[start_line - 1] if start_line <= t.count("\n") + 1 else ""
                begin = len(line) - len(line.lstrip())
                texts.append(apply_edits(t, extract_variable(t, start_line - 1, begin, len(line.rstrip()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return docs.mapInArrow(run, "path string, text string")


def folds(documents: DataFrame) -> DataFrame:
    """(path, first_line, last_line, kind) of each document."""

    def run(batches):
        for batch in batches:
            rows = [(p, *x) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in folding_ranges(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], ["path", "first_line", "last_line", "kind"])

    return documents.select("path", "text").mapInArrow(run, "path string, first_line int, last_line int, kind string")
