"""Ruby source cut into statements: strings, comments and heredocs are told from code before anything is matched.

`cover` gives a text of the same length in which everything that isn't code is blank, so that brackets and words can
be looked at alone; `statements` joins lines that belong together. Places are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_HEREDOC = re.compile(r"<<([~-]?)([\"'`]?)([A-Za-z_]\w*)\2")
_PERCENT = re.compile(r"%([qQwWiIrsx]?)([(\[{<|!/^])")
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: After one of these a slash begins a pattern and a percent sign a literal.
_BEFORE_VALUE = re.compile(r"(?:^|[=(,\[{|&!?:;~<>+\-*/]|\b(?:if|unless|while|until|when|and|or|not|return|in|then|else|elsif|puts|match|split|gsub|sub|scan))\s*$")


def cover(text: str) -> str:
    """The code of a text, with blanks for comments, heredocs, patterns and what is inside quotes. Interpolations count as text."""
    out, i, n = list(text), 0, len(text)
    pending: list[tuple[str, str]] = []  # heredocs that begin on this line

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    line_start = 0
    while i < n:
        c = text[i]
        if c == "\n":
            i += 1
            while pending:
                indent, word = pending.pop(0)
                end = re.compile(rf"^{'[ \t]*' if indent else ''}{word}[ \t]*\r?$", re.M).search(text, i)
                stop = end.end() if end else n
                blank(i, stop)
                i = stop if not end or stop >= n else stop + (text[stop : stop + 1] == "\n")
            line_start = i
            if text.startswith("=begin", i):
                end = re.compile(r"^=end\b.*$", re.M).search(text, i)
                stop = end.end() if end else n
                blank(i, stop)
                i = stop
            elif text.startswith("__END__", i) and text[i + 7 : i + 8] in ("", "\n", "\r"):
                blank(i, n)
                i = n
            continue
        if c == "#":
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif c in "\"'`":
            i = _quoted(text, i, c, blank)
        elif c == "<" and (m := _HEREDOC.match(text, i)) and (m[1] or m[3][0].isupper()) and not re.search(r"(?:\bclass|\w)\s*$", text[line_start:i]):
            pending.append((m[1], m[3]))
            blank(m.start(), m.end())
            out[i] = out[m.end() - 1] = '"'  # stands for a string
            i = m.end()
        elif c == "<" and (m := _HEREDOC.match(text, i)) and m[1] and not re.search(r"\bclass\s*$", text[line_start:i]):
            pending.append((m[1], m[3]))
            blank(m.start(), m.end())
            out[i] = out[m.end() - 1] = '"'
            i = m.end()
        elif c == "%" and (m := _PERCENT.match(text, i)) and _BEFORE_VALUE.search(text[line_start:i]):
            begin, i = i, _bracketed(text, m.end(), m[2], _CLOSERS.get(m[2], m[2]), i, blank)
            out[begin] = out[min(i, n) - 1] = '"'
        elif c == "/" and _BEFORE_VALUE.search(text[line_start:i]) and "/" in text[i + 1 : (text.find("\n", i) + 1 or n + 1) - 1]:
            k = i + 1
            while k < n and text[k] != "/" and text[k] != "\n":
                k += 2 if text[k] == "\\" else 1
            blank(i + 1, k)
            i = k + 1
        elif c == "?" and re.match(r"\?[^\s\w](?!\w)|\?\w(?!\w)", text[i : i + 3]) and re.search(r"[=(,\[]\s*$", text[line_start:i]):
            blank(i, i + 2)
            i += 2
        else:
            i += 1
    return "".join(out)


def _quoted(text: str, i: int, quote: str, blank) -> int:
    """The place after a quoted text that begins at i; quotes stay, the inside goes."""
    k, n = i + 1, len(text)
    while k < n and text[k] != quote:
        if text[k] == "\\":
            k += 2
        elif quote != "'" and text.startswith("#{", k):
            deep, k = 1, k + 2
            while k < n and deep:
                if text[k] in "\"'`":
                    k = _quoted(text, k, text[k], lambda a, b: None)
                    continue
                deep += (text[k] == "{") - (text[k] == "}")
                k += 1
        else:
            k += 1
    blank(i + 1, k)
    return k + 1


def _bracketed(text: str, k: int, opens: str, closes: str, start: int, blank) -> int:
    deep, n = 1, len(text)
    while k < n and deep:
        if text[k] == "\\":
            k += 2
            continue
        if text[k] == closes:
            deep -= 1
        elif text[k] == opens:
            deep += 1
        k += 1
    blank(start, k)
    return k


@dataclass
class Statement:
    """One statement: its code as written and as covered, where it begins, and the comment lines right before it."""

    said: str
    code: str
    start: int
    starts: list[int]
    doc: list[str] = field(default_factory=list)

    def place(self, at: int) -> tuple[int, int]:
        """1-based line and 0-based column of a place in the statement."""
        line = bisect_right(self.starts, self.start + at)
        return line, self.start + at - self.starts[line - 1]


_GOES_ON = re.compile(r"(?:[,+\-*/%&|^<>=(\[.\\]|&&|\|\||\b(?:and|or|not))\s*$")
_NO_GOING_ON = re.compile(r"(?:\|[^|]*\||\w[?!]|[*/]\s*\|)\s*$")
_BLOCK_BRACE = re.compile(r"(?:[\w)\]?!]|->|lambda|proc)\s*(?:\([^()]*\)\s*)?\{\s*(?:\|[^|]*\|)?\s*$")


def statements(text: str) -> list[Statement]:
    """All statements in order. A line goes on while brackets are open, after an operator, or before a leading dot."""
    code = cover(text)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    ends = [*(s - 1 for s in starts[1:]), len(text)]
    out: list[Statement] = []
    doc: list[str] = []
    row = 0
    while row < len(starts):
        line = code[starts[row] : ends[row]]
        if not line.strip():
            raw = text[starts[row] : ends[row]].strip()
            if raw.startswith("#"):
                doc.append(raw[1:].removeprefix(" "))
            elif not raw:
                doc = []
            row += 1
            continue
        first = row
        deep = _depth(line)
        while row + 1 < len(starts):
            here = code[starts[first] : ends[row]].rstrip()
            if _BLOCK_BRACE.search(here) and _depth(here) == 1 and not re.search(r"[=(,:]\s*\{\s*$", here):
                break
            nxt = code[starts[row + 1] : ends[row + 1]].strip()
            on = deep > 0 or (_GOES_ON.search(here) and not _NO_GOING_ON.search(here)) or re.match(r"(?:&?\.)[a-z_]", nxt)
            if not on:
                break
            row += 1
            deep += _depth(code[starts[row] : ends[row]])
        _cut(text, code, starts[first], ends[row], starts, out, doc)
        doc = []
        row += 1
    return out


def _depth(code: str) -> int:
    return sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")


def _cut(text: str, code: str, a: int, b: int, starts: list[int], out: list[Statement], doc: list[str]) -> None:
    """Cut a joined line at semicolons outside brackets."""
    deep, begin = 0, a
    for k in range(a, b + 1):
        c = code[k] if k < b else ";"
        deep += (c in "([{") - (c in ")]}")
        if (c == ";" and deep <= 0) or k == b:
            part = code[begin:k]
            lead = len(part) - len(part.lstrip())
            if part.strip():
                end = begin + len(part.rstrip())
                out.append(Statement(text[begin + lead : end], code[begin + lead : end], begin + lead, starts, doc))
                doc = []
            begin = k + 1


_KEYWORD = re.compile(r"(?<![\w.:@$?])(class|module|def|begin|case|for|if|unless|while|until|do|end|then)\b(?![:?!]|\s*=>)|\}|(?<=[\w)\]?!>])\s*\{\s*(?:\|[^|]*\|)?\s*$")
_VALUE_BEFORE = re.compile(r"(?:^|[=(\[,{|&!;]|\b(?:then|else|do|and|or|not|begin|ensure))\s*$")
_ENDLESS = re.compile(r"def\s+(?:self\.)?[\w?!]+(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*|\s+)=(?![=~>])")


def openings(code: str) -> list[str]:
    """What a statement opens and closes, in order: the opening word, or 'end'."""
    found: list[str] = []
    loop = False
    for m in _KEYWORD.finditer(code):
        word = m[1] or ("{" if "{" in m[0] else "}")
        before = code[: m.start()]
        if word in ("if", "unless", "while", "until"):
            if not _VALUE_BEFORE.search(before):
                continue  # a modifier
            loop = word in ("while", "until")
            found.append("block")
        elif word == "for":
            loop = True
            found.append("block")
        elif word == "do":
            if loop:
                loop = False
            else:
                found.append("block")
        elif word == "def":
            if not _ENDLESS.match(code, m.start()):
                found.append("def")
        elif word in ("class", "module"):
            if not before.strip():
                found.append(word)
        elif word in ("begin", "case", "{"):
            found.append("block")
        elif word == "end" or (word == "}" and _depth(code) < 0):
            found.append("end")
    return found
