"""Parsers of single files: locale files, signatures, routes, templates and Ruby.

Each takes a text and gives rows as dicts for the fact tables, without ids; `extract` gives them ids.
"""

from __future__ import annotations

import re

from symdex.sources.ruby_text import cover, openings, statements

# --- locale files

_KEY = re.compile(r"^\s*[\"']?&?([^\s:!*&\"'][^:]*?)[\"']?\s*:(.*)$")


def parse_locale(text: str) -> list[dict]:
    """Leaf keys with their values; the outermost key is the locale. The first indent is the unit of all."""
    unit, path, locale, rows = 0, {}, "en", []
    for raw in text.split("\n"):
        line = raw.rstrip(" \t\r")
        if not line or line.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        unit = unit or indent
        m = _KEY.match(line)
        if not m:
            continue
        level = indent // unit if unit else 0
        key, value = m[1].strip(" \t\"'"), m[2].strip(" \t")
        path = {k: v for k, v in path.items() if k < level} | {level: key}
        if level == 0:
            locale = key
        elif value and not value.startswith("#"):
            if value[0] in "\"'":
                value = value[1:].split(value[0], 1)[0]
            elif value[0] != "*":
                value = value.split(" #", 1)[0].rstrip(" \t")
            rows.append({"key": ".".join(path[k] for k in sorted(path) if k), "value": value or None, "locale": locale})
    return rows


# --- inflection

#: Plurals that follow no rule (fixed values).
IRREGULAR_PLURALS = {
    "people": "person", "children": "child", "data": "datum", "oxen": "ox", "men": "man", "women": "woman", "mice": "mouse", "geese": "goose",
    "teeth": "tooth", "feet": "foot", "fish": "fish", "sheep": "sheep", "series": "series", "species": "species",
}
_ENDINGS = (("ies", 3, "y"), ("ses", 2, ""), ("ves", 3, "f"))


def singular(word: str) -> str:
    if word in IRREGULAR_PLURALS:
        return IRREGULAR_PLURALS[word]
    for ending, cut, put in _ENDINGS:
        if len(word) > 3 and word.endswith(ending):
            return word[:-cut] + put
    return word[:-1] if word.endswith("s") and len(word) > 1 else word


def camel(snake: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in snake.split("_"))


# --- routes

#: What one resource stands for: verb, rest of the path, action (fixed values).
REST = (("GET", "", "index"), ("GET", "/new", "new"), ("POST", "", "create"), ("GET", "/:id", "show"), ("GET", "/:id/edit", "edit"), ("PATCH", "/:id", "update"), ("DELETE", "/:id", "destroy"))
_CALL = re.compile(r"^\s*(resources|resource|namespace|scope|get|post|put|patch|delete|root|mount|member|collection)\b\s*\(?\s*(.*?)\)?\s*(do\b.*|\{\s*)?$")
_SYMBOL = re.compile(r"^[:\"']([\w/\-:.#*?]+)[\"']?")


def _option(arguments: str, name: str) -> list[str] | None:
    m = re.search(rf"\b{name}(?::|\s*=>)\s*(\[[^\]]*\]|%i\[[^\]]*\]|[:\"'][\w/#:.\-]+[\"']?)", arguments)
    return re.findall(r"[\w/#.\-]+", m[1].removeprefix("%i")) if m else None


def parse_routes(text: str) -> list[dict]:
    """Routes of a routes file. Prefixes hold for their block alone; nested resources take their parent's key."""
    rows, stack = [], []  # (path prefix, helper prefix, controller prefix, kind, name)
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.split(" #", 1)[0].rstrip()
        if re.match(r"^\s*(end|\})\s*$", line):
            if stack:
                stack.pop()
            continue
        m = _CALL.match(line)
        opens = bool(re.search(r"\bdo\b(\s*\|[^|]*\|)?\s*$|\{\s*$", line))
        if not m:
            if opens:
                stack.append(("", "", "", "other", ""))
            continue
        word, arguments = m[1], m[2]
        name = (x := _SYMBOL.match(arguments)) and x[1]
        path, helper, controller = "".join(s[0] for s in stack), "".join(s[1] for s in stack), "".join(s[2] for s in stack)
        add = lambda verb, pattern, help_, ctl, act: rows.append({"http_method": verb, "path_pattern": pattern or "/", "helper_name": help_, "controller": ctl, "action": act, "line": n, "col": len(raw) - len(raw.lstrip())})  # noqa: B023, E731
        here = ("", "", "", word, name or "")
        if word in ("resources", "resource") and name:
            only, skip = _option(arguments, "only"), _option(arguments, "except") or []
            said = (_option(arguments, "as") or [None])[0]
            many = word == "resources"
            one = said or (singular(name) if many else name)
            for verb, rest, action in REST:
                if not many and action == "index" or (only is not None and action not in only) or action in skip:
                    continue
                rest = rest if many else rest.replace("/:id", "")
                stem = (said or name) if action in ("index", "create") and many else one
                lead = f"{action}_" if action in ("new", "edit") else ""
                add(verb, f"{path}/{name}{rest}", f"{lead}{helper}{stem}_path", controller + name, action)
            here = (f"/{name}" + (f"/:{one}_id" if many else ""), f"{one}_", "", word, name)
        elif word == "namespace" and name:
            here = (f"/{name}", f"{name}_", f"{name}/", word, name)
        elif word == "scope":
            module = (_option(arguments, "module") or [""])[0]
            place = name.strip("/") if name and arguments[:1] in ":\"'" else ((_option(arguments, "path") or [""])[0].strip("/"))
            here = (f"/{place}" if place else "", "", f"{module}/" if module else "", word, name or "")
        elif word in ("member", "collection"):
            here = ("", "", "", word, "")
        elif word == "root":
            to = (_option(arguments, "to") or re.findall(r"[\w/]+#\w+", arguments) or [""])[0]
            add("GET", path or "/", f"{helper}root_path", controller + to.partition("#")[0], to.partition("#")[2])
        elif word == "mount":
            at = (_option(arguments, "at") or [name or ""])[0]
            engine = re.match(r"[\w:]+", arguments)
            add("MOUNT", f"{path}/{at.strip('/')}", None, engine[0] if engine else None, None)
        elif name:
            to = (_option(arguments, "to") or re.findall(r"=>\s*[\"']([\w/]+#\w+)", arguments) or [None])[0]
            inside = next((s for s in reversed(stack) if s[3] in ("resources", "resource")), None)
            ctl, act = to.partition("#")[::2] if to else (inside[4] if inside else name.strip("/").partition("/")[0], name.strip("/").rpartition("/")[2])
            at = path
            if stack and stack[-1][3] == "collection" and inside:
                at = path[: path.rfind("/:")] if "/:" in path else path
            elif stack and stack[-1][3] == "member":
                at = path[: path.rfind("/:")] + "/:id" if "/:" in path else path
            said = (_option(arguments, "as") or [re.sub(r"\W+", "_", name.strip("/"))])[0]
            add(word.upper(), f"{at}/{name.strip('/')}", f"{helper}{said}_path", controller + ctl, act)
        if opens:
            stack.append(here)
    return rows


_BRANCH = re.compile(r"^(?:([a-z_]\w*)\.)?([a-z_]\w*)\b\s*\(?\s*(.*)$", re.S)


def parse_routing_tree(text: str, controller: str = "") -> list[dict]:
    """Routes of a routing tree: blocks that match a part of the path, and verbs inside them.

    `hash_branch` and a request's `on` add to the path, `is` and other blocks don't; a part that isn't a string is a
    placeholder. A verb is a route of its own, and what is inside its block is not looked into.
    """
    rows, stack = [], []  # the part of the path that each open block adds, or None inside a verb
    for st in statements(text):
        m = _BRANCH.match(st.code)
        events, part = openings(st.code), ""
        if m and None not in stack:
            said = st.said[m.start(3) :]
            first = named(re.split(r"[,)\s]", said, maxsplit=1)[0])
            if m[2] == "hash_branch" and not m[1]:
                values = [v for x in _outer(re.split(r"\)|\s+do\b|\s*\{", said)[0]) if (v := named(x))]
                part = f"/{values[0]}" if values else ""
            elif m[1] and m[2] == "on":
                part = f"/:{first}" if said.startswith(":") and first else f"/{first}" if first else "/:id"
            elif m[1] and m[2] in ("get", "post", "put", "patch", "delete"):
                path = "".join(stack) or "/"
                stem = re.sub("[:/]+", "_", path).strip("_")
                line, col = st.place(0)
                rows.append({"http_method": m[2].upper(), "path_pattern": path, "helper_name": f"{stem}_path" if stem else "root", "controller": controller, "action": m[2].upper(), "line": line, "col": col})
                part = None
        for word in events:
            if word == "end":
                if stack:
                    stack.pop()
            else:
                stack.append(part)
                part = ""
    return rows


# --- signature files

_DEF = re.compile(r"^def\s+(self\??\.)?([\w?!=<>\[\]+\-*/%~^&|]+)\s*:\s*(.*)$")
_ATTR = re.compile(r"^attr_(reader|writer|accessor)\s+(self\.)?(\w+)\s*(?:\([^)]*\))?\s*:\s*(.+)$")


def _outer(text: str, sep: str = ",") -> list[str]:
    """Parts between separators that are outside brackets and quotes."""
    parts, deep, now, quote = [], 0, "", ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[k - 1] != "\\" else quote
        elif c in "\"'" and (c == '"' or not text[k - 1 : k].isalnum() or not k) and text.find(c, k + 1) > 0:
            quote = c
        else:
            deep += (c in "([{") - (c in ")]}")
        if c == sep and not deep and not quote:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*parts, now] if p.strip()]


def parse_parameters(text: str) -> list[dict]:
    """Parameters of one overload: `String name, ?Integer n, *String rest, key: T, ?opt: T, **untyped rest`."""
    rows = []
    for i, part in enumerate(_outer(text)):
        kind = "required"
        if part.startswith("**"):
            kind, part = "keyword_rest", part[2:]
        elif part.startswith("*"):
            kind, part = "rest", part[1:]
        elif (m := re.match(r"^\??(\w+):\s*(.*)$", part)) and not part.startswith("::"):
            rows.append({"position": i, "name": m[1], "kind": "keyword", "type_hint": m[2], "confidence": 90})
            continue
        elif part.startswith("?"):
            kind, part = "optional", part[1:]
        words = part.rsplit(" ", 1)
        named = len(words) == 2 and re.fullmatch(r"[a-z_]\w*", words[1])
        rows.append({"position": i, "name": words[1] if named else f"arg{i}", "kind": kind, "type_hint": (words[0] if named else part).strip(), "confidence": 90})
    return rows


def _overload(text: str) -> tuple[str, str]:
    """(parameters, return type) of the first overload."""
    first = _outer(text, "|")[0] if "|" in text else text.strip()
    if not first.startswith("("):
        first = re.sub(r"^\[[^\]]*\]\s*", "", first)
    deep, end = 0, 0
    if first.startswith("("):
        for end, c in enumerate(first):
            deep += (c == "(") - (c == ")")
            if not deep:
                break
        inside, rest = first[1:end], first[end + 1 :]
    else:
        inside, rest = "", first
    return inside, rest.rpartition("->")[2].strip() or rest.strip()


def parse_signatures(text: str) -> dict[str, list[dict]]:
    """Symbols and parameters of a signature file. Namespaces follow indentation and `end`."""
    symbols, params, spaces, doc = [], [], [], []
    for n, raw in enumerate(text.split("\n"), 1):
        indent, line = len(raw) - len(raw.lstrip(" \t")), raw.strip(" \t\r")
        if not line:
            continue
        if line.startswith("#"):
            doc.append(line[1:].removeprefix(" "))
            continue
        if line == "end":
            if spaces and spaces[-1][1] == indent:
                symbols[spaces.pop()[2]]["end_line"] = n
            doc = []
            continue
        owner = "::".join(s[0] for s in spaces) or None
        base = {"line": n, "col": indent, "end_line": n, "visibility": "public", "parent_name": owner, "doc": "\n".join(doc) or None}
        doc = []
        head = re.match(r"^(class|module|interface)\s+([\w:]+)(?:\[[^\]]*\])?(?:\s*<\s*([\w:]+))?", line)
        if head:
            spaces.append((head[2], indent, len(symbols)))
            symbols.append(base | {"name": head[2], "kind": "class" if head[1] == "class" else "module", "parent_name": head[3] or owner})
        elif m := _DEF.match(line):
            inside, result = _overload(m[3])
            key = len(symbols)
            symbols.append(base | {"name": m[2], "kind": "classdef" if m[1] else "def", "return_type": result})
            params += [p | {"symbol": key} for p in parse_parameters(inside)]
        elif m := _ATTR.match(line):
            for name in ([m[3]] if m[1] != "writer" else []) + ([m[3] + "="] if m[1] != "reader" else []):
                symbols.append(base | {"name": name, "kind": "classdef" if m[2] else "def", "return_type": m[4]})
        elif m := re.match(r"^type\s+(\w+)\s*=\s*(.*)$", line):
            symbols.append(base | {"name": m[1], "kind": "constant", "return_type": m[2]})
        elif m := re.match(r"^([A-Z]\w*)\s*:\s*(.+)$", line):
            symbols.append(base | {"name": m[1], "kind": "constant", "return_type": m[2]})
    return {"symbols": symbols, "params": params}


# --- templates

_ERB = re.compile(r"<%(?!%)(=|-|#)?(.*?)-?%>", re.S)


def template_code(text: str) -> str:
    """The Ruby of an ERB template at its own places: as long as the template, blank elsewhere, lines kept."""
    out = [c if c == "\n" else " " for c in text]
    for m in _ERB.finditer(text):
        if m[1] != "#":
            out[m.start(2) : m.end(2)] = m[2]
            if m.end(2) < len(out) and out[m.end(2)] == " ":
                out[m.end(2)] = ";"
    return "".join(out)


_HAML_TAG = re.compile(r"^[%.#][\w.#%:-]*(?:\{[^}]*\}|\([^)]*\))?")


def indented_template_code(text: str, bare_tags: bool = False) -> str:
    """The Ruby of a HAML or Slim template at its own places: what follows -, = or == on a line, also behind a tag; blocks that
    indentation closes get their end behind the line before. `bare_tags`: a tag is a word by itself, as in Slim."""
    out, opened = [], []
    for line in text.split("\n"):
        body = line.lstrip(" \t")
        indent = len(line) - len(body)
        if not body:
            out.append("")
            continue
        lead = body
        tag = re.match(r"^[a-z][\w-]*(?:[.#][\w-]+)*(?=\s*==?\s)", body) if bare_tags else _HAML_TAG.match(body)
        if tag:
            lead = body[tag.end() :].lstrip(" \t")
        m = re.match(r"^(?:-(?!#)|[!&]?==?|~)\s?(.*)$", lead)
        code = m[1] if m else ""
        at = len(line) - len(code)
        middle = re.match(r"^(?:else|elsif|when|rescue|ensure|in)\b", code)
        ends = 0
        while opened and (indent < opened[-1] or indent == opened[-1] and not middle):
            opened.pop()
            ends += 1
        if ends and out:
            out[-1] += ";end" * ends
        out.append(" " * at + code if code else "")
        if code and not middle and openings(code).count("block") > openings(code).count("end"):
            opened.append(indent)
    if out:
        out[-1] += ";end" * len(opened)
    return "\n".join(out)


# --- Ruby

_LITERALS = (
    (re.compile(r"^(\"[^\"]*\"|'[^']*')$"), "String"), (re.compile(r"^-?\d[\d_]*$"), "Integer"), (re.compile(r"^-?\d[\d_]*\.\d+$"), "Float"), (re.compile(r"^\[.*\]$"), "Array"),
    (re.compile(r"^\{.*\}$"), "Hash"), (re.compile(r"^:\w+[?!]?$"), "Symbol"), (re.compile(r"^/.*/\w*$"), "Regexp"), (re.compile(r"^(true)$"), "TrueClass"), (re.compile(r"^(false)$"), "FalseClass"), (re.compile(r"^nil$"), "NilClass"),
)
_WORDS = frozenset("alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split())
_CALLBACK = re.compile(r"^(before|after|around)_\w+$")


def literal_type(text: str) -> str | None:
    text = text.strip()
    for pattern, kind in _LITERALS:
        if pattern.match(text):
            return kind
    if text.startswith(("<<~", "<<-", "<<")) and text[2:3] not in (" ", ""):
        return "String"
    if re.match(r"^%[wWiI]", text):
        return "[Symbol]" if text[1] in "iI" else "[String]"
    m = re.match(r"^([A-Z]\w*(?:::\w+)*)\.new\b", text)
    return m[1] if m else None


_HEAD = re.compile(r"^([A-Z]\w*(?:::[A-Z]\w*)*|@{0,2}[a-z_]\w*|\$\w+)(?=&?\.[a-z_])")
_LITERAL_HEAD = re.compile(r"^(\"[^\"]*\"|'[^']*'|\d[\d_]*(?:\.\d+)?|\[[^\[\]]*\]|\{[^{}]*\})(?=\.[a-z_])")
_LINK = re.compile(r"\s*&?\.\s*([a-z_]\w*[?!]?)(?!\w)")
_AFTER_CALLS = re.compile(r"^(?:do\b.*|\{.*|(?:if|unless)\b.*|[:\"'@\d].*)?$", re.S)


def call_chain(said: str, code: str) -> dict | None:
    """(receiver, known, methods) of a value that is calls one after another and nothing else. A receiver that is a
    literal has its type in `known`."""
    m = _HEAD.match(code) or _LITERAL_HEAD.match(code)
    if not m or m[1] in _WORDS:
        return None
    known = None if m.re is _HEAD else literal_type(said[: m.end()])
    at, methods = m.end(), []
    while link := _LINK.match(code, at):
        methods.append(link[1])
        at = link.end()
        for opens, closes in ("()", "{}"):
            block = re.match(r"\s*\{" if opens == "{" else r"\(", code[at:])
            if block:
                deep, k = 0, at + block.end() - 1
                while k < len(code):
                    deep += (code[k] == opens) - (code[k] == closes)
                    k += 1
                    if not deep:
                        break
                at = k
    return {"receiver": m[1] if known is None else None, "known": known, "methods": methods} if methods and _AFTER_CALLS.match(code[at:].strip()) else None


_NAME_ALONE = re.compile(r"^@{0,2}[a-z_]\w*$")


def result_chain(said: str, code: str) -> dict | None:
    """What a method's last statement gives, as a chain of calls, maybe none on a variable; null for what isn't one."""
    m = re.match(r"^return\b\s*", code)
    said, code = (said[m.end() :], code[m.end() :]) if m else (said, code)
    if re.search(r"\b(?:if|unless|while|until|rescue|and|or)\b", code):
        return None
    if _NAME_ALONE.match(code) and code not in _WORDS:
        return {"receiver": code, "known": None, "methods": []}
    chain = call_chain(said, code)
    if chain and (chain["methods"] != ["new"] or not (chain["receiver"] or "")[:1].isupper()):
        return chain
    kind = literal_type(said)
    return {"receiver": None, "known": kind, "methods": []} if kind else None


def _parameters(text: str) -> list[dict]:
    rows = []
    for i, p in enumerate(_outer(text)):
        if re.match(r"^(\*\*nil|\.\.\.)$", p):  # takes or passes on arguments without a name
            continue
        m = re.match(r"^(\*\*|\*|&)?(\w*)\s*(:|=)?\s*(.*)$", p)
        kind = {"**": "keyword_rest", "*": "rest", "&": "block"}.get(m[1]) or ("keyword" if m[3] == ":" else "optional" if m[3] == "=" else "required")
        rows.append({"position": i, "name": m[2] or m[1] or "_", "kind": kind, "type_hint": literal_type(m[4]) if m[4] else None, "confidence": 0})
    return rows


def _sorbet(sig: str) -> tuple[dict[str, str], str | None]:
    """Types of parameters and result in a sig block. A void result is nil."""
    m = re.search(r"params\((.*?)\)\s*(?:\.|\}|$)", sig)
    types = dict(x.split(":", 1) for x in _outer(m[1]) if ":" in x) if m else {}
    result = re.search(r"returns\((.*)\)", sig)
    return {k.strip(): v.strip() for k, v in types.items()}, result[1].strip() if result else "NilClass" if re.search(r"\bvoid\b", sig) else None


def _tags(doc: str | None) -> tuple[dict[str, str], str | None]:
    """Types that @param and @return tags of a comment tell."""
    params = {n or m: t or u for n, t, u, m in re.findall(r"@param\s+(?:(\w+)\s+\[([^\]]+)\]|\[([^\]]+)\]\s+(\w+))", doc or "")}
    result = re.search(r"@return\s+\[([^\]]+)\]", doc or "")
    return params, result[1].replace(", ", " | ") if result else None


#: What one declaration stands for: suffixes or patterns of the methods it makes, with their types (fixed values).
ATTACHED = {
    "has_one_attached": (("{}", "ActiveStorage::Attached::One"), ("{}=", None), ("{}_attachment", "ActiveStorage::Attachment"), ("{}_blob", "ActiveStorage::Blob")),
    "has_many_attached": (("{}", "ActiveStorage::Attached::Many"), ("{}=", None), ("{}_attachments", "[ActiveStorage::Attachment]"), ("{}_blobs", "[ActiveStorage::Blob]")),
    "has_rich_text": (("{}", "ActionText::RichText"), ("{}=", None), ("{}?", "TrueClass | FalseClass")),
    "has_secure_token": (("{}", "String"), ("{}=", "String"), ("regenerate_{}", "String")),
}
#: Declarations whose first name is a symbol of a kind (fixed values).
DECLARED = {
    **dict.fromkeys("belongs_to has_many has_one has_and_belongs_to_many delegated_type one_to_many many_to_one many_to_many one_to_one one_through_one many_through_many".split(), "association"),
    **dict.fromkeys("encrypts normalizes".split(), "validation"), **dict.fromkeys("connects_to queue_as retry_on discard_on".split(), "callback"),
    **dict.fromkeys("shared_examples_for shared_context shared_examples".split(), "module"), **dict.fromkeys("describe context it specify".split(), "test"),
    **dict.fromkeys("let let! subject".split(), "variable"), **dict.fromkeys("factory trait".split(), "class"), "scope": "scope", "validate": "callback",
}
#: Types of attribute declarations and of columns (fixed values).
ATTRIBUTE_TYPES = {"string": "String", "text": "String", "integer": "Integer", "big_integer": "Integer", "bigint": "Integer", "float": "Float", "decimal": "BigDecimal", "boolean": "TrueClass | FalseClass", "date": "Date", "datetime": "Time", "time": "Time", "json": "Hash", "jsonb": "Hash", "references": "Integer", "uuid": "String"}
_MANY = ("has_many", "has_and_belongs_to_many", "one_to_many", "many_to_many", "many_through_many")
_ARGUMENT = re.compile(r"^(?::|[\"'])([\w?!=/: ]+)[\"']?$")


def arguments_of(said: str) -> tuple[list[str], dict[str, str]]:
    """(values, options by name) of a call's argument text."""
    values, options = [], {}
    for part in _outer(said):
        m = re.match(r"^(?:([a-z_]\w*):(?!:)|:([a-z_]\w*)\s*=>|[\"'](\w+)[\"']\s*(?:=>|:))\s*(.*)$", part, re.S)
        if m:
            options[m[1] or m[2] or m[3]] = m[4].strip()
        else:
            values.append(part.strip())
    return values, options


def named(value: str) -> str | None:
    m = _ARGUMENT.match(value)
    return m[1] if m else None


def names_in(value: str) -> list[str]:
    """Symbols and strings of a list, or the keys of a hash."""
    if m := re.match(r"^%[iwIW][\[({<](.*)[\])}>]$", value, re.S):
        return m[1].split()
    inside = value.strip()[1:-1] if value.strip()[:1] in "[{" else value
    return [m for part in _outer(inside) if (m := (re.match(r"^:?[\"']?(\w+)[\"']?\s*(?:=>|:(?!:)|$)", part) or [None, None])[1])]


def declared_symbols(word: str, said: str, owner: str | None) -> list[dict]:
    """Symbols that one declaration in a class body makes; an empty list for words that make none."""
    values, options = arguments_of(said)
    first = named(values[0]) if values else None
    make = lambda name, kind="def", **more: {"name": name, "kind": kind, "doc": word} | more
    if word in ATTACHED:
        first = first or ("token" if word == "has_secure_token" else None)
        return [make(t.format(first), return_type=kind) for t, kind in ATTACHED[word]] if first else []
    if word == "has_secure_password":
        p = first or "password"
        return [make(n, return_type=t) for n, t in ((f"{p}=", "String"), (f"{p}_confirmation=", "String"), (f"{p}_digest", "String"), ("authenticate" if p == "password" else f"authenticate_{p}", None))]
    if word == "attribute" and first:
        kind = ATTRIBUTE_TYPES.get(named(values[1]) or "") if len(values) > 1 else None
        return [make(first, return_type=kind), make(first + "=", return_type=kind), make(first + "?", return_type="TrueClass | FalseClass")]
    if word == "store_accessor":
        return [row for v in values[1:] for name in (names_in(v) if v[:1] in "[%" else [named(v)]) if name for row in (make(name, return_type="Object"), make(name + "="))]
    if word == "composed_of" and first:
        kind = named(options.get("class_name", "")) or camel(first)
        return [make(first, return_type=kind), make(first + "=", return_type=kind)]
    if word == "accepts_nested_attributes_for":
        return [make(f"{n}_attributes=") for v in values if (n := named(v))]
    if word == "enum":
        groups = [(first, values[1])] if first and len(values) > 1 else [(k, v) for k, v in options.items() if not k.startswith("_") and k not in ("prefix", "suffix", "default", "scopes")]
        if first and len(values) == 1:
            groups = [(first, "{" + ", ".join(f"{k}: {v}" for k, v in options.items() if k not in ("prefix", "suffix", "default", "scopes")) + "}")]
        rows = []
        for name, said_values in groups:
            rows.append(make(name))
            for v in names_in(said_values):
                rows += [make(v + "?", return_type="TrueClass | FalseClass"), make(v + "!"), make(v, "scope", return_type=f"[{owner}]" if owner else None)]
        return rows
    if word in ("delegate", "def_delegators", "def_delegator", "instance_delegate"):
        names = values if word == "delegate" else values[1:] if word == "def_delegators" else values[-1:]
        prefix = options.get("prefix")
        to = named(options.get("to", "")) or ""
        lead = f"{to}_" if prefix == "true" else f"{named(prefix)}_" if prefix and named(prefix) else ""
        return [make(lead + n) for v in names if (n := named(v))]
    kind = DECLARED.get(word) or ("validation" if word.startswith("validates") else "callback" if _CALLBACK.match(word) else None)
    if kind is None:
        return []
    if kind == "association" and first:
        many = word in _MANY
        target = named(options.get("class_name", "")) or (None if options.get("polymorphic") == "true" else camel(singular(first) if many else first))
        rows = [make(first, kind, return_type=(f"[{target}]" if many else target) if target else None, value_snippet=f"through:{named(options['through'])}" if options.get("through") and named(options["through"]) else None)]
        if word == "delegated_type":
            for v in names_in(options.get("types", "")):
                rows += [make(f"{re.sub('(?<!^)(?=[A-Z])', '_', v).lower()}?", return_type="TrueClass | FalseClass"), make(re.sub("(?<!^)(?=[A-Z])", "_", v).lower(), return_type=v)]
        return rows
    if kind == "scope" and first:
        return [make(first, kind, return_type=f"[{owner}]" if owner else None)]
    if kind in ("validation", "callback"):
        return [make(n, kind) for v in values if (n := named(v))]
    return [make(first, kind)] if first else []


_DEF_HEAD = re.compile(r"^(?:(private|public|protected|module_function|private_class_method)\s*\(?\s*)?def\s+(self\.)?([\w?!]+=?(?=[\s(;]|$)|[\w?!]+|[<>=\[\]+\-*/%!~^&|]+)\s*(.*)$", re.S)
_BARE_VISIBILITY = re.compile(r"^(private|public|protected|module_function)\s*$")
_NAMED_VISIBILITY = re.compile(r"^(private|public|protected|private_class_method|module_function)\s*\(?\s*([:\"'%\[].*?)\)?$", re.S)
_BODY_CALL = re.compile(r"^(\w+[?!]?)\s*\(?\s*(.*?)\s*\)?(?:\s*\bdo\b.*|(?<=[\w)\]?!\"'])\s*\{.*)?$", re.S)
#: Names that a pattern binds: alone, after a class and an arrow, after a star, or as a key without a value.
_CAPTURE = re.compile(r"(?:([A-Z][\w:]*)\s*=>\s*)?(?<![\w.:@$^?!])([a-z_]\w*)(?:(?=:\s*(?:[,}\])]|$))|(?![\w?!(.:]))")
_ASSIGN = re.compile(r"^(@@?\w+|\$\w+|[a-z_]\w*)\s*(\|\||&&|\*\*|<<|>>|[+\-*/%|&^])?=\s*(?![=~>])(.+)$", re.S)


def _split_parameters(rest: str, code: str) -> tuple[str, str | None]:
    """(parameter text, value of an endless method or None) of what follows a method's name."""
    if code.startswith("("):
        deep = 0
        for k, c in enumerate(code):
            deep += (c in "([{") - (c in ")]}")
            if not deep:
                break
        after = rest[k + 1 :].strip()
        return rest[1:k], after[1:].strip() if after.startswith("=") and after[1:2] not in "=~>" else None
    if code.startswith("=") and code[1:2] not in "=~>":
        return "", rest[1:].strip()
    return rest, None


def parse_ruby(text: str) -> dict[str, list[dict]]:
    """Symbols, parameters, variables, references, mixins and tokens of a Ruby text.

    Statements may span lines. Understood are classes, modules, methods (with endless and singleton ones), attributes,
    constants, Struct and Data classes, declarations of the usual frameworks, mixins, aliases, visibility, bindings
    (assignments, several at once, block, for and rescue variables) with the types of literals, `new` and guards, and calls.
    """
    symbols, params, variables, refs, mixins, marks, calls = [], [], [], [], [], [], []
    stack: list[list] = []  # [kind, qualified name, index of symbol, visibility]
    scope, sig = 0, ""
    results: dict[int, tuple[str, str, int]] = {}  # of methods the text and code of what they end with, and its line
    for st in statements(text):
        said, code = st.said, st.code
        n, col = st.place(0)
        doc = "\n".join(st.doc) or None
        owner = next((s for s in reversed(stack) if s[0] in ("class", "module")), None)
        inside = next((s for s in reversed(stack) if s[0] in ("class", "module", "def", "singleton")), None)
        events = openings(code)
        here = next((s[4] for s in reversed(stack) if s[0] == "def"), 0)

        def make(name, kind, **more):
            symbols.append({"name": name, "kind": kind, "line": n, "col": col, "end_line": n, "parent_name": owner and owner[1], "visibility": "public", "doc": doc} | more)  # noqa: B023
            return len(symbols) - 1

        def bind(name, kind, confidence, at, block=False):
            line, column = st.place(at)  # noqa: B023
            variables.append({"name": name, "line": line, "col": column, "type_hint": kind, "confidence": confidence, "scope_id": None if name[0] in "@$" else here, "symbol": owner[2] if owner and name.startswith("@") and not name.startswith("@@") else None, "is_block_param": block})  # noqa: B023

        pushed = None
        if m := re.match(r"^(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([\w:]+))?", code):
            name = f"{owner[1]}::{m[2]}" if owner else m[2]
            at = make(name, m[1], parent_name=m[3] or (owner and owner[1]))
            marks.append((*st.place(m.start(2)), len(m[2]), 0))
            pushed = [m[1], name, at, "public"]
            code_rest = m.end()
        elif re.match(r"^class\s*<<\s*self\b", code):
            pushed = ["singleton", owner[1] if owner else "", None, "public"]
            code_rest = len(code)
        elif re.match(r"^sig\b", code) and (events or "{" in code):
            sig = said[3:].strip()
            code_rest = len(code)
            stack += [["sig", "", None, "public"]] if events == ["block"] else []
            continue
        elif stack and stack[-1][0] == "sig" and re.match(r"^\.?(params|returns|void|override|abstract)\b", code):
            sig += "." + said
            continue
        elif m := _DEF_HEAD.match(code):
            name = said[m.start(3) : m.end(3)]
            shown, value = _split_parameters(said[m.start(4) :], m[4])
            klass = m[2] or (inside and inside[0] == "singleton") or m[1] in ("module_function", "private_class_method") or (inside and inside[3] == "module_function")
            kind = "classdef" if klass else "test" if name.startswith("test_") else "def"
            level = {"private_class_method": "private", "module_function": "public"}.get(m[1], m[1]) or (inside[3] if inside and inside[0] != "def" and inside[3] != "module_function" else "public")
            by_tag, tagged = _tags(doc)
            by_sig, declared = _sorbet(sig) if sig else ({}, None)
            sig = ""
            ends = result_chain(value, code[said.rfind(value) :]) if value else None
            at = make(name, kind, visibility=level, return_type=declared or (ends["known"] if ends and not ends["methods"] else None) or tagged)
            marks.append((*st.place(m.start(3)), len(name), 1))
            if value and symbols[at]["return_type"] is None:
                results[at] = (value, code[said.rfind(value) :], n)
            for p in _parameters(re.sub(r"\s+", " ", shown)):
                hint = by_sig.get(p["name"]) or by_tag.get(p["name"])
                params.append(p | {"symbol": at} | ({"type_hint": hint, "confidence": 90} if hint else {}))
            scope += 1
            pushed = ["def", name, at, "public", scope, None]
            here = scope
            body = m.start(4) + len(shown) + 2 if m[4].startswith("(") else len(code)
            inline = value is None and re.match(r"\s*(\S.*?)\s*\bend$", code[body:], re.S)
            code_rest = said.rfind(value) if value is not None else body + inline.start(1) if inline else len(code)
            if inline:
                pushed[5] = (said[code_rest : body + inline.end(1)], inline[1], n)
        else:
            code_rest = 0
            if m := _BARE_VISIBILITY.match(code):
                if inside and inside[0] != "def":
                    inside[3] = m[1]
                continue
            if inside is None or inside[0] != "def":
                code_rest = _declaration(st, owner, inside, make, symbols, mixins, refs)
        assigned = code_rest
        body_code, body_said = code[code_rest:], said[code_rest:]
        if pushed is None or code_rest < len(code):
            if m := re.match(r"^([A-Z]\w*)\s*(?:\|\|)?=\s*(?![=~>])(.+)$", body_said, re.S):
                kind, value = "constant", m[2].strip()
                more = re.match(r"^(Struct\.new|Data\.define)\s*\(?(.*?)\)?(?:\s*do\b.*)?$", value, re.S)
                full = f"{owner[1]}::{m[1]}" if owner and more else m[1]
                at = make(full, "class" if more else kind, return_type=None if more else literal_type(value), value_snippet=value[:120])
                if more:
                    for v in (x for x in _outer(more[2]) if named(x)):
                        make(named(v), "def", parent_name=full)
                        if more[1] == "Struct.new":
                            make(named(v) + "=", "def", parent_name=full)
                    if "block" in events:
                        pushed = ["class", full, at, "public"]
                assigned = code_rest + m.start(2)
            elif m := re.match(r"^((?:\*?(?:@@?|\$)?[a-z_]\w*\s*,\s*)+\*?(?:@@?|\$)?[a-z_]\w*)\s*=\s*(?![=~>])(.+)$", body_code, re.S):
                names, values = _outer(m[1]), _outer(body_said[m.start(2) :])
                for k, name in enumerate(names):
                    hint = literal_type(values[k]) if len(values) == len(names) and not name.startswith("*") else "Array" if name.startswith("*") else None
                    bind(name.lstrip("*"), hint, 0, code_rest + m[1].find(name.lstrip("*")))
                assigned = code_rest + m.start(2)
            elif m := _ASSIGN.match(body_code):
                value = body_said[m.start(3) :]
                comment = re.search(r"@type\s+\[?([\w:\[\] |,]+?)\]?\s*$", doc or "")
                cast = re.match(r"^T\.(?:let|cast|must)\((.*)\)$", value, re.S)
                inner = _outer(cast[1]) if cast else []
                if cast:
                    kind, sure = (inner[1] if len(inner) > 1 else literal_type(inner[0]) if inner else None), 95
                else:
                    chain = None if comment or m[2] else call_chain(value, body_code[m.start(3) :])
                    kind, sure = (comment[1] if comment else literal_type(value)), {"||": 20, "&&": 15}.get(m[2], 20 if m[2] else 0)
                    if chain and chain["methods"] != ["new"] and m[1] not in _WORDS:
                        kind, (line, column) = None, st.place(code_rest)
                        calls.append(chain | {"name": m[1], "line": line, "col": column, "block": None})
                if m[1] not in _WORDS:
                    bind(m[1], kind, 70 if m[1].startswith("$") and kind else sure, code_rest)
                    assigned = code_rest + m.start(3)
            for m in re.finditer(r"(?:\bdo|\{)\s*\|([^|]*)\|", body_code):
                for k, x in enumerate(re.finditer(r"(?<![\w:])\*{0,2}&?([a-z_]\w*)", m[1].split(";")[0])):
                    bind(x[1], None, 60, code_rest + m.start(1) + x.start(1), True)
                    begin = max(assigned - code_rest, 0)
                    chain = None if k else call_chain(body_said[begin : m.start()].rstrip(), body_code[begin : m.start()].rstrip())
                    if chain:
                        line, column = st.place(code_rest + m.start(1) + x.start(1))
                        calls.append(chain | {"methods": chain["methods"][:-1], "block": chain["methods"][-1], "name": x[1], "line": line, "col": column})
            if m := re.match(r"^for\s+([a-z_]\w*)\s+in\b", body_code):
                bind(m[1], None, 50, code_rest + m.start(1))
            if m := re.match(r"^rescue\s*([\w:, ]*?)\s*=>\s*([a-z_]\w*)", body_code):
                bind(m[2], " | ".join(_outer(m[1])) or "StandardError", 80, code_rest + m.start(2))
            if m := re.search(r"^(?:if|elsif)\s+([a-z_]\w*)\.(?:is_a\?|kind_of\?|instance_of\?)\s*\(?\s*([A-Z][\w:]*)", body_code):
                bind(m[1], m[2], 85, code_rest + m.start(1))
            if m := re.match(r"^in\s(.*?)(?=\b(?:if|unless|then)\b|$)", body_code, re.S):
                for x in _CAPTURE.finditer(m[1]):
                    if x[2] not in _WORDS:
                        bind(x[2], x[1], 85 if x[1] else 0, code_rest + m.start(1) + x.start(2))
                assigned = code_rest + m.end()
        if not re.match(r"^alias\s", code):
            _calls(st, assigned, here, refs, marks)
        if pushed is None and stack and code != "end":
            method = next((s for s in reversed(stack) if s[0] == "def"), None)
            if method and method[5] is not False:
                plain = method is stack[-1] and not events
                never = method is stack[-1] and re.match(r"^(?:rescue|else|ensure)\b", code)
                method[5] = False if never else (said, code, n) if plain else None
        for word in events:
            if word == "end":
                if stack:
                    top = stack.pop()
                    if top[2] is not None:
                        symbols[top[2]]["end_line"] = st.place(len(code) - 1)[0]
                    if top[0] == "def" and top[5] and symbols[top[2]]["return_type"] is None:
                        results[top[2]] = top[5]
            elif pushed is not None and (word == pushed[0] or word in ("class", "def", "module") or pushed[0] == "class" and word == "block"):
                stack.append(pushed)
                pushed = None
            else:
                stack.append(["block", "", None, "public"])
    for at, (said, code, line) in sorted(results.items()):
        chain = result_chain(said, code)
        if chain and chain["known"] and not chain["methods"]:
            symbols[at]["return_type"] = chain["known"]
        elif chain:
            calls.append(chain | {"name": symbols[at]["name"], "line": line, "col": symbols[at]["col"], "block": None, "symbol": at})
    tokens = [{"line": line - 1, "col": c, "len": size, "type": kind, "mods": 0} for line, c, size, kind in sorted(set(marks))]
    return {"symbols": symbols, "params": params, "local_vars": variables, "refs": refs, "mixins": mixins, "tokens": tokens, "calls": calls}


def _declaration(st, owner, inside, make, symbols: list[dict], mixins: list[dict], refs: list[dict]) -> int:
    """A statement in a class body or at the top: what it declares. Gives the place from which bindings are looked for."""
    said, code = st.said, st.code
    n, col = st.place(0)
    if m := _NAMED_VISIBILITY.match(said):
        wanted = {x for v in _outer(m[2]) for x in (names_in(v) if v[:1] in "[%" else [named(v)]) if x}
        for s in symbols:
            if s["name"] in wanted and s["parent_name"] == (owner and owner[1]) and s["kind"] in ("def", "classdef"):
                if m[1] == "module_function":
                    s["kind"] = "classdef"
                elif (m[1] == "private_class_method") == (s["kind"] == "classdef"):
                    s["visibility"] = "private" if m[1] == "private_class_method" else m[1]
        return 0
    if m := re.match(r"^alias\s+:?([\w?!=]+)\s+:?([\w?!=]+)", code):
        make(m[1], "def")
        refs.append({"name": m[2], "line": n, "col": st.place(m.start(2))[1], "arg_count": 0})
        return 0
    m = _BODY_CALL.match(said)
    if not m or not code.startswith(m[1]) or m[1] in _WORDS:
        return 0
    word, rest = m[1], m[2]
    if word in ("include", "prepend", "extend"):
        for name in _outer(rest):
            if owner and re.match(r"^[A-Z][\w:]*$", name):
                mixins.append({"symbol": owner[2], "module_name": name, "kind": word})
    elif a := re.match(r"^(?:attr_|cattr_|mattr_|class_attribute)(reader|writer|accessor)?$", word):
        level = inside[3] if inside and inside[0] in ("class", "module", "singleton") and inside[3] != "module_function" else "public"
        klass = word.startswith(("cattr", "mattr")) or (inside and inside[0] == "singleton")
        for name in (named(v) for v in _outer(rest)):
            for suffix in ("",) * (a[1] != "writer") + ("=",) * (a[1] != "reader") if name else ():
                make(name + suffix, "classdef" if klass else "def", visibility=level)
    elif word in ("alias_method", "define_method", "define_singleton_method"):
        names = [x for v in _outer(rest) if (x := named(v))]
        if names:
            make(names[0], "classdef" if word == "define_singleton_method" else "def")
        if word == "alias_method" and len(names) > 1:
            refs.append({"name": names[1], "line": n, "col": col, "arg_count": 0})
    else:
        for row in declared_symbols(word, rest, owner and owner[1]):
            make(**row)
    return 0


_SEND = re.compile(r"(?:(?<![\w.@$:])([A-Z]\w*(?:::[A-Z]\w*)*|@?[a-z_]\w*)(?:&?\.))?(?<![\w@$])([a-z_]\w*[?!]?)(\()?")
_CONSTANT = re.compile(r"(?<![\w:@$.])([A-Z]\w*(?:::[A-Z]\w*)*)(?!\w*\s*[:](?!:))")


def _calls(st, start: int, scope: int, refs: list[dict], marks: list) -> None:
    """References in a statement from a place on: calls with their number of arguments and known receivers, and constants."""
    _calls_in(st, st.said, st.code, 0, start, scope, refs, marks)


def interpolated(said: str, code: str):
    """(place, text) of the code in interpolations of quoted texts."""
    at = 0
    while (at := said.find("#{", at)) >= 0:
        opener = code[:at].rstrip(" ")[-1:]
        if code[at] == " " and opener in ('"', "`", "/"):
            deep, k = 1, at + 2
            while k < len(said) and deep:
                deep += (said[k] == "{") - (said[k] == "}")
                k += 1
            yield at + 2, said[at + 2 : k - (not deep)]
            at = k
        else:
            at += 2


def _calls_in(st, said: str, code: str, base: int, start: int, scope: int, refs: list[dict], marks: list) -> None:
    for at, inner in interpolated(said, code):
        _calls_in(st, inner, cover(inner), base + at, 0, scope, refs, marks)
    head = None if base else re.match(r"^(?:(?:private|public|protected|module_function|private_class_method)\s+)?(?:class|module|def)\s+(?:self\.)?\S+?(?=[\s(;]|$)", code)
    start = max(start, head.end() if head else 0)
    for m in _SEND.finditer(code, start):
        at = m.start(2)
        before = code[at - 1 : at]
        if m[2] in _WORDS or before == ":" or code[m.end(2) : m.end(2) + 1] == ":" and code[m.end(2) : m.end(2) + 2] != "::":
            continue
        given = 0
        if m[3]:
            deep, end = 1, m.end()
            while end < len(code) and deep:
                deep += (code[end] in "([{") - (code[end] in ")]}")
                end += 1
            given = len(_outer(said[m.end() : end - 1]))
        elif re.match(r"\s+(?:[:\"'\[@$]|[A-Za-z_0-9])", code[m.end() :]) and not re.match(r"\s+(?:if|unless|while|until|and|or|do|then|in|rescue)\b|\s+[:?]\s", code[m.end() :]):
            given = len(_outer(re.split(r"\s+(?:do|if|unless|while|until|rescue)\b", said[m.end() :])[0]))
        if m[1] and m[1][0] not in "@" and not m[1][0].isupper() and m[1] not in _WORDS:
            line, column = st.place(base + m.start(1))
            refs.append({"name": m[1], "line": line, "col": column, "scope_id": scope or None, "arg_count": 0, "receiver_type": None})
        line, column = st.place(base + at)
        refs.append({"name": m[2], "line": line, "col": column, "scope_id": scope or None, "arg_count": given, "receiver_type": m[1] if m[1] and m[1][0].isupper() and not m[1].isupper() else None})
        marks.append((line, column, len(m[2]), 1 if m[3] or given or before == "." else 2))
    for m in _CONSTANT.finditer(code, start):
        line, column = st.place(base + m.start(1))
        refs.append({"name": m[1], "line": line, "col": column, "scope_id": scope or None, "arg_count": 0, "receiver_type": None})
        marks.append((line, column, len(m[1]), 0))


def call_arguments(text: str) -> list[dict]:
    """(receiver, name, line, arguments) of calls with brackets and two or more arguments, on constants and variables.
    Each argument is (line, col, named), with whether it has a keyword."""
    out = []
    for st in statements(text):
        for m in _SEND.finditer(st.code):
            if not m[1] or not m[3]:
                continue
            deep, k, starts, fresh = 1, m.end(), [], True
            while k < len(st.code) and deep:
                c = st.code[k]
                if fresh and not c.isspace() and c not in ",)":
                    starts.append(k)
                    fresh = False
                deep += (c in "([{") - (c in ")]}")
                fresh = fresh or (c == "," and deep == 1)
                k += 1
            if len(starts) > 1:
                at = [(*st.place(a), bool(re.match(r"[a-z_]\w*[?!]?:(?!:)|[:\"'][^=,]*=>|\*\*", st.said[a:]))) for a in starts]
                out.append({"receiver": m[1], "name": m[2], "line": st.place(m.start())[0], "arguments": at})
    return out
