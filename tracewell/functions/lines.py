"""Declarations, imports, calls, routes, tables and risky calls of program texts.

A file is cut into tokens by one expression for its family of languages (public lexical grammars: comments,
strings, names, numbers, marks), and small readers walk over the tokens; nothing here matches a line as a whole, so a
keyword within a string or a comment declares nothing, and a declaration may span lines. Readers work file by
file inside Arrow batches; what needs more than one file is a join over their rows.

Null and empty texts give no rows, files of unknown suffixes neither. Lines count from 1.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from .shapes import Remembered

#: Suffixes of the families of languages.
FAMILIES = {
    "py": "python", "js": "script", "jsx": "script", "ts": "script", "tsx": "script", "go": "go", "rs": "rust", "java": "java", "kt": "java", "cs": "sharp", "php": "php", "rb": "ruby", "sql": "sql",
}
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
#: Actions of a resource, their verbs, and whether the route ends in the row's id.
ACTIONS = [("index", "GET", False), ("create", "POST", False), ("show", "GET", True), ("update", "PUT", True), ("destroy", "DELETE", True)]
RISKY = {"eval", "exec", "system", "popen", "Command", "spawn", "unserialize", "pickle.loads", "yaml.load"}

_HASH, _SLASH = r"\#[^\n]*", r"//[^\n]*|/\*.*?\*/"
_STRING = r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"


def _lexer(comment: str) -> re.Pattern:
    return re.compile(rf"(?P<skip>{comment}|[^\S\n]+)|(?P<newline>\n)|(?P<string>{_STRING})|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>=>|->|::|.)", re.S)


_LEXERS = {f: _lexer(_HASH if f in ("python", "ruby") else (r"--[^\n]*|/\*.*?\*/" if f == "sql" else f"{_HASH}|{_SLASH}" if f == "php" else _SLASH)) for f in set(FAMILIES.values())}


class Tokens:
    """The tokens of one file: (kind, text, line, column of the first token of the line)."""

    def __init__(self, text: str, family: str) -> None:
        self.kinds, self.texts, self.lines, self.first = [], [], [], []
        line, start, fresh, indent = 1, 0, True, 0
        for m in _LEXERS[family].finditer(text):
            kind, value = m.lastgroup, m.group()
            if kind not in ("skip", "newline"):
                if fresh:
                    indent, fresh = m.start() - start, False
                self.kinds.append(kind)
                self.texts.append(value)
                self.lines.append(line)
                self.first.append(indent)
            if "\n" in value:
                line += value.count("\n")
                start, fresh = m.start() + value.rfind("\n") + 1, True

    def __len__(self) -> int:
        return len(self.texts)

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.texts) and self.kinds[i] == "name"

    def string(self, i: int) -> str | None:
        """What a string literal at i says, else None."""
        if not (0 <= i < len(self.texts)) or self.kinds[i] != "string":
            return None
        value = self.texts[i]
        edge = 3 if value[:3] in ('"""', "'''") else 1
        return value[edge:-edge]

    def close(self, i: int) -> int:
        """The token that closes the bracket at i; the last one if none does."""
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
        opened, closed = self.text(i), pairs.get(self.text(i))
        for j in range(i, len(self)):
            depth += (self.texts[j] == opened) - (self.texts[j] == closed)
            if not depth:
                return j
        return len(self) - 1

    def strings(self, i: int, j: int) -> list[str]:
        return [s for k in range(i, j) if (s := self.string(k)) is not None]


Row = tuple[int, str, str, str | None]


def declarations(t: Tokens, family: str) -> Iterator[Row]:
    """(line, kind, name, container) of classes and functions."""
    words = {"python": {"class": "class", "def": "function"}, "script": {"class": "class", "interface": "class", "function": "function"}, "go": {"func": "function"}, "rust": {"struct": "class", "enum": "class", "trait": "class", "fn": "function"},
             "java": {"class": "class", "interface": "class", "fun": "function"}, "sharp": {"class": "class", "interface": "class"}, "php": {"class": "class", "function": "function"}, "ruby": {"class": "class", "module": "class", "def": "function"}, "sql": {}}[family]
    open_: list[tuple[int, str, int]] = []  # classes that later lines may belong to: indent or closing token, name, line
    for i, text in enumerate(t.texts):
        if family in ("python", "ruby"):
            while open_ and t.first[i] <= open_[-1][0] and t.lines[i] > open_[-1][2]:
                open_.pop()
        else:
            while open_ and i > open_[-1][0]:
                open_.pop()
        kind = words.get(text) if t.kinds[i] == "name" else None
        arrow = family == "script" and text == "=" and t.is_name(i - 1) and t.text(i - 2) in ("const", "let", "var")
        if arrow:
            j = i + 1 + (t.text(i + 1) == "async")
            after = t.close(j) + 1 if t.text(j) == "(" else j + 1
            if t.text(after) == "=>":
                yield t.lines[i - 1], "function", t.text(i - 1), open_[-1][1] if open_ else None
        if not kind or t.text(i - 1) in (".", "::"):
            continue
        j, owner = i + 1, open_[-1][1] if open_ else None
        if family == "go" and t.text(j) == "(":  # the receiver
            end = t.close(j)
            owner, j = t.text(end - 1), end + 1
        if not t.is_name(j):
            continue
        yield t.lines[i], kind, t.text(j), owner
        if kind == "class":
            if family in ("python", "ruby"):
                open_.append((t.first[i], t.text(j), t.lines[i]))
            else:
                brace = next((k for k in range(j, len(t)) if t.texts[k] in "{;"), len(t))
                if t.text(brace) == "{":
                    open_.append((t.close(brace), t.text(j), t.lines[i]))


def imports(t: Tokens, family: str) -> Iterator[Row]:
    """(line, 'import', module, None): what a file names as used."""
    for i, text in enumerate(t.texts):
        begins = i == 0 or t.lines[i - 1] < t.lines[i] or t.texts[i - 1] in (";", "{", "}")
        if family == "python" and begins and text in ("import", "from"):
            j = i + 1
            while True:
                start = j
                while t.text(j) == "." or t.is_name(j) and t.text(j) != "import" and (j == start or t.text(j - 1) == "."):
                    j += 1
                if j > start:
                    yield t.lines[i], "import", "".join(t.texts[start:j]), None
                if text == "import" and t.text(j) == "as":
                    j += 2
                if text == "from" or t.text(j) != ",":
                    break
                j += 1
        elif family == "script" and text in ("from", "import", "require"):
            at = i + 1 + (t.text(i + 1) == "(")
            if (name := t.string(at)) is not None:
                yield t.lines[i], "import", name, None
        elif family == "go" and begins and text == "import":
            end = t.close(i + 1) if t.text(i + 1) == "(" else i + 2
            for k in range(i + 1, min(end, len(t))):
                if (name := t.string(k)) is not None:
                    yield t.lines[k], "import", name, None
        elif family in ("java", "rust", "php", "sharp") and begins and text in ("import", "use", "using"):
            j = i + 1
            while t.is_name(j) or t.text(j) in (".", "::", "\\"):
                j += 1
            if j > i + 1:
                yield t.lines[i], "import", "".join(t.texts[i + 1 : j]), None


def calls(t: Tokens, family: str) -> Iterator[Row]:
    """(line, 'call', name, receiver): names before an opening bracket that do not declare anything; risky ones once more."""
    quiet = {"def", "class", "fn", "func", "function", "fun", "if", "for", "while", "switch", "return", "catch", "elif", "and", "or", "not", "in", "match", "struct"}
    for i in range(len(t) - 1):
        if t.kinds[i] == "name" and t.texts[i + 1] == "(" and t.texts[i] not in quiet and t.text(i - 1) not in quiet - {"return", "and", "or", "not", "in", "if", "elif", "while"} and family != "sql":
            owner = t.text(i - 2) if t.text(i - 1) in (".", "::", "->") and t.is_name(i - 2) else None
            yield t.lines[i], "call", t.texts[i], owner
            if t.texts[i] in RISKY or f"{owner}.{t.texts[i]}" in RISKY:
                yield t.lines[i], "risk", t.texts[i], owner


def tables(t: Tokens, family: str) -> Iterator[Row]:
    """(line, 'data', table, None) from SQL, in its own files and in strings."""
    parts = [(t.lines[i], s) for i in range(len(t)) if (s := t.string(i)) is not None and re.match(r"\s*(select|insert|update|delete|create|with)\b", s, re.I)]
    if family == "sql":
        parts = [(line, text) for line, text in zip(t.lines, t.texts, strict=True)]
        text, lines = " ".join(x for _, x in parts), [line for line, _ in parts]
        words = text.split(" ")
        found = [(lines[min(i, len(lines) - 1)], words[i + 1 :]) for i, w in enumerate(words) if w.lower() in ("from", "join", "into", "update", "table")]
    else:
        found = []
        for line, text in parts:
            words = re.findall(r"\w+|[^\w\s]", text)
            found += [(line, words[i + 1 :]) for i, w in enumerate(words) if w.lower() in ("from", "join", "into", "update", "table")]
    for line, rest in found:
        while rest and rest[0].lower() in ("if", "not", "exists"):
            rest = rest[1:]
        if rest and re.fullmatch(r"[^\W\d]\w*", rest[0]):
            yield line, "data", rest[0], None


def joined(prefix: str, route: str) -> str:
    """A prefix and a route as one path."""
    return "/" + "/".join(x for x in (prefix.strip("/"), route.strip("/")) if x)


def constants(t: Tokens, family: str) -> Iterator[Row]:
    """(line, 'constant', name, value) of names set to a string."""
    for i in range(1, len(t) - 1):
        if t.texts[i] == "=" and t.is_name(i - 1) and t.text(i - 2) != "." and (value := t.string(i + 1)) is not None and t.text(i + 2) not in ("+", ".", "("):
            yield t.lines[i], "constant", t.texts[i - 1], value


def routes(t: Tokens, family: str) -> Iterator[Row]:
    """(line, 'route', 'VERB path', framework family)."""
    reader: dict[str, Callable[[Tokens], Iterator[Row]]] = {
        "python": _python_routes, "script": _script_routes, "go": _go_routes, "java": _annotated_routes, "sharp": _attribute_routes, "php": _php_routes, "ruby": _ruby_routes, "rust": _rust_routes,
    }
    return reader.get(family, lambda _: iter(()))(t)


def _prefixes(t: Tokens, keys: tuple[str, ...]) -> dict[str, str]:
    """Names bound to a call with a prefix argument: ``name = Maker(..., prefix="/x")``."""
    out = {}
    for i in range(2, len(t) - 2):
        if t.texts[i] in ("=", ":") and t.text(i + 1) in ("=", "") + keys or t.texts[i] in keys and t.text(i + 1) in ("=", ":"):
            value = t.string(i + 2)
            at = next((k for k in range(i, 0, -1) if t.texts[k] == "=" and t.is_name(k - 1) and t.texts[k - 1] not in keys and t.lines[k] >= t.lines[i] - 3), None)
            if value is not None and at is not None:
                out[t.texts[at - 1]] = value
    return out


def _python_routes(t: Tokens) -> Iterator[Row]:
    prefix = _prefixes(t, ("prefix", "url_prefix"))
    actions = [("GET", ""), ("POST", ""), ("GET", "{id}"), ("PUT", "{id}"), ("PATCH", "{id}"), ("DELETE", "{id}")]
    for i in range(len(t)):
        if t.texts[i] == "@" and t.is_name(i + 1) and t.text(i + 2) == "." and t.text(i + 4) == "(":
            verb, end = t.text(i + 3), t.close(i + 4)
            path = t.string(i + 5)
            if path is None or verb not in (*VERBS, "route", "api_route", "websocket"):
                continue
            listed = next((t.strings(k, t.close(k + 2)) for k in range(i + 5, end) if t.texts[k] == "methods"), ["GET"])
            for m in [verb.upper()] if verb in VERBS else [x.upper() for x in listed]:
                yield t.lines[i], "route", f"{m} {joined(prefix.get(t.text(i + 1), ''), path)}", "decorator"
        elif t.texts[i] in ("path", "re_path") and t.text(i + 1) == "(" and t.text(i - 1) in ("[", ",", "(") and (path := t.string(i + 2)) is not None:
            included = "include" in t.texts[i : t.close(i + 1)]
            yield t.lines[i], "route", f"ANY {joined('', path.strip('^$'))}", "include" if included else "pattern"
        elif t.texts[i] == "register" and t.text(i - 1) == "." and t.text(i + 1) == "(" and (path := t.string(i + 2)) is not None:
            for verb, tail in actions:
                yield t.lines[i], "route", f"{verb} {joined(path.strip('^$'), tail)}", "resource"


def _script_routes(t: Tokens) -> Iterator[Row]:
    known = {name: value for _, _, name, value in constants(t, "script")}
    controller = ""

    def parts_at(i: int) -> list[dict[str, str]]:
        """Strings and names joined by +, as far as they go; constants of this file are strings already."""
        out = []
        while True:
            own = t.string(i) if t.string(i) is not None else known.get(t.text(i))
            if own is None and not (t.is_name(i) and t.text(i + 1) in ("+", ",", ")")):
                return out
            out.append({"name": t.text(i)} if own is None else {"text": own})
            if t.text(i + 1) != "+":
                return out
            i += 2

    for i in range(len(t) - 2):
        if t.texts[i] == "." and t.text(i + 1) in (*VERBS, "all") and t.text(i + 2) == "(" and t.is_name(i - 1) and (parts := parts_at(i + 3)):
            verb = "ANY" if t.text(i + 1) == "all" else t.text(i + 1).upper()
            path = "".join(x["text"] for x in takewhile(lambda x: "text" in x, parts))
            own = f"{verb} {joined('', path)}" if path.startswith("/") else ""
            if own:
                yield t.lines[i], "route", own, "call"
            if any("name" in x for x in parts):
                yield t.lines[i], "open-route", verb, json.dumps({"known": own, "parts": parts}, ensure_ascii=False)
        elif t.texts[i] == "route" and t.text(i - 1) == "." and t.text(i + 1) == "(" and t.text(i + 2) == "{":
            end, found = t.close(i + 2), {}
            for k in range(i + 3, end):
                if t.text(k + 1) == ":" and t.texts[k] in ("method", "url", "path"):
                    found[t.texts[k]] = t.strings(k + 2, t.close(k + 2) + 1) if t.text(k + 2) == "[" else [t.string(k + 2) or ""]
            for m in found.get("method", ["ANY"]):
                yield t.lines[i], "route", f"{m.upper()} {joined('', (found.get('url') or found.get('path') or [''])[0])}", "object"
        elif t.texts[i] == "@" and t.text(i + 2) == "(":
            if t.text(i + 1) == "Controller":
                controller = t.string(i + 3) or ""
            elif t.text(i + 1).lower() in (*VERBS, "all") and t.text(i + 1)[:1].isupper():
                verb = t.text(i + 1).upper()
                yield t.lines[i], "route", f"{'ANY' if verb == 'ALL' else verb} {joined(controller, t.string(i + 3) or '')}", "controller"


def _go_routes(t: Tokens) -> Iterator[Row]:
    groups: dict[str, str] = {}
    for i in range(len(t) - 2):
        if t.texts[i] == "." and t.text(i + 2) == "(" and (path := t.string(i + 3)) is not None:
            owner, name = t.text(i - 1), t.text(i + 1)
            if name in ("Group", "PathPrefix", "Route") and t.text(i - 2) == "=":
                made = t.text(i - 4) if t.text(i - 3) == ":" else t.text(i - 3)
                groups[made] = joined(groups.get(owner, ""), path)
            elif name in ("HandleFunc", "Handle"):
                tail, end = "ANY", t.close(i + 2)
                if t.text(end + 1) == "." and t.text(end + 2) == "Methods":
                    tail = (t.strings(end + 3, t.close(end + 3)) or ["ANY"])[0]
                yield t.lines[i], "route", f"{tail} {joined(groups.get(owner, ''), path)}", "handler"
            elif name.lower() in VERBS and name[:1].isupper():
                yield t.lines[i], "route", f"{name.upper()} {joined(groups.get(owner, ''), path)}", "router"


def _annotated_routes(t: Tokens) -> Iterator[Row]:
    prefix, waiting = "", None
    for i in range(len(t) - 1):
        if t.texts[i] == "@" and t.is_name(i + 1):
            name, end = t.text(i + 1), t.close(i + 2) if t.text(i + 2) == "(" else i + 1
            paths = [p for p in t.strings(i + 2, end) if p.startswith("/") or p == ""] or [""]
            if name in ("RequestMapping", "Path"):
                verbs = [x for x in t.texts[i:end] if x.lower() in VERBS and x.isupper()]
                waiting = (t.lines[i], paths, verbs)
            elif name.removesuffix("Mapping").lower() in VERBS and name != name.upper():
                for p in paths:
                    yield t.lines[i], "route", f"{name.removesuffix('Mapping').upper()} {joined(prefix, p)}", "annotation"
            elif name.lower() in VERBS and name.isupper():
                yield t.lines[i], "route", f"{name} {joined(prefix, waiting[1][0] if waiting else '')}", "annotation"
                waiting = None
        elif t.texts[i] in ("class", "interface") and waiting:
            prefix, waiting = waiting[1][0], None
        elif t.texts[i] == "{" and waiting:
            line, paths, verbs = waiting
            for p in paths:
                for v in verbs or ["ANY"]:
                    yield line, "route", f"{v} {joined(prefix, p)}", "annotation"
            waiting = None


def _attribute_routes(t: Tokens) -> Iterator[Row]:
    waiting, prefix = None, ""
    for i in range(len(t) - 2):
        if t.texts[i] == "[" and t.is_name(i + 1):
            name, path = t.text(i + 1), t.string(i + 3) if t.text(i + 2) == "(" else None
            if name == "Route":
                waiting = path or ""
            elif name.startswith("Http") and name[4:].lower() in VERBS:
                yield t.lines[i], "route", f"{name[4:].upper()} {joined(prefix, path or '')}", "attribute"
        elif t.texts[i] == "class" and waiting is not None:
            prefix = waiting.replace("[controller]", t.text(i + 1).removesuffix("Controller").lower())
            waiting = None


def _php_routes(t: Tokens) -> Iterator[Row]:
    groups: list[tuple[int, str]] = []
    for i in range(len(t) - 2):
        while groups and i > groups[-1][0]:
            groups.pop()
        if t.texts[i] == "prefix" and t.text(i + 1) in ("(", "'"):
            opened = next((k for k in range(i, len(t)) if t.texts[k] in "{;"), len(t))
            if t.text(opened) == "{" and (p := t.string(i + 2)) is not None:
                groups.append((t.close(opened), p))
        elif t.texts[i] == "::" and t.text(i - 1) == "Route" and t.text(i + 1) in (*VERBS, "any") and (path := t.string(i + 3)) is not None:
            full = "/".join([*(p.strip("/") for _, p in groups), path.strip("/")])
            yield t.lines[i], "route", f"{t.text(i + 1).upper()} {joined('', full)}", "group" if groups else "facade"


def _ruby_routes(t: Tokens) -> Iterator[Row]:
    for i in range(len(t) - 1):
        begins = i == 0 or t.lines[i - 1] < t.lines[i]
        if begins and t.texts[i] in VERBS and (path := t.string(i + 1)) is not None:
            yield t.lines[i], "route", f"{t.texts[i].upper()} {joined('', path)}", "block" if "do" in t.texts[i : i + 4] else "verb"
        elif begins and t.texts[i] == "resources" and t.text(i + 1) == ":" and t.is_name(i + 2):
            for _, verb, one in ACTIONS:
                yield t.lines[i], "route", f"{verb} {joined(t.text(i + 2), ':id' if one else '')}", "resource"


def _rust_routes(t: Tokens) -> Iterator[Row]:
    for i in range(len(t) - 2):
        if t.texts[i] == "#" and t.text(i + 1) == "[" and t.text(i + 2) in VERBS and (path := t.string(i + 4)) is not None:
            yield t.lines[i], "route", f"{t.text(i + 2).upper()} {joined('', path)}", "macro"
        elif t.texts[i] == "route" and t.text(i - 1) == "." and t.text(i + 1) == "(" and (path := t.string(i + 2)) is not None:
            for k in range(i + 3, t.close(i + 1)):
                if t.texts[k] in VERBS and t.text(k + 1) == "(":
                    yield t.lines[i], "route", f"{t.texts[k].upper()} {joined('', path)}", "builder"


def inherits(t: Tokens, family: str) -> Iterator[Row]:
    """(line, 'base', class, base) for classes that name what they come from."""
    for i in range(len(t) - 2):
        if t.texts[i] != "class" or not t.is_name(i + 1):
            continue
        j = i + 2
        if family == "python" and t.text(j) == "(":
            for k in range(j + 1, t.close(j)):
                if t.is_name(k) and t.text(k - 1) in ("(", ",") and t.text(k + 1) in (",", ")"):
                    yield t.lines[i], "base", t.texts[i + 1], t.texts[k]
        elif family == "ruby" and t.text(j) == "<" or family in ("java", "script", "php") and t.text(j) == "extends" or family == "sharp" and t.text(j) == ":":
            if t.is_name(j + 1):
                yield t.lines[i], "base", t.texts[i + 1], t.texts[j + 1]


READERS = (declarations, imports, calls, tables, routes, constants, inherits)
SCHEMA = "path string, line int, kind string, name string, detail string"


def extract(files: DataFrame, path: str = "path", text: str = "content", readers: tuple[Callable, ...] = READERS) -> DataFrame:
    """(path, line, kind, name, detail) of all that the readers find; equal rows of a file once."""

    def read(content: str, family: str) -> Iterator[Row]:
        tokens = Tokens(content, family)
        return dict.fromkeys(row for reader in readers for row in reader(tokens, family))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(read)
        for batch in batches:
            rows: list[tuple] = []
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                family = FAMILIES.get((place or "").rpartition(".")[2].lower())
                if family and content:
                    rows += [(place, *row) for row in known(content, family)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["path", "line", "kind", "name", "detail"])

    return files.select(path, text).mapInArrow(run, SCHEMA)
