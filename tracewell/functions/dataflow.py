"""What flows where inside each function of a program text, as rows that joins across files can follow.

A file is cut into the tokens of ``lines``; functions are spans of tokens, statements end at line ends and marks, and each
statement gives rows: a name set from names, an input, an argument of a call, what a function returns, a dangerous
call. A call stands for itself as a name of its own, ``<call n>``, so nested calls need no order. The order of
statements within a function is not followed. Null and empty texts and unknown suffixes give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .lines import FAMILIES, Tokens
from .shapes import Remembered

#: Calls that are dangerous when an input reaches them, with their category.
SINKS = {
    "system": "process_execution", "popen": "process_execution", "Popen": "process_execution", "spawn": "process_execution", "shell_exec": "process_execution", "passthru": "process_execution", "Command": "process_execution",
    "eval": "code_execution", "exec": "code_execution", "unserialize": "deserialization", "loads": "deserialization", "execute": "query", "executeQuery": "query", "raw": "query", "render_template_string": "template_render", "sendFile": "file_read",
}
#: Names that bring an input when one of the members follows; None: the name alone does, "(": called.
INPUTS = {
    "request": {"args", "form", "params", "query", "body", "json", "values", "cookies", "headers", "files", "GET", "POST"}, "req": {"query", "body", "params", "headers", "cookies"}, "argv": None, "_GET": None, "_POST": None, "_REQUEST": None, "_COOKIE": None,
    "input": "(", "readline": "(", "getParameter": "(", "FormValue": "(", "gets": "(",
}
_KEYWORDS = set("if for while switch catch return else elif def function func fn class const let var async await new public private protected static void in not and or is None True False null true false this self with as try except finally raise throw lambda yield import from".split())
_BLOCKS = {"if", "for", "while", "switch", "catch", "return", "new", "await", "and", "or", "not", "in", "with", "elif", "function"}
SCHEMA = "path string, fn string, line int, kind string, name string, used string, site int, slot int"
_TYPES = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())


def functions(t: Tokens, family: str) -> list[tuple[int, int, str, list[str]]]:
    """(first token of the body, token behind it, name, parameters) of every function with a body."""
    out = []
    for i in range(len(t) - 1):
        if not t.is_name(i) or t.text(i + 1) != "(" and t.text(i + 1) != "=":
            continue
        name, at = t.texts[i], i + 1
        if family in ("python", "ruby"):
            if t.text(i - 1) != "def" or t.text(at) != "(":
                continue
            close = t.close(at)
            body = close + 1
            end = next((k for k in range(body, len(t)) if t.lines[k] > t.lines[close] and t.first[k] <= t.first[i]), len(t))
        else:
            if t.text(at) == "=":  # a name for an arrow function
                at += 1 + (t.text(at + 1) == "async")
                if t.text(at) != "(" or t.text(t.close(at) + 1) != "=>":
                    continue
                close = t.close(at) + 1
            else:
                if name in _BLOCKS or t.text(i - 1) in (".", "new", "::", "->"):
                    continue
                close = t.close(at)
            body = next((k for k in range(close + 1, min(close + 8, len(t))) if t.texts[k] in ("{", ";", ")", "=")), len(t))
            if t.text(body) != "{":
                continue
            end = t.close(body) + 1
        out.append((body, end, name, parameters(t, at, family)))
    return out


def parameters(t: Tokens, opened: int, family: str) -> list[str]:
    last = family in ("java", "sharp", "php")  # the type stands before the name
    out = []
    for a, b in arguments(t, opened):
        stop = next((k for k in range(a, b) if t.texts[k] in ("=", ":")), b)
        names = [t.texts[k] for k in range(a, stop) if t.is_name(k)]
        if names:
            out.append(names[-1] if last else names[0])
    return out


def arguments(t: Tokens, opened: int) -> list[tuple[int, int]]:
    """Token spans of what commas part within the bracket at ``opened``."""
    end, out, depth, start = t.close(opened), [], 0, opened + 1
    for k in range(opened + 1, end):
        depth += (t.texts[k] in "([{") - (t.texts[k] in ")]}")
        if t.texts[k] == "," and not depth:
            out.append((start, k))
            start = k + 1
    if start < end:
        out.append((start, end))
    return out


class Reader:
    """Rows of one file."""

    def __init__(self, path: str, text: str, family: str) -> None:
        self.path, self.t = path, Tokens(text, family)
        self.rows: list[tuple] = []
        self.owner = [""] * len(self.t)
        spans = functions(self.t, family)
        for body, end, name, names in sorted(spans, key=lambda s: s[0] - s[1]):  # inner ones later, so they win
            line = self.t.lines[min(body, len(self.t) - 1)]
            key = f"{name}@{line}"
            self.owner[body:end] = [key] * (end - body)
            self.rows.append((path, key, line, "function", name, None, None, self.t.lines[end - 1] if end > body else line))
            self.rows += [(path, key, line, "param", p, None, None, k) for k, p in enumerate(names)]
        for a, b in self.statements():
            self.statement(a, b)

    def put(self, at: int, kind: str, name: str | None = None, used: str | None = None, site: int | None = None, slot: int | None = None) -> None:
        self.rows.append((self.path, self.owner[at], self.t.lines[at], kind, name, used, site, slot))

    def statements(self) -> Iterator[tuple[int, int]]:
        t, start, depth = self.t, 0, 0
        for i, text in enumerate(t.texts):
            fresh = i > start and not depth and t.lines[i] > t.lines[i - 1]
            if fresh or text in (";", "{", "}") and depth <= 0 or i > start and self.owner[i] != self.owner[start]:
                if i > start:
                    yield start, i
                start, depth = (i, depth if not fresh else 0) if text not in (";", "{", "}") else (i + 1, 0)
            depth += (text in "([") - (text in ")]")
        if start < len(t):
            yield start, len(t)

    def statement(self, a: int, b: int) -> None:
        t = self.t
        if t.texts[a] in ("def", "function", "func", "fn", "class", "import", "from", "package", "using"):
            return
        if t.texts[a] == "return":
            for name in self.expression(a + 1, b):
                self.put(a, "return", used=name)
            return
        depth, equals = 0, None
        for k in range(a, b):
            depth += (t.texts[k] in "([") - (t.texts[k] in ")]")
            if t.texts[k] == "=" and not depth and t.text(k + 1) != "=" and t.text(k - 1) not in ("=", "!", "<", ">"):
                equals = k
                break
        names = self.expression(b if equals is None else equals + 1, b) if equals is not None else self.expression(a, b)
        if equals is None:
            return
        targets = [t.texts[k] for k in range(a, equals) if t.is_name(k) and t.text(k - 1) != "." and t.texts[k] not in _KEYWORDS]
        for target in targets:
            for name in names:
                self.put(a, "assign", target, name)

    def expression(self, a: int, b: int) -> list[str]:
        """Names that the value of these tokens may hold; calls and inputs within them give rows."""
        t, out, k = self.t, [], a
        while k < b:
            if not t.is_name(k):
                k += 1
                continue
            word, after = t.texts[k], t.text(k + 1)
            asked = INPUTS.get(word, "")
            if asked is None or asked == "(" == after or isinstance(asked, set) and after in (".", "->") and t.text(k + 2) in asked:
                source = f"<input {t.lines[k]}>"
                self.put(k, "input", source)
                out.append(source)
                k = t.close(k + 1) + 1 if after == "(" else k + (1 if asked is None else 3)
                continue
            if after == "(" and word not in _KEYWORDS:
                site = f"<call {k}>"
                close = min(t.close(k + 1), b - 1)
                self.put(k, "call", word, site=k)
                for slot, (x, y) in enumerate(arguments(t, k + 1)):
                    named = t.is_name(x) and t.text(x + 1) == "=" and t.text(x + 2) != "="
                    for name in dict.fromkeys(self.expression(x + 2 if named else x, min(y, b))):
                        self.put(k, "arg", word, name, k, slot)
                        if word in SINKS:
                            self.put(k, "sink", SINKS[word], name, k)
                if t.text(k - 1) == "." and out and t.is_name(k - 2):
                    self.put(k, "arg", word, out.pop(), k, -1)  # what it is called on
                out.append(site)
                k = close + 1
                continue
            if t.text(k - 1) not in (".", "->", "::") and word not in _KEYWORDS:
                out.append(word)
            k += 1
        return list(dict.fromkeys(out))


def closed(rows: list[tuple]) -> list[tuple]:
    """Rows of one file without assignments: what is used names the params, inputs and calls of its function that it may come from."""
    starts, into = set(), {}
    for _, fn, _, kind, name, used, site, _ in rows:
        if kind in ("param", "input"):
            starts.add((fn, name))
        elif kind == "call":
            starts.add((fn, f"<call {site}>"))
        elif kind == "assign":
            into.setdefault((fn, name), []).append((fn, used))

    def sources(place: tuple[str, str]) -> list[str]:
        seen, front = {place}, [place]
        while front:
            fresh = [x for y in front for x in into.get(y, ()) if x not in seen]
            seen.update(fresh)
            front = fresh
        return sorted(name for at, name in seen if (at, name) in starts)

    known: dict[tuple[str, str], list[str]] = {}
    out = []
    for row in rows:
        if row[3] in ("arg", "return", "sink"):
            place = row[1], row[5]
            if place not in known:
                known[place] = sources(place)
            out += [(*row[:5], used, *row[6:]) for used in known[place]]
        elif row[3] != "assign":
            out.append(row)
    return out


def facts(files: DataFrame, path: str = "path", text: str = "content", direct: bool = False, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(path, fn, line, kind, name, used, site, slot) of all files; equal rows of a file once.

    ``fn`` is the function's name and the line where its body begins, empty outside of functions; kinds are function (slot: last line),
    param, assign, input, call, arg (slot -1: what a method is called on), return and sink. With ``direct`` the assignments of a file are
    followed while it is read and left out; flows are the same, provided that each path is one row. ``kinds``: only these are told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow = closed if direct else list
        known = Remembered(lambda content, family: dict.fromkeys(row[1:] for row in follow(Reader("", content, family).rows) if kinds is None or row[3] in kinds))
        for batch in batches:
            rows: list[tuple] = []
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                family = FAMILIES.get((place or "").rpartition(".")[2].lower())
                if family and content and family != "sql":
                    rows += [(place, *row) for row in known(content, family)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TYPES, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select(path, text).mapInArrow(run, SCHEMA)
