"""Objects in text that people or programs wrote nearly as JSON.

A reader goes through the text once with a stack of open objects and lists. Besides JSON it takes: quotes of any kind, bare keys, the
constants of other languages, comments, a comma too many. A quote ends a string only where a comma, colon or bracket may
follow, so apostrophes inside stand. What is not closed is no object, and neither is anything deeper than ``DEPTH``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

DEPTH = 100
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "„": "“", "`": "`"}
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "nil": None, "undefined": None}
_BLANK = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_WORD = re.compile(r"[^\W\d][\w$-]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_THOUGHT = re.compile(r"<think(?:ing)?>")
_END = {"{": "}", "[": "]"}


def quoted(text: str, i: int) -> tuple[str, int] | None:
    """The string that opens at i, and the place behind it."""
    closer, out, k = _QUOTES[text[i]], [], i + 1
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            if text[k + 1] == "u" and re.match(r"[0-9a-fA-F]{4}", text[k + 2 : k + 6]):
                out.append(chr(int(text[k + 2 : k + 6], 16)))
                k += 6
            else:
                out.append(_ESCAPES.get(text[k + 1], text[k + 1]))
                k += 2
            continue
        if c in (closer, text[i]):
            after = _BLANK.match(text, k + 1).end()
            if after == len(text) or text[after] in ",:}]":
                return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace"), k + 1
        out.append(c)
        k += 1
    return None


def read(text: str, i: int) -> tuple[Any, int] | None:
    """The object or list that opens at i, and the place behind it; None if none can be read there."""
    stack: list[list] = []  # [bracket, what it holds so far, key that waits for its value]
    while True:
        i = _BLANK.match(text, i).end()
        if i >= len(text):
            return None
        c, top = text[i], stack[-1] if stack else None
        if top and c == _END[top[0]] and top[2] is None:
            stack.pop()
            value, i = top[1], i + 1
        elif c in _END and (not top or top[0] == "[" or top[2] is not None):
            if len(stack) >= DEPTH:
                return None
            stack.append([c, {} if c == "{" else [], None])
            i += 1
            continue
        elif c in _QUOTES:
            found = quoted(text, i)
            if found is None:
                return None
            value, i = found
        elif m := _WORD.match(text, i):
            key_here = top and top[0] == "{" and top[2] is None
            if not key_here and m[0] not in _WORDS:
                return None
            value, i = (m[0] if key_here else _WORDS[m[0]]), m.end()
        elif m := _NUMBER.match(text, i):
            value, i = (float(m[0]) if re.search("[.eE]", m[0]) else int(m[0])), m.end()
        else:
            return None
        if not stack:
            return value, i
        holder = stack[-1]
        i = _BLANK.match(text, i).end()
        if holder[0] == "{" and holder[2] is None:
            if i >= len(text) or text[i] != ":":
                return None
            holder[2], i = (str(value),), i + 1
            continue
        if holder[0] == "{":
            holder[1][holder[2][0]] = value
            holder[2] = None
        else:
            holder[1].append(value)
        if i < len(text) and text[i] == ",":
            i += 1
        elif i >= len(text) or text[i] != _END[holder[0]]:
            return None


def spans_of_thought(text: str) -> list[tuple[int, int]]:
    """Marked thoughts; one that is not closed is none."""
    out, at = [], 0
    while m := _THOUGHT.search(text, at):
        end = text.find(f"</{m[0][1:]}", m.end())
        at = m.end() if end < 0 else end + len(m[0]) + 1
        if end >= 0:
            out.append((m.start(), at))
    return out


def objects(text: str) -> Iterator[tuple[bool, dict]]:
    """(whether it begins in a code fence, object) of all outermost objects outside of marked thoughts."""
    thoughts, strict, i = spans_of_thought(text), json.JSONDecoder(), text.find("{")
    passed = fences = counted = 0
    while i >= 0:
        while passed < len(thoughts) and thoughts[passed][1] <= i:
            passed += 1
        if passed < len(thoughts) and thoughts[passed][0] <= i:
            i = text.find("{", thoughts[passed][1])
            continue
        try:
            found = strict.raw_decode(text, i)
        except (ValueError, RecursionError):
            found = read(text, i)
        if found is None:
            i = text.find("{", i + 1)
            continue
        fences, counted = fences + text.count("```", counted, i), i
        yield fences % 2 == 1, found[0]
        i = text.find("{", found[1])


def chosen(text: str | None, wanted: tuple[str, ...] = ()) -> dict | None:
    """The first object with one of the wanted keys, those in code fences before others; else the first. None if there is none."""
    found = sorted(objects(text or ""), key=lambda x: not x[0])
    return next((o for _, o in found if any(k in o for k in wanted)), found[0][1] if found else None)
