"""Texts that differ in their numbers alone are read once: what a reader finds in one is written out for the others.

A text's shape has other digits in place of its own (decimal digits of other scripts, which the expressions of the readers
take for digits as well), one for each place of each different number, so equal numbers stay equal and lengths stay. What a
reader finds in a shape is a pattern: where it holds whole numbers of the text, those of another text go in. A text
that is not plain ASCII, has too many numbers or of whose numbers a reader takes parts is read as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from operator import itemgetter

_RUN = re.compile(r"[0-9]+")
_POOL = "".join(c for c in map(chr, range(0x80, 0xD800)) if unicodedata.category(c) == "Nd")
_FOREIGN = re.compile(rf"[{_POOL}]+")
#: Longer texts are read as they are; so many shapes are remembered in a task, and no more.
LONGEST, MOST = 4096, 4096

Read = Callable[[str, str], Iterable[tuple]]


class _Pattern:
    """Rows of a shape, as one format for all of their texts and the places of these."""

    __slots__ = ("format", "get", "rows", "texts")

    def __init__(self, rows: list[tuple], names: dict[str, str]) -> None:
        at = {name[0]: (i, name) for i, name in enumerate(names.values())}
        used: list[int] = []

        def whole(m: re.Match) -> str:
            held, k = m.group(), 0
            while k < len(held):
                i, name = at.get(held[k], (0, ""))
                if not name or not held.startswith(name, k):
                    raise ValueError("part of a number")
                used.append(i)
                k += len(name)
            return held

        every = list(dict.fromkeys(v for row in rows for v in row if isinstance(v, str)))
        text = "\0".join(every)
        _FOREIGN.sub(whole, text)
        text = text.replace("%", "%%")
        for name in names.values():  # no two share a character, so the order does not matter
            text = text.replace(name, "%s")
        self.format = text
        one = itemgetter(*used) if used else None
        self.get = None if one is None else one if len(used) > 1 else lambda runs: (one(runs),)
        self.texts = len(every)
        place = {v: k for k, v in enumerate(every)}
        # (place, value): texts by their place, anything else as it is
        self.rows = [tuple((place[v], None) if isinstance(v, str) else (-1, v) for v in row) for row in rows]

    def fill(self, runs: list[str]) -> list[tuple]:
        text = self.format % self.get(runs) if self.get else self.format % ()
        t = text.split("\0")
        return [tuple([t[i] if i >= 0 else v for i, v in row]) for row in self.rows]


class Remembered:
    """``read(text, family)``, whose rows follow from the text, with what it found for texts of one shape; null and numbers as values stay."""

    def __init__(self, read: Read) -> None:
        self.read, self.known = read, {}

    def __call__(self, text: str, family: str) -> Iterable[tuple]:
        if len(text) > LONGEST or not text.isascii() or "\0" in text:
            return self.read(text, family)
        names, at = {}, 0
        for run in _RUN.findall(text):
            if run not in names:
                names[run] = _POOL[at : at + len(run)]
                at += len(run)
        if at > len(_POOL):
            return self.read(text, family)
        shape = _RUN.sub(lambda m: names[m.group()], text)
        key = family, shape
        pattern = self.known.get(key, self)
        if pattern is self:
            rows = list(self.read(shape, family))
            try:
                pattern = _Pattern(rows, names) if rows else []
            except ValueError:
                pattern = None
            if len(self.known) < MOST:
                self.known[key] = pattern
        if pattern is None:
            return self.read(text, family)
        return pattern.fill(list(names)) if pattern else []
