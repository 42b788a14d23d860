"""Byte-level BPE: encoding by merge replay, and decoding.

Every slice of a task's texts is cut into pieces at once, and only pieces that the task has not met
are encoded. Their merges are replayed over the whole set: an inverted index from token pair
to positions is taken in rank order, each merge is applied at all its positions, and only the
pairs with touched neighbours are looked up again. A text's ids are then a gather by piece.

Null and empty texts have no ids. Special tokens do not exist here: their strings are text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns
from .textarrays import span_hashes, texts

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Code points with the White_Space property, and the endings split off after an apostrophe.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
SLICE = 2 << 20
#: Bytes of text that are cut into pieces at once: this takes many times their memory.
CUT = 1 << 20
#: Bytes of memory for pieces, of at most LONGEST bytes each, that a worker remembers before it starts over.
REMEMBERED, LONGEST = 32 << 20, 64

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    global _classes
    if _classes is None:
        points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
        everything = points.astype("<u4").tobytes().decode("utf-32-le")
        out = np.full(0x110000, OTHER, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, everything):
                out[points[m.start() : m.end()]] = kind
        out[WHITE_SPACE] = SPACE
        _classes = out
    return _classes


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pieces that the GPT-2 pattern cuts texts into, and each text's first piece.

    The pieces cover the texts without gaps. In terms of runs of one class: a run of letters,
    numbers or others is a piece and takes one blank before it; of a white-space run before
    something else the last character is set apart; an apostrophe that starts a piece takes
    one of the endings from the letters behind it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head).astype(np.int32)  # byte offset of each character
    raw = data.tobytes()
    if len(at) == n:
        points = data.astype(np.uint32)
    else:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype="<u4")
    kind = classes()[points]
    m = len(points)
    first = np.searchsorted(at, bounds)  # first character of each text
    opens = np.zeros(m + 1, dtype=bool)
    opens[first] = True
    start = np.zeros(m, dtype=bool)  # starts of runs
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= opens[:m]
    cut = start.copy()
    white = kind == SPACE
    # the last white-space character before another run of the same text starts a piece
    last = np.zeros(m, dtype=bool)
    last[:-1] = white[:-1] & ~white[1:] & ~opens[1:m]
    cut |= last
    # a blank there joins the run behind it
    joined = last & (points == 32)
    cut[1:][joined[:-1]] = False
    # endings
    quote = np.flatnonzero((points == 39) & cut)
    if len(quote):
        padded = np.zeros(m + 3, dtype=np.uint32)
        padded[:m] = points
        begin = np.zeros(m + 3, dtype=bool)
        begin[: m + 1] = opens
        begin[m:] = True
        taken = np.zeros(len(quote), dtype=bool)
        for ending in ENDINGS:
            hit = ~taken
            for j, c in enumerate(ending, 1):
                hit = hit & (padded[quote + j] == ord(c)) & ~begin[quote + j]
            where = quote[hit]
            cut[where + 1] = False
            behind = where + len(ending) + 1
            inside = behind < m
            cut[behind[inside]] |= kind[behind[inside]] == LETTER
            taken |= hit
    starts = np.flatnonzero(cut)
    return at[starts], np.searchsorted(starts, first)


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file, each line a base64 token and its rank; read by the driver."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Ranks, and for each pair of tokens the rank of what they make."""

    def __init__(self, content: bytes) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for t, r in self.rank.items():
            token[r] = t
        self.lengths = np.fromiter(map(len, token), dtype=np.int64, count=size)
        self.offsets = np.r_[0, np.cumsum(self.lengths)]
        self.flat = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = np.fromiter((x for t, r in self.rank.items() for x in self._splits(t, r)), dtype=np.int32).reshape(-1, 3)
        left, right, made = pairs.T
        # tokens that are part of one of a lower rank: making one may call for another merge first
        self.early = np.zeros(size, dtype=bool)
        self.early[left[made < left]] = self.early[right[made < right]] = True
        self.twin = np.full(size, -1, dtype=np.int32)  # what a token makes with itself
        self.twin[left[left == right]] = made[left == right]
        # for each token the partners behind it and in front of it, sorted, and what it makes with them
        self.behind, self.front = self._partners(left, right, made, size), self._partners(right, left, made, size)
        of_bytes = np.full((size, 1), 256)
        of_bytes[self.byte, 0] = np.arange(256)
        self.first = np.full((257, 257), -1, dtype=np.int32)
        self.first[of_bytes[left, 0], of_bytes[right, 0]] = made
        self.first[256], self.first[:, 256] = -1, -1

    @staticmethod
    def _partners(of: np.ndarray, partner: np.ndarray, made: np.ndarray, size: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        order = np.lexsort((partner, of))
        return np.searchsorted(of[order], np.arange(size + 1)).tolist(), partner[order].copy(), made[order].copy()

    def _splits(self, t: bytes, r: int) -> Iterator[int]:
        """Left and right of each pair of tokens that makes a token, and its rank."""
        for i in range(1, len(t)):
            left, right = self.rank.get(t[:i]), self.rank.get(t[i:])
            if left is not None and right is not None:
                yield from (left, right, r)

    @staticmethod
    def made_with(table: tuple[list[int], np.ndarray, np.ndarray], r: int, others: np.ndarray) -> np.ndarray | None:
        """What token r makes with each of the others, -1 for nothing; None if it makes nothing at all."""
        a, b = table[0][r], table[0][r + 1]
        if a == b:
            return None
        partner = table[1][a:b]
        i = np.minimum(np.searchsorted(partner, others), b - a - 1)
        return np.where(partner[i] == others, table[2][a:b][i], np.int32(-1))

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and each word's first.

        Ranks are taken in order, each at all its positions at once; of positions that overlap (a a a) every second
        one from the left. Where a merge makes a pair of a lower rank, only the word's first position is merged
        and the others wait until that pair is done.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        token = self.byte[data]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        rank = np.full(n, -1, dtype=np.int32)  # of the pair that starts at a position
        paired = np.flatnonzero(after >= 0)
        rank[paired] = self.first[data[paired], data[paired + 1]]
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(positions: np.ndarray) -> None:
            """File positions under their pairs' ranks."""
            positions = positions[rank[positions] >= 0]
            if not len(positions):
                return
            ranks = rank[positions]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                r = int(ranks[a])
                if r in index:
                    index[r].append(positions[a:b])
                else:
                    index[r] = [positions[a:b]]
                    heapq.heappush(queue, r)

        enter(paired)
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = np.sort(at[rank[at] == r])
            if not len(at):
                continue
            fresh = at[1:] != at[:-1]
            if not fresh.all():
                at = at[np.r_[True, fresh]]
            # a position overlaps the one before it if that one's right half is its own left half
            follows = after[at[:-1]] == at[1:]
            now = at
            if follows.any():
                follows = np.r_[False, follows]
                head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                now = at[(np.arange(len(at)) - head) % 2 == 0]
            right, left = after[now], before[now]
            beyond = after[right]
            # ranks of the pairs with the neighbours; -1 is no token, and nobody's partner
            behind = self.made_with(self.behind, r, np.where(beyond < 0, -1, token[beyond]))
            front = self.made_with(self.front, r, np.where(left < 0, -1, token[left]))
            twin = int(self.twin[r])
            if self.early[r] and (behind is not None or front is not None):
                low = np.zeros(len(now), dtype=bool)
                for got in (behind, front):
                    if got is not None:
                        low |= (got >= 0) & (got < r)
                if 0 <= twin < r:
                    low[:-1] |= beyond[:-1] == now[1:]
                if low.any():  # those words merge their first position alone; the others wait behind what is lower
                    held = np.isin(word[now], word[now[low]])
                    keep = ~held
                    keep[np.flatnonzero(held)[np.unique(word[now[held]], return_index=True)[1]]] = True
                    enter(np.setdiff1d(at[np.isin(word[at], word[now[held]])], now[keep]))
                    now, right, left, beyond = now[keep], right[keep], left[keep], beyond[keep]
                    behind, front = (None if x is None else x[keep] for x in (behind, front))
            beside = np.flatnonzero(beyond[:-1] == now[1:])  # merged positions side by side
            if len(beside):
                if behind is not None:
                    behind[beside] = twin
                if front is not None:
                    front[beside + 1] = twin
                left[beside + 1] = now[beside]
            token[now] = r
            token[right] = -1
            rank[right] = -1
            after[now] = beyond
            some = beyond >= 0
            before[beyond[some]] = now[some]
            before_it = left >= 0
            left = left[before_it]
            rank[left] = -1 if front is None else front[before_it]
            rank[now] = -1 if behind is None else behind
            if len(beside):
                rank[now[beside]] = twin
            touched = [x for x, got in ((now, behind), (left, front)) if got is not None]
            if touched:
                enter(np.concatenate(touched))
        alive = token >= 0
        return token[alive].astype(np.uint32), np.r_[0, np.cumsum(np.bincount(word[alive], minlength=len(words)))]


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the parts of ``flat`` named by ``which``; also where each begins."""
    lengths = offsets[which + 1] - offsets[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets[which] - (ends - lengths), lengths) + np.arange(total)], np.r_[0, ends]


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of one byte array has the bytes of its partner in another."""
    out = ends - starts == other_ends - other_starts
    length = np.where(out, ends - starts, 0).astype(np.int64)
    before = np.cumsum(length) - length
    offset = np.arange(int(length.sum())) - np.repeat(before, length)
    differ = np.flatnonzero(data[np.repeat(starts, length) + offset] != other[np.repeat(other_starts, length) + offset])
    out[np.searchsorted(before + length, differ, side="right")] = False
    return out


def text_ranges(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` values each; a longer text is a range of its own."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An example of each distinct piece, which of them each piece is, the pieces' ends and the distinct hashes, in order.

    Without ``ends`` a piece goes to the next one's start. Hashes of pieces of one length are exact up to eight bytes; longer pieces are compared with their examples, and
    should two differ, they are told apart by their bytes and get hashes of their own.
    """
    if ends is None:
        ends = np.r_[starts[1:], len(data)].astype(starts.dtype)
    hashes, example, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    long = np.flatnonzero((ends - starts > 8) & (example[which] != np.arange(len(starts))))
    other = example[which[long]]
    if not equal_spans(data, starts[long], ends[long], data, starts[other], ends[other]).all():
        raw = data.tobytes()
        own: dict[bytes, int] = {}
        digest = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8, person=b"apart").digest(), "little")
        apart = np.fromiter((own.setdefault(x, digest(x)) for x in (raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))), dtype=np.uint64, count=len(starts))
        hashes, example, which = np.unique(apart, return_index=True, return_inverse=True)
    return example, which, ends, hashes


class Encoder:
    """Encodes slices of texts; remembers the ids of pieces that it has met."""

    def __init__(self, content: bytes, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.remembered = Vocabulary(content), remembered
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of pieces, sorted, and where they are
        self.ids, self.id_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.flat, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # their bytes

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and each word's first: tokens have their own, others are replayed."""
        rank = self.vocabulary.rank
        whole = np.fromiter((rank.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        todo = np.flatnonzero(whole < 0)
        ids, first = self.vocabulary.replay([words[i] for i in todo.tolist()])
        counts = np.ones(len(words), dtype=np.int64)
        counts[todo] = np.diff(first)
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        single = np.repeat(whole >= 0, counts)
        out[single], out[~single] = whole[whole >= 0], ids
        return out, np.r_[0, np.cumsum(counts)]

    def learn(self, hashes: np.ndarray, words: list[bytes], ids: np.ndarray, first: np.ndarray) -> None:
        """Remember pieces with their ids."""
        base = len(self.id_ends) - 1
        self.id_ends = np.r_[self.id_ends, len(self.ids) + first[1:]]
        self.ids = np.r_[self.ids, ids]
        self.ends = np.r_[self.ends, len(self.flat) + np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))]
        self.flat = np.r_[self.flat, np.frombuffer(b"".join(words), dtype=np.uint8)]
        known = np.r_[self.known, hashes]
        by = np.argsort(known, kind="stable")  # merges two sorted runs in linear time
        self.known, self.place = known[by], np.r_[self.place, np.arange(base, base + len(words), dtype=np.int32)][by]

    def size(self) -> int:
        return sum(x.nbytes for x in (self.known, self.place, self.ids, self.id_ends, self.flat, self.ends))

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces on end, and each one's first; what is not known, byte for byte, is looked up and learnt."""
        i = np.searchsorted(self.known, hashes)
        found = i < len(self.known)
        found[found] = self.known[i[found]] == hashes[found]
        here = np.flatnonzero(found)
        at = self.place[i[here]]
        same = equal_spans(data, starts[here], ends[here], self.flat, self.ends[at], self.ends[at + 1])
        new = np.ones(len(hashes), dtype=bool)
        new[here[same]] = False
        at = at[same]
        fresh = np.flatnonzero(new)
        raw = data.tobytes() if len(fresh) else b""
        words = [raw[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
        ids, first = self.ids_of(words)
        counts = np.empty(len(hashes), dtype=np.int64)
        counts[new], counts[~new] = np.diff(first), self.id_ends[at + 1] - self.id_ends[at]
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        own = np.repeat(new, counts)
        out[own], out[~own] = ids, gather(self.ids, self.id_ends, at)[0]
        keep = np.flatnonzero(((ends - starts)[fresh] <= LONGEST) & ~found[fresh])
        if len(keep):
            kept_ids, kept_first = gather(ids, first, keep)
            self.learn(hashes[fresh[keep]], [words[j] for j in keep.tolist()], kept_ids, kept_first)
            if self.size() > self.remembered:
                self.forget()
        return out, np.r_[0, np.cumsum(counts)]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end (uint32), and each text's first."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        parts = []  # of some texts each: examples of their pieces, which of them each piece is, and each text's first piece
        for a, b in text_ranges(bounds, CUT):
            part = data[bounds[a] : bounds[b]]
            starts, first = pieces(part, bounds[a : b + 1] - bounds[a])
            if not len(starts):
                parts.append((starts, starts, starts, first))
                continue
            example, which, ends, _ = distinct_spans(part, starts)
            parts.append((starts[example] + bounds[a], ends[example] + bounds[a], which.astype(np.int32), first))
        # a replay of many new pieces costs little more than one of few, so it has those of all texts
        starts, ends = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        example, named, _, hashes = distinct_spans(data, starts, ends)
        table, offsets = self.look_up(data, starts[example], ends[example], hashes)
        out, begins, at, total = [], [np.zeros(1, np.int64)], 0, 0
        for examples, _, which, first in parts:
            ids, edges = gather(table, offsets, named[at : at + len(examples)][which])
            out.append(ids)
            begins.append(edges[first[1:]] + total)
            at, total = at + len(examples), total + len(ids)
        return np.concatenate(out), np.concatenate(begins)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, begins = gather(self.vocabulary.flat, self.vocabulary.offsets, ids.astype(np.int64))
        return data, begins[bounds]


_encoders: dict[int, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """This worker's encoder for a rank file; it lives as long as the worker."""
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content)
    return _encoders[key]


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column from bytes and boundaries."""
    offsets = pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, rank_path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids``: each whole text's token ids as little-endian unsigned 32-bit integers (binary).

    With ``decoded``, also the bytes that those ids stand for, which equal the text's. The rank file
    is read by the driver and broadcast (its size is fixed by the vocabulary).
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    fields = [T.StructField(name, T.BinaryType()) for name in (ids, decoded) if name]

    def make() -> Callable[[pa.RecordBatch], list]:
        own = encoder(shared.value)

        def step(piece: pa.RecordBatch) -> list:
            values, bounds = own.encode(*texts(piece.column(text)))
            out = [binaries(values.astype("<u4", copy=False).view(np.uint8), bounds * 4)]
            if decoded:
                out.append(binaries(*own.decode(values, bounds)))
            return out

        return step

    return append_columns(docs, make, fields, text, SLICE)


def decode(frame: DataFrame, rank_path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes of a column of ids as ``encode`` makes it; null ids give no bytes."""
    shared = frame.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def make() -> Callable[[pa.RecordBatch], list]:
        own = encoder(shared.value)

        def step(piece: pa.RecordBatch) -> list:
            data, bounds = texts(piece.column(ids))
            return [binaries(*own.decode(np.frombuffer(data.tobytes(), dtype="<u4"), bounds // 4))]

        return step

    return append_columns(frame, make, [T.StructField(decoded, T.BinaryType())], ids, SLICE)


def encode_texts(values: Iterable[str], content: bytes) -> list[list[int]]:
    """Ids of a few texts, without Spark; for tests and small checks."""
    ids, bounds = encoder(content).encode(*texts(pa.array(list(values), pa.string())))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
