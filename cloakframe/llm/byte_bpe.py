"""Byte-level BPE: texts to token ids with byte offsets, and back.

The pattern that cuts a text into slices is never run as a regular expression.  Code
points are mapped to classes by a table; a look at the neighbours turns classes into nine
symbols, each a function from the eight states of a small automaton to the state behind
it.  Composition of functions is associative and the functions that can arise are few (a
finite monoid, closed once), so that a scan finds the state before every code point of a
whole batch at once: blocks are reduced side by side, block totals are scanned, and each
block is run from its own entry state.  A slice starts where state and symbol say so.

The slices tile the bytes of the batch; equal ones are found by Arrow, and each distinct
slice that is no token itself is merged pair by pair, the lowest rank first and the
leftmost of equals, long ones with a heap.  Merged slices are remembered in a bounded table of the
worker.  Token ends are kept as byte offsets: decoding writes every token's bytes to its
own place, and tokens a..b of a text are its bytes ``ends[a - 1] .. ends[b]``.

Defined cases: a null text counts as empty and gives no tokens; bytes that are no UTF-8
count as U+FFFD; rows are independent, so repeated rows and ids, nulls in other columns
and empty tables need nothing; a text longer than ``WINDOW`` code points is cut at a slice
start, behind which nothing depends on what was before, so memory beside the text itself
is bounded by the window and the longest slice.  Extra columns are left out by ``encode``.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.scratch import configure
from cloakframe.llm.streams import texts, tidy

#: Code points that are worked on together.
WINDOW = 1 << 21
#: Merged slices that a worker remembers, and the bytes of the longest that it does.
REMEMBERED, LONGEST = 400_000, 64
#: No rank.
NEVER = 1 << 40

# Classes of code points.
LETTER, NUMBER, OTHER, WHITE, BLANK, QUOTE = range(6)
# Code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols: a letter, a number, any other sign, a quote that one or two letters of a contraction follow, a blank that the
# next slice begins with, another white sign that is a slice of its own, white space that goes on with what is before, nothing.
L, N, O, Q1, Q2, JOIN, LONE, SPACE, NONE = range(9)
# States: a slice must start; inside letters, numbers, other signs, white space; behind a joining blank; one, two letters due.
FRESH, IN_L, IN_N, IN_O, IN_W, JOINED, DUE1, DUE2 = range(8)
#: Symbols from here on are those of a text's first code point; they forget what was before.
FIRST = 9


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state behind a symbol, and whether a slice starts at it."""
    if symbol == NONE:
        return state, False
    if symbol >= FIRST:
        return _step(FRESH, symbol - FIRST)
    if state == DUE2:
        return DUE1, False
    if state == DUE1:
        return FRESH, False
    if symbol == L:
        return IN_L, state not in (IN_L, JOINED)
    if symbol == N:
        return IN_N, state not in (IN_N, JOINED)
    if symbol in (O, Q1, Q2):
        if symbol == O or state in (IN_O, JOINED):
            return IN_O, state not in (IN_O, JOINED)
        return (DUE1, True) if symbol == Q1 else (DUE2, True)
    if symbol == JOIN:
        return JOINED, True
    if symbol == LONE:
        return FRESH, True
    return IN_W, state != IN_W


NEXT = np.array([[_step(q, s)[0] for s in range(2 * FIRST)] for q in range(8)], np.uint8)
STARTS = np.array([[_step(q, s)[1] for s in range(2 * FIRST)] for q in range(8)], bool)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols compose to (rows), each symbol's row, and which row two rows in turn are."""
    rows = [tuple(range(8))]
    place = {rows[0]: 0}
    symbols = [tuple(int(NEXT[q, s]) for q in range(8)) for s in range(2 * FIRST)]
    for f in rows:
        for g in symbols:
            both = tuple(g[x] for x in f)
            if both not in place:
                place[both] = len(rows)
                rows.append(both)
    then = np.array([[place[tuple(g[x] for x in f)] for g in rows] for f in rows], np.uint16)
    return np.array(rows, np.uint8), np.array([place[s] for s in symbols], np.uint16), then


FUNCTIONS, OF_SYMBOL, THEN = _monoid()


def _scan(elements: np.ndarray) -> np.ndarray:
    """For each element the composition of all before it."""
    n, m = len(elements), len(THEN)
    out = np.zeros(n, np.uint16)
    if n <= 64:
        for k in range(1, n):
            out[k] = THEN[out[k - 1], elements[k - 1]]
        return out
    width = int(np.ceil(np.sqrt(n)))
    cells = np.zeros(width * -(-n // width), np.uint16)
    cells[:n] = elements
    cells = np.ascontiguousarray(cells.reshape(-1, width).T)
    flat = THEN.ravel()
    total = np.zeros(cells.shape[1], np.uint16)
    for row in cells:
        total = flat[total.astype(np.int64) * m + row]
    held, found = _scan(total), np.empty_like(cells)
    for k, row in enumerate(cells):
        found[k] = held
        held = flat[held.astype(np.int64) * m + row]
    return np.ascontiguousarray(found.T).ravel()[:n]


def _states(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol: blocks are reduced, their totals scanned, and each block is run from its entry."""
    n, m = len(symbols), len(THEN)
    width = max(1, min(1024, int(np.sqrt(n))))
    cells = np.full(width * -(-n // width), NONE, np.uint8)
    cells[:n] = symbols
    cells = np.ascontiguousarray(cells.reshape(-1, width).T)
    flat, total = THEN.ravel(), np.zeros(cells.shape[1], np.uint16)
    for row in cells:
        total = flat[total.astype(np.int64) * m + OF_SYMBOL[row]]
    state, out = FUNCTIONS[_scan(total), FRESH], np.empty_like(cells)
    step = NEXT.ravel()
    for k, row in enumerate(cells):
        out[k] = state
        state = step[state.astype(np.int64) * NEXT.shape[1] + row]
    return np.ascontiguousarray(out.T).ravel()[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = WHITE
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


def slice_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which code points begin a slice; ``firsts``: places at which a text begins, ascending, the first of them 0."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[points]
    ends = np.zeros(n, bool)
    ends[firsts[1:] - 1] = ends[-1] = True
    symbols = np.array([L, N, O, SPACE, SPACE, O], np.uint8)[kind]
    white = (kind == WHITE) | (kind == BLANK)
    before_sign = np.zeros(n, bool)
    before_sign[:-1] = ~white[1:] & ~ends[:-1]
    last = white & before_sign
    symbols[last] = np.where(kind[last] == BLANK, JOIN, LONE)
    quotes = np.flatnonzero((kind == QUOTE) & before_sign)
    if len(quotes):
        a = points[quotes + 1]
        far = quotes + 2 < n
        b = np.where(far & ~ends[quotes + 1], points[np.minimum(quotes + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbols[quotes[one]], symbols[quotes[two]] = Q1, Q2
    symbols[firsts[firsts < n]] += FIRST
    return STARTS[_states(symbols), symbols]


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.remembered: dict[bytes, tuple[int, ...]] = {}
        size = max(self.ranks.values()) + 1
        self.bytes = [b""] * (size + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a slice: neighbours whose union has the lowest rank become one, until none has a rank."""
        if len(piece) > LONGEST:
            return self._merge_long(piece)
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != NEVER:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
        return [self.ranks[x] for x in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs, in n log n."""
        ranks, n = self.ranks, len(piece)
        ends = list(range(1, n + 1))  # end of the part that starts here, 0 once it has been swallowed
        before = list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if ends[a] != b or ends[b] != c:
                continue
            ends[a], ends[b] = c, 0
            if c < n:
                before[c] = a
                if (r := ranks.get(piece[a : ends[c]])) is not None:
                    heapq.heappush(heap, (r, a, c, ends[c]))
            if a and (r := ranks.get(piece[before[a] : c])) is not None:
                heapq.heappush(heap, (r, before[a], a, c))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : ends[at]]])
            at = ends[at]
        return out

    def ids(self, pieces: list[bytes]) -> list[Sequence[int]]:
        """Ids of slices; short merged ones are remembered."""
        out: list[Sequence[int]] = []
        known = self.remembered
        for piece, rank in zip(pieces, map(self.ranks.get, pieces), strict=True):
            if rank is not None:
                out.append((rank,))
                continue
            found = known.get(piece)
            if found is None:
                found = tuple(self.merge(piece))
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            out.append(found)
        return out

    def encode(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts, each as uint32."""
        out: list[list[np.ndarray]] = [[] for _ in raw]
        for owners, points, firsts in _windows(raw):
            for owner, ids in zip(owners, self._window(points, firsts), strict=True):
                out[owner].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint32), *x]) for x in out]

    def _window(self, points: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
        if not len(points):
            return [np.zeros(0, np.uint32)] * len(firsts)
        starts = np.flatnonzero(slice_starts(points, firsts))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate(([0], np.cumsum(width)))
        offsets = np.append(at[starts], at[-1]).astype(np.int32)
        data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        known = self.ids(found.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.uint32, int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        which = found.indices.to_numpy()
        count = sizes[which]
        ends = np.cumsum(count)
        ids = flat[np.repeat(begins[which] - (ends - count), count) + np.arange(ends[-1])]
        # texts begin at slices
        cut = np.concatenate(([0], ends))[np.searchsorted(starts, firsts)]
        return np.split(ids, cut[1:])

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets behind each token."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """Bytes of tokens, each written to its own place; ids outside the vocabulary hold none."""
        if not len(ids):
            return b""
        ids = np.minimum(ids.astype(np.int64), len(self.bytes) - 1)
        size = self.lengths[ids]
        begins = ends - size
        out = np.zeros(int(ends[-1]), np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begins, size) + inner] = self.joined[np.repeat(self.places[ids], size) + inner]
        return out.tobytes()


def _points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def _windows(raw: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of texts, code points, places where texts begin) of about ``WINDOW`` code points together."""
    owners: list[int] = []
    held: list[np.ndarray] = []
    n = 0

    def together() -> tuple[list[int], np.ndarray, np.ndarray]:
        sizes = [len(x) for x in held]
        return owners, np.concatenate(held), np.cumsum([0, *sizes])[:-1]

    for k, text in enumerate(raw):
        points = _points(text)
        while len(points) > WINDOW:
            part, points = _cut(points)
            yield [k], part, np.zeros(1, np.int64)
        if n + len(points) > WINDOW:
            yield together()
            owners, held, n = [], [], 0
        owners.append(k)
        held.append(points)
        n += len(points)
    if owners:
        yield together()


def _cut(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``points`` in two at a slice start behind about ``WINDOW`` code points.

    What a code point is depends on two behind it, so starts near the window's end are
    not trusted; white space depends on whether a sign follows, so the cut is behind a
    sign.  A slice longer than the window widens it.
    """
    size = WINDOW
    while size < len(points):
        starts = np.flatnonzero(slice_starts(points[:size], np.zeros(1, np.int64))[: size - 3])[1:]
        kind = _classes()[points[starts - 1]]
        starts = starts[(kind != WHITE) & (kind != BLANK)]
        if len(starts):
            return points[: starts[-1]], points[starts[-1] :]
        size *= 2
    return points, points[:0]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ends) of every row's ``text``.

    ``ids`` and ``ends`` are binary: little-endian unsigned 32-bit ids, and as many
    64-bit byte offsets behind the tokens.  ``path`` names a file of ranks that every
    executor can read.
    """
    configure(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for b in batches:
            found = known.encode(texts(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), pa.array([known.ends(x).astype("<i8").tobytes() for x in found], pa.binary())],
                ["doc_id", "n_tokens", "ids", "ends"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, ends binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of rows that ``encode`` made; null ids or ends give empty bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for b in batches:
            pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            out = [known.decode(np.frombuffer(i, "<u4"), np.frombuffer(e, "<i8")) if i and e else b"" for i, e in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids", "ends").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, decoded binary")
