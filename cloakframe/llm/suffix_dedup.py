"""Exact substring dedup with suffix arrays.

A byte goes if a ``LENGTH``-byte string covers it that also starts in a document with a
smaller id.  All is exact but for hash collisions of the candidate search, which can
only add work.

1. Anchors.  In each string of ``LENGTH`` bytes the ``GRAM``-byte gram with the least hash
   is an anchor, so equal strings have equal anchors, wherever they stand.  Each task
   asks once for every anchor hash of its block of texts; hashes are dealt to partitions,
   which answer those that other blocks have too.  Anchors that two documents of one
   block share need no answer.
2. Contexts.  Around each shared anchor stand all strings that chose it, ``WIDTH`` bytes.
   Equal contexts of a block are one, under its smallest id; later documents of the block
   lose these bytes at once.  Contexts are dealt by anchor hash.
3. Suffix array.  Each partition sorts the suffixes of its distinct contexts in two
   stages: those smaller than their successor (and each context's last) are sorted
   directly, all others are induced by scanning the buckets of first bytes in order.
   Common prefixes of neighbours then tell which strings are equal; a string whose
   smallest document comes before a context's own is removed there.
4. Intervals found for a document are joined and cut out.

An anchor that more than ``HOT`` blocks ask for is not sent as contexts but as single
strings, dealt by their own hash, so that a frequent line in ever new surroundings does
not meet in one partition.  Shuffled are anchors (about 7 bytes each, one for 18 bytes of
text), the texts once, and shared contexts.

Null and empty texts keep nothing and lose nothing.  Rows that repeat wholly are one document; rows
with one id but other texts do not remove from each other.  A null doc_id comes last,
and null ids do not remove from each other.  A very long text is hashed in steps of
``STEP`` bytes, with memory in proportion to its length.  Further columns may have any
name.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.scratch import columns, configure, fresh
from cloakframe.llm.streams import group_starts, texts, tidy, whole_groups

LENGTH = 50
GRAM = 16
#: Grams in a string of LENGTH bytes.
SPREAD = LENGTH - GRAM + 1
#: Bytes before an anchor that strings choosing it can take in.
BEFORE = LENGTH - GRAM
WIDTH = LENGTH + BEFORE
#: Starts of strings in a context.
STARTS = WIDTH - LENGTH + 1
#: Bytes of text that a task looks at together.
BLOCK = 12 << 20
#: Blocks that may ask for an anchor before it counts as hot.
HOT = 20_000
NO_ID = (1 << 63) - 1
#: Stands for the first byte of a context that is a single string.
ALONE = 255
#: Bytes of text whose hashes are computed at once (keeps numpy in cache).
STEP = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_LOW = np.uint64(63)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of each GRAM-byte gram along the last axis."""
    h = _BYTE[b]
    for p, m in zip((1, 2, 4, 8), _POW, strict=True):
        h = h[..., :-p] * m + h[..., p:]
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of one document's bytes, positions rising."""
    n = len(text)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    found, hashes = [], []
    for at in range(0, n - LENGTH + 1, STEP):
        to = min(at + STEP, n - LENGTH + 1)  # strings that start in [at, to)
        h = _gram_hashes(text[at : to + LENGTH - 1])
        # the low bits hold the place, which is unique within a string
        k = (h & ~_LOW) | (np.arange(at, at + len(h)).astype(np.uint64) & _LOW)
        m = k
        for p in (1, 2, 4, 8, 16):
            m = np.minimum(m[:-p], m[p:])
        m = np.minimum(m[: len(m) - (SPREAD - 32)], m[SPREAD - 32 :])
        new = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        start = new + at
        pos = start + ((m[new] & _LOW).astype(np.int64) - start & 63)
        found.append(pos)
        hashes.append(h[pos - at])
    pos, h = np.concatenate(found), np.concatenate(hashes)
    keep = np.concatenate(([True], pos[1:] != pos[:-1]))
    return pos[keep], h[keep]


# -- blobs --------------------------------------------------------------------


#: Parts of a blob that compress well.
_PACKED = frozenset(("d", "bytes", "row", "low", "high", "base", "start", "end"))


def _blob(**parts: np.ndarray) -> bytes:
    """Arrays as bytes; those that compress well are compressed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pickle.dumps({k: (str(v.dtype), v.shape, pack(np.ascontiguousarray(v).tobytes()) if k in _PACKED else np.ascontiguousarray(v).tobytes()) for k, v in parts.items()}, 4)


def _unblob(b: bytes) -> dict[str, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return {k: np.frombuffer(unpack(raw) if k in _PACKED else raw, kind).reshape(shape) for k, (kind, shape, raw) in pickle.loads(b).items()}


def _narrow(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint16 if not len(v) or v.max() < 1 << 16 else np.uint32)


def _row_batches(rows: Iterable[tuple[int, bytes]], name: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[1])
        if size > 4 << 20:
            yield _rows(held, name)
            held, size = [], 0
    if held:
        yield _rows(held, name)


def _rows(held: list[tuple[int, bytes]], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.binary())], [name, "blob"])


def _doc_rows(d: np.ndarray, t: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int32()), pa.array(data, pa.binary())], ["d", "t", "data"])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], list]]:
    """(d, t, texts, further column) of about BLOCK bytes of text."""
    d, t, docs, more, size = [], [], [], [], 0
    for b in batches:
        extra = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
        for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), extra, strict=True):
            d.append(x[0])
            t.append(x[1])
            docs.append(x[2])
            more.append(x[3])
            size += len(x[2])
            if size >= BLOCK or len(d) >= 60_000:
                yield np.array(d, np.int64), np.array(t, np.int32), docs, more
                d, t, docs, more, size = [], [], [], [], 0
    if d:
        yield np.array(d, np.int64), np.array(t, np.int32), docs, more


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.empty(0, np.int64)


def _by_group(key: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of each distinct key."""
    if len(key):
        order = np.argsort(key, kind="stable")
        yield from np.split(order, _starts(key[order])[1:])


# -- 1: which anchors are shared ----------------------------------------------


def ask(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of_block(block: int, d: np.ndarray, t: np.ndarray, docs: list[bytes]) -> Iterator[tuple[int, bytes]]:
        found = [anchors(np.frombuffer(x, np.uint8))[1] for x in docs]
        counts = np.array([len(x) for x in found])
        h = np.concatenate(found)
        if not len(h):
            return
        row = np.repeat(np.arange(len(d)), counts)
        nth = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.argsort(h, kind="stable")
        h, row, nth = h[order], row[order], nth[order]
        start = _starts(h)
        size = np.diff(np.append(start, len(h)))
        local = np.minimum.reduceat(row, start) != np.maximum.reduceat(row, start)
        known = np.repeat(local, size)
        if known.any():
            docs_in, own = np.unique(row[known], return_inverse=True)
            group = np.repeat(np.arange(int(local.sum())), size[local])
            code = _code(h[start][local], parts)
            yield int(h[0] % np.uint64(parts)), _blob(block=np.array([block]), code=code, group=_narrow(group), d=d[docs_in], t=t[docs_in], row=_narrow(own), nth=_narrow(nth[known]))
        # of anchors known to be shared, others are told once
        first = np.zeros(len(h), bool)
        first[start] = True
        sent = ~known | first
        h, row, nth, known = h[sent], row[sent], nth[sent], known[sent]
        part = ((h & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)
        short = h >> np.uint64(24)
        for at in _by_group(part):
            gap = np.diff(short[at], prepend=np.uint64(0))
            docs_in, own = np.unique(row[at], return_inverse=True)
            gap = gap.astype(np.uint32) if gap.max() < 1 << 32 else gap
            yield int(part[at[0]]), _blob(block=np.array([block]), gap=gap, d=d[docs_in], t=t[docs_in], row=_narrow(own), nth=_narrow(nth[at]), known=np.packbits(known[at]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        yield from _row_batches((r for k, (d, t, docs, _) in enumerate(_blocks(batches)) for r in of_block(task + k, d, t, docs)), "p")

    return run


def _code(h: np.ndarray, parts: int) -> np.ndarray:
    """What an answering partition knows of a hash: its upper 40 bits and the partition."""
    return h >> np.uint64(24) << np.uint64(24) | (h & np.uint64(0xFFFFFF)) % np.uint64(parts)


def answer(parts: int, hot: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block the numbers of its shared anchors, those of hot ones as -1 - number.

    For what blocks know to be shared themselves: that, and which of it is hot.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, block, row, nth, known, asked = [], [], [], [], [], []
        here = 0
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = _unblob(raw)
                if "gap" not in x:
                    yield _block_row(int(x["block"][0]), raw)
                    continue
                here = p
                n = len(x["gap"])
                short.append(np.cumsum(x["gap"].astype(np.uint64)))
                block.append(np.full(n, len(block), np.int32))
                row.append(x["row"])
                nth.append(x["nth"].astype(np.int32))
                known.append(np.unpackbits(x["known"], count=n).astype(bool))
                asked.append((int(x["block"][0]), x["d"], x["t"]))
        if not short:
            return
        h = np.concatenate(short)
        order = np.argsort(h, kind="stable")
        h = h[order]
        block, row, nth, known = (np.concatenate(v)[order] for v in (block, row, nth, known))
        start = _starts(h)
        size = np.diff(np.append(start, len(h)))
        shared = (np.minimum.reduceat(block, start) != np.maximum.reduceat(block, start)) | np.logical_or.reduceat(known, start)
        burning = np.repeat(size > hot, size)
        wanted = np.flatnonzero(np.repeat(shared, size) & (~known | burning))
        for g in _by_group(block[wanted]):
            at = wanted[g]
            name, d, t = asked[block[at[0]]]
            told = at[known[at]]
            at = at[~known[at]]
            number = np.where(burning[at], -1 - nth[at], nth[at]).astype(np.int32)
            docs_in, own = np.unique(row[at], return_inverse=True)
            yield _block_row(name, _blob(hot=h[told] << np.uint64(24) | np.uint64(here), d=d[docs_in], t=t[docs_in], row=_narrow(own), number=number))

    return run


def by_partition(parts: int, hot: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``answer`` for each of several partitions' rows, sorted by partition."""
    one = answer(parts, hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(s, e - s) for b in batches for s, e in _edges(b.column(0).to_numpy()))
        for _, same in itertools.groupby(pieces, lambda b: b.column(0)[0].as_py()):
            yield from one(same)

    return run


def _edges(key: np.ndarray) -> Iterator[tuple[int, int]]:
    start = _starts(key)
    return zip(start.tolist(), np.append(start[1:], len(key)).tolist(), strict=True)


def settle() -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each document with shared anchors, from rows of whole blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["block"], 64):
            edges = np.append(group_starts(table, ["block"]), table.num_rows)
            data = table.column("blob").to_pylist()
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                found = [_unblob(x) for x in data[s:e]]
                burning = np.concatenate([x["hot"] for x in found if "hot" in x] or [np.empty(0, np.uint64)])
                numbers, rows, d, t, n = [], [], [], [], 0
                for x in found:
                    if "hot" in x:
                        number = x["number"]
                    else:
                        nth = x["nth"].astype(np.int32)
                        number = np.where(np.isin(x["code"], burning)[x["group"]], -1 - nth, nth)
                    numbers.append(number)
                    rows.append(x["row"].astype(np.int64) + n)
                    d.append(x["d"])
                    t.append(x["t"])
                    n += len(x["d"])
                d, t = np.concatenate(d), np.concatenate(t)
                # one document came from several partitions
                order = np.lexsort((t, d))
                new = np.concatenate(([True], (d[order][1:] != d[order][:-1]) | (t[order][1:] != t[order][:-1])))[:n]
                first = np.empty(n, np.int64)
                first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
                yield from _numbers(d, t, first[np.concatenate(rows)], np.concatenate(numbers))

    return run


def _block_row(block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["block", "blob"])


def _numbers(d: np.ndarray, t: np.ndarray, row: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
    groups = list(_by_group(row))
    for s in range(0, len(groups), 8192):
        part = groups[s : s + 8192]
        at = np.array([row[g[0]] for g in part], np.int64)
        yield _doc_rows(d[at], t[at], [number[g].astype("<i4").tobytes() for g in part])


# -- 2: contexts of shared anchors --------------------------------------------


def contexts(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of_block(d: np.ndarray, t: np.ndarray, docs: list[bytes], numbers: list) -> Iterator[tuple[int, bytes]]:
        rows, bases, keys, lows, highs, cells = [], [], [], [], [], []
        for i, (text, lists) in enumerate(zip(docs, numbers, strict=True)):
            told = np.unique(np.frombuffer(b"".join(lists), "<i4"))
            raw = np.frombuffer(text, np.uint8)
            pos, h = anchors(raw)
            hot = -1 - told[told < 0]
            calm = np.setdiff1d(told[told >= 0], hot)
            padded = np.concatenate((np.zeros(BEFORE, np.uint8), raw, np.zeros(WIDTH, np.uint8)))
            view = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)
            base = pos[calm] - BEFORE
            key = h[calm]
            low = np.maximum(-base, 0)
            high = np.minimum(len(raw) - base, WIDTH)
            if len(hot):  # single strings, dealt by what they hold
                s = np.unique(pos[hot][:, None] + np.arange(-BEFORE, 1))
                s = s[(s >= 0) & (s + LENGTH <= len(raw))]
                own = _hash_rows(np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[s])
                base, key = np.concatenate((base, s)), np.concatenate((key, own))
                low, high = np.concatenate((low, np.full_like(s, ALONE))), np.concatenate((high, np.full_like(s, LENGTH)))
            cell = view[base + BEFORE].copy()
            if len(hot):
                cell[len(calm) :, LENGTH:] = 0
            rows.append(np.full(len(base), i))
            bases.append(base)
            keys.append(key)
            lows.append(low)
            highs.append(high)
            cells.append(cell)
        row, base, key, low, high, cell = (np.concatenate(v) for v in (rows, bases, keys, lows, highs, cells))
        del rows, bases, keys, lows, highs, cells
        if not len(row):
            return
        uid = _distinct(cell, low, high)
        least = np.full(uid.max() + 1, NO_ID)
        np.minimum.at(least, uid, d[row])
        later = d[row] > least[uid]
        if later.any():
            first = np.where(low == ALONE, 0, low)
            yield int(key[0] % np.uint64(parts)), _blob(**_covers(d, t, row[later], (base + first)[later], (base + high)[later]))
        # one for each context and document; those under the block's least id need an answer
        mine = np.flatnonzero(~later)
        part = (key[mine] >> np.uint64(40)) % np.uint64(parts)
        for g in _by_group(part):
            at = mine[g]
            docs_in, own = np.unique(row[at], return_inverse=True)
            yield int(part[g[0]]), _blob(bytes=cell[at], low=low[at].astype(np.uint8), high=high[at].astype(np.uint8), base=base[at].astype(np.int32), d=d[docs_in], t=t[docs_in], row=_narrow(own))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _row_batches((r for d, t, docs, n in _blocks(batches) for r in of_block(d, t, docs, n)), "q")

    return run


def _hash_rows(cell: np.ndarray) -> np.ndarray:
    h = np.zeros(len(cell), np.uint64)
    wide = np.zeros((len(cell), -(-cell.shape[1] // 8) * 8), np.uint8)
    wide[:, : cell.shape[1]] = cell
    for w in wide.view(np.uint64).T:
        h = (h ^ w) * _POW[0]
        h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _distinct(cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal rows only; a few thousand rows at a time are copied."""
    parts = [slice(s, s + (1 << 14)) for s in range(0, len(cell), 1 << 14)]
    h = np.concatenate([_hash_rows(cell[p]) for p in parts] or [np.empty(0, np.uint64)])
    h ^= (low.astype(np.uint64) << np.uint64(8) | high.astype(np.uint64)) * _MIX
    _, first, uid = np.unique(h, return_index=True, return_inverse=True)
    rep = first[uid]
    other = [(cell[p] != cell[rep[p]]).any(1) for p in parts]
    odd = np.flatnonzero((low != low[rep]) | (high != high[rep]) | np.concatenate(other or [np.empty(0, bool)]))
    uid[odd] = len(first) + np.arange(len(odd))
    return uid


def _covers(d: np.ndarray, t: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Intervals of at least LENGTH bytes, those of a document joined where they meet."""
    ok = end - start >= LENGTH
    row, start, end = row[ok], start[ok], end[ok]
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if len(row):
        wide = row.astype(np.int64) << 32
        reach = np.maximum.accumulate(wide + end)
        new = np.concatenate(([True], (wide + start)[1:] > reach[:-1]))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(row)) - 1
        row, start, end = row[at], start[at], reach[last] - wide[at]
    docs_in, own = np.unique(row, return_inverse=True)
    return {"d": d[docs_in], "t": t[docs_in], "row": _narrow(own), "start": start.astype(np.int32), "end": end.astype(np.int32)}


def _cover_rows(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    pairs = np.stack((x["start"], x["end"]), 1).astype("<i4")
    row = x["row"].astype(np.int64)
    groups = list(_by_group(row))
    for s in range(0, len(groups), 8192):
        part = groups[s : s + 8192]
        at = np.array([row[g[0]] for g in part], np.int64)
        yield _doc_rows(x["d"][at], x["t"][at], [pairs[g].tobytes() for g in part])


# -- 3: suffix arrays ---------------------------------------------------------


def suffix_order(cell: np.ndarray) -> np.ndarray:
    """Suffixes of the rows of ``cell``, sorted by their first LENGTH bytes.

    A suffix is ``row * (WIDTH + 1) + start``; all starts below STARTS are there, and the
    few more that the induction needs.  A row ends with zeros.
    """
    m, width = len(cell), cell.shape[1]
    wide = width + 1
    text = np.zeros((m, wide + LENGTH + 7), np.uint8)
    text[:, :width] = cell
    stride = text.shape[1]
    # smaller than the successor, or equal up to one that is
    small = np.ones((m, wide), bool)
    for j in range(width - 1, -1, -1):
        a, b = text[:, j], text[:, j + 1]
        small[:, j] = (a < b) | ((a == b) & small[:, j + 1])
    # starts up to the first directly sorted one behind the last string
    stop = STARTS + np.argmax(small[:, STARTS:], axis=1)
    active = np.arange(wide)[None, :] <= stop[:, None]
    direct_row, direct_at = np.nonzero(small & active)
    flat = text.reshape(-1)
    words = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,))
    where = direct_row * stride + direct_at
    order = _sort_direct(words, where)
    direct = (direct_row * wide + direct_at)[order]
    letter = text[:, :wide].reshape(-1)
    induced = (~small & active).reshape(-1)
    first = np.searchsorted(letter[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        bucket = [wave]
        while len(wave):
            before = wave[wave % wide > 0] - 1
            wave = before[induced[before] & (letter[before] == c)]
            bucket.append(wave)
        bucket.append(direct[first[c] : first[c + 1]])
        full = np.concatenate(bucket)
        waiting[c] = []
        if not len(full):
            continue
        out.append(full)
        before = full[full % wide > 0] - 1
        before = before[induced[before] & (letter[before] > c)]
        by = letter[before]
        g = np.argsort(by, kind="stable")
        cuts = _starts(by[g])
        for part in np.split(before[g], cuts[1:]):
            if len(part):
                waiting[int(letter[part[0]])].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _sort_direct(words: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Order of places by LENGTH bytes, word after word; only ties go on."""
    first = words[where].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    key = first[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(order)]
    for at in (*range(8, LENGTH - 8, 8), LENGTH - 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        group = np.cumsum(new)[idx]
        w = words[where[order[idx]] + at].astype(np.uint64)
        g = np.lexsort((w, group))
        order[idx] = order[idx][g]
        w, group = w[g], group[g]
        new[idx] |= np.concatenate(([True], (w[1:] != w[:-1]) | (group[1:] != group[:-1])))
    return order


def least_documents(cell: np.ndarray, low: np.ndarray, high: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each row and start, the smallest ``d`` of rows that hold the same LENGTH bytes; NO_ID where no string starts."""
    m, wide = len(cell), cell.shape[1] + 1
    order = suffix_order(cell)
    row, at = order // wide, order % wide
    ok = (at >= low[row]) & (at + LENGTH <= high[row]) & (at < STARTS)
    row, at = row[ok], at[ok]
    out = np.full((m, STARTS), NO_ID)
    if not len(row):
        return out
    flat = np.zeros((m, cell.shape[1] + 8), np.uint8)
    flat[:, : cell.shape[1]] = cell
    place = row * flat.shape[1] + at
    words = np.ndarray((flat.size - 7,), "<u8", flat.reshape(-1), strides=(1,))
    # adjacent common prefix of LENGTH bytes or more
    same = np.ones(len(row) - 1, bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = words[place + k]
        same &= w[1:] == w[:-1]
    start = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.minimum.reduceat(d[row], start)
    out[row, at] = np.repeat(least, np.diff(np.append(start, len(row))))
    return out


def resolve(slice_rows: int = 40_000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[dict[str, np.ndarray]] = []
        rows = 0
        for b in batches:
            for raw in b.column(1).to_pylist():
                x = _unblob(raw)
                if "bytes" not in x:
                    yield from _cover_rows(x)
                    continue
                x["row"] = x["row"].astype(np.int64) + rows
                rows += len(x["d"])
                got.append(x)
        if not got:
            return
        low, high, base, row = (np.concatenate([x[k] for x in got]) for k in ("low", "high", "base", "row"))
        d, t, cell = (np.concatenate([x[k] for x in got]) for k in ("d", "t", "bytes"))
        del got
        alone = low == ALONE
        key = _gram_hashes(cell[:, BEFORE : BEFORE + GRAM])[:, 0]
        key[alone] = _hash_rows(cell[alone][:, :LENGTH])
        low = np.where(alone, 0, low)
        order = np.argsort(key, kind="stable")
        edges = np.append(_starts(key[order]), len(order))
        at = 0
        while at < len(order):
            to = int(edges[np.searchsorted(edges, min(at + slice_rows, len(order)))])
            part = order[at:to]
            at = to
            c, lo, hi, own = cell[part], low[part].astype(np.int64), high[part].astype(np.int64), d[row[part]]
            uid = _distinct(c, lo, hi)
            _, first, uid = np.unique(uid, return_index=True, return_inverse=True)
            least = np.full(len(first), NO_ID)
            np.minimum.at(least, uid, own)
            found = least_documents(c[first], lo[first], hi[first], least)
            i, j = np.nonzero(found[uid] < own[:, None])
            if len(i):
                start = base[part][i].astype(np.int64) + j
                yield from _cover_rows(_covers(d, t, row[part][i], start, start + LENGTH))

    return run


# -- 4: cutting ---------------------------------------------------------------


def _removed(n: int, covers: list[bytes]) -> np.ndarray:
    """Which of ``n`` bytes go."""
    step = np.zeros(n + 1, np.int32)
    pairs = np.frombuffer(b"".join(covers), "<i4").reshape(-1, 2)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1], -1)
    return np.cumsum(step)[:n] > 0


def dealt(df: DataFrame, number: str, parts: int) -> DataFrame:
    """``df`` in ``parts`` partitions, rows by their number from 0 to parts - 1, each in a partition of its own.

    Numbers themselves would be hashed, and several meet in one partition; each gets a
    stand-in that is hashed to its place.  There are as many stand-ins as partitions.
    """
    tried = df.sparkSession.range(16 * parts + 64).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p"))
    found = {r.p: r.id for r in tried.groupBy("p").agg(F.min("id").alias("id")).collect()}
    listed = F.split(F.lit(",".join(str(found.get(p, p)) for p in range(parts))), ",").cast("array<bigint>")
    return df.withColumn("at", F.get(listed, F.col(number).cast("int"))).repartition(parts, "at").drop("at")


def removals(docs: DataFrame, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """(text, rest, covers) for each row of ``docs``; rest is a struct of the other columns.

    covers lists blobs of (start, end) int pairs and is null where nothing goes.  Both
    joins read the same four columns, so that Spark shuffles the texts once; taking a
    field out of rest here would undo that.
    """
    spark = docs.sparkSession
    configure(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.hash("text").alias("t"), F.col("text"), F.struct(*[c for c, name in zip(columns(docs), docs.columns, strict=True) if name != "text"], F.lit(0).alias(fresh(docs, "_")[0])).alias("rest"))
    asked = rows.mapInArrow(tidy(ask(parts)), "p long, blob binary")
    answered = dealt(asked, "p", parts).sortWithinPartitions("p").mapInArrow(tidy(by_partition(parts, hot)), "block long, blob binary")
    shared = answered.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(settle()), "d long, t int, data binary")
    numbers = shared.groupBy("d", "t").agg(F.collect_list("data").alias("numbers"))
    around = rows.join(numbers, ["d", "t"]).select("d", "t", "text", "numbers", "rest").mapInArrow(tidy(contexts(parts)), "q long, blob binary")
    found = dealt(around, "q", parts).mapInArrow(tidy(resolve()), "d long, t int, data binary")
    covers = found.groupBy("d", "t").agg(F.collect_list("data").alias("covers"))
    joined = rows.join(covers, ["d", "t"], "left")
    return joined.select("text", "rest", "covers")


def deduplicate(docs: DataFrame, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs`` (doc_id, text, ...); kept as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, covers in zip(texts(b.column(0)), b.column(2).to_pylist(), strict=True):
                if not covers:
                    out.append((len(text), 0, 0, text))
                    continue
                gone = _removed(len(text), covers)
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            numbers = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(1).field("doc_id"), *numbers, pa.array([o[3] for o in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = removals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts, hot)
    return found.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def keep_first(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``docs`` with all their columns, their texts without the bytes that go.

    A character that loses a byte goes as a whole; a column n_chars follows the text.
    """
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, was = texts(b.column(0)), b.column(0).is_valid().to_pylist()
            out = []
            for text, ok, covers in zip(raw, was, b.column(2).to_pylist(), strict=True):
                kept = np.frombuffer(text, np.uint8)[~_removed(len(text), covers)].tobytes() if covers else text
                out.append(kept.decode(errors="ignore") if ok else None)
            columns = [pa.array(out, pa.string()) if c == "text" else b.column(1).field(c) for c in names]
            if "n_chars" in names:
                k = names.index("n_chars")
                n = pa.array([None if x is None else len(x) for x in out], pa.int64())
                columns[k] = n.cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return removals(docs, parts).mapInArrow(tidy(run), docs.schema)
