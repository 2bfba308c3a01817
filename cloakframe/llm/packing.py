"""Packing token sequences by non-negative least squares over length combinations.

Documents are tokenized once and stored.  A document of ``WINDOW`` tokens or more first
fills whole windows; what remains is shorter than a window.  The histogram of these
lengths (at most ``WINDOW`` counts) goes to the driver, which enumerates the shallow
combinations that fill a window up to a gap of at most ``GAP`` tokens, equal pieces of up
to three lengths, and solves ``min ||A x - histogram||, x >= 0`` for their repeat counts
by coordinate descent until it settles.  Counts are rounded to what the histogram allows;
left-over pieces are packed greedily, longest first.

What then is left is laid end to end and cut: first into the gaps, then into windows.  If
that is less than the gaps, windows of the greedy part, and then of the plan, are given up
for it.  The last open window is divided into powers of two, which need no padding.

The plan is a list of rank intervals for each length and of gaps of one size, bounded by
the number of combinations, whatever the input.  A document finds its place from its rank
among those of its length; ranks come from windows over length and salt and from sums
over salts.  A length has one salt for ``CELL`` documents, so one that a third of all
documents share is spread over many tasks.

Null and empty texts hold the end id alone.  Repeated rows are packed as often as they
come, a null doc_id is kept, ties are settled by the ids' hash, a very long text is
tokenized as a whole, further columns are left out whatever their names, an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.scratch import configure, materialize
from cloakframe.llm.streams import texts, tidy

WINDOW = 4096
END_ID = 2
#: Words whose ids a worker keeps.
CACHE = 300_000
#: Signs that may follow a word of letters and then are a piece of their own.
_TAIL = '.,!?;:#$%&*|"()-'
#: Each line as letters and such signs, or as nothing if it is not of that form.
_PARTS = re.compile(rf"^(?:([^\W\d_]+)([{re.escape(_TAIL)}]*)|.*)$", re.MULTILINE)
#: Documents of one length and salt.
CELL = 50_000
#: Tokens that a combination may leave open in a window of 4096, and as a share of others.
GAP = 64
#: Partners that are tried for pieces of one length: so many second lengths.
PARTNERS = 6
#: Sweeps of coordinate descent, at most, and the change of a count below which it has settled.
SWEEPS, SETTLED = 200, 0.01


class Cache:
    """Values by key in two generations; when the young one is full the old one goes, so what is in use stays."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size // 2, {}, {}

    def found(self, keys: Iterable) -> tuple[dict, list]:
        """The values that are there, and the keys that are not."""
        young, old, out, missing = self.young, self.old, {}, []
        for k in keys:
            v = young.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                    continue
                young[k] = v
            out[k] = v
        return out, missing

    def add(self, values: dict) -> None:
        self.young.update(values)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class WordTokenizer:
    """Ids of texts, with those of words kept, for tokenizers that never join across white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.piece = self.inner.model.tokenize
        self.dtype = np.dtype("<u2") if self.inner.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words, self.letters = Cache(CACHE // 2), Cache(CACHE)
        self.tails: dict[str, bytes] = {"": b""}
        # tokens that end a piece
        self.last = np.zeros(self.inner.get_vocab_size(), bool)
        for token, number in self.inner.get_vocab().items():
            self.last[number] = token.endswith("</w>")
        # strings of added tokens may hold or touch anything: such texts are tokenized as a whole
        self.added = [t.content.encode() for t in self.inner.get_added_tokens_decoder().values()]

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not in the cache."""
        # a word of letters is one piece, whatever its case; what follows it is another
        lowered = b"\n".join(new).decode().replace("Σ", "σ").lower()  # as single letters; words hold no line feed
        whole, parts = [], {}
        for w, part in zip(new, _PARTS.findall(lowered), strict=True):
            if part[0] and (part[0].isascii() or part[0].isalpha()):
                parts[w] = part
            else:
                whole.append(w)
        known, letters = self.letters.found({c for c, _ in parts.values()})
        got, other = {}, []
        for c in letters:
            # a piece of plain letters goes to the model as it is
            if c.isascii():
                got[c] = self._pack([t.id for t in self.piece(c)])
            else:
                other.append(c)
        for at in range(0, len(other), 4000):
            part = other[at : at + 4000]
            ids = np.array(self.inner.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                raw, size = ids.tobytes(), self.dtype.itemsize
                cuts = [0, *(ends * size).tolist()]
                got.update((w, raw[s:e]) for w, s, e in zip(part, cuts, cuts[1:], strict=False))
            else:
                got.update((w, self._pack(self.inner.encode(w, add_special_tokens=False).ids)) for w in part)
        known.update(got)
        self.letters.add(got)
        for t in {t for _, t in parts.values()} - self.tails.keys():
            self.tails[t] = self._pack(self.inner.encode(t, add_special_tokens=False).ids)
        out = {w: known[c] + self.tails[t] for w, (c, t) in parts.items()}
        out.update((w, self._pack(self.inner.encode(w.decode(), add_special_tokens=False).ids)) for w in whole)
        return out

    def _pieces(self, words: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(ids of pieces, first and second piece of each distinct word).

        A word of plain letters with or without signs behind it is its letters in lower case
        and the signs, found by Arrow; other words are one piece here.
        """
        low = pc.ascii_lower(words)
        core = pc.ascii_rtrim(low, characters=_TAIL)
        plain = pc.and_(pc.string_is_ascii(words), pc.ascii_is_alpha(core))
        is_plain = plain.to_numpy(zero_copy_only=False)
        letters = core.filter(plain).dictionary_encode()
        asked = letters.dictionary.to_pylist()
        known, missing = self.letters.found(asked)
        if missing:
            got = {c: self._pack([t.id for t in self.piece(c)]) for c in missing}
            self.letters.add(got)
            known.update(got)
        other = words.filter(pc.invert(plain)).cast(pa.binary()).to_pylist()
        ids, missing = self.words.found(other)
        if missing:
            new = self._learn(missing)
            self.words.add(new)
            ids.update(new)
        values = [known[c] for c in asked] + [ids[w] for w in other]
        first = np.empty(len(words), np.int64)
        first[is_plain] = letters.indices.to_numpy(zero_copy_only=False)
        first[~is_plain] = len(asked) + np.arange(len(other))
        # signs by their bytes
        signs = (np.asarray(pc.binary_length(low)) - np.asarray(pc.binary_length(core))) * is_plain
        second, numbers = np.full(len(words), -1, np.int64), {}
        rows = np.flatnonzero(signs)
        for k, tail in zip(rows.tolist(), self._tails_of(low, rows, signs[rows]), strict=True):
            second[k] = numbers.setdefault(tail, len(values) + len(numbers))
        for tail in numbers:
            if tail not in self.tails:
                self.tails[tail] = self._pack(self.inner.encode(tail, add_special_tokens=False).ids)
            values.append(self.tails[tail])
        values.append(b"")
        second[second < 0] = len(values) - 1
        return values, first, second

    @staticmethod
    def _tails_of(low: pa.StringArray, rows: np.ndarray, size: np.ndarray) -> list[str]:
        """The last letters of some rows."""
        out = [""] * len(rows)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            for k, tail in zip(at.tolist(), pc.utf8_slice_codeunits(low.take(pa.array(rows[at])), -n).to_pylist(), strict=True):
                out[k] = tail
        return out

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Packed ids of each text.

        Distinct words and their parts are found by Arrow; only what the caches do not
        hold goes to the tokenizer.
        """
        odd = [k for k, t in enumerate(batch) if any(a in t for a in self.added)]
        plain = list(batch)
        for k in odd:
            plain[k] = b""
        split = pc.ascii_split_whitespace(pa.array(plain, pa.binary()).cast(pa.string()))
        words = split.flatten().dictionary_encode()
        values, first, second = self._pieces(words.dictionary)
        at = words.indices.to_numpy(zero_copy_only=False)
        piece = np.empty(2 * len(at), np.int64)
        piece[0::2], piece[1::2] = first[at], second[at]
        length = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(values), self.dtype)
        n = length[piece]
        end = np.cumsum(n)
        out = flat[np.repeat(start[piece] - (end - n), n) + np.arange(int(n.sum()))]
        edges = np.concatenate(([0], end[1::2]))[np.asarray(split.offsets) - split.offsets[0].as_py()].tolist()
        packed = [out[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]
        for k in odd:
            packed[k] = self._pack(self.inner.encode(batch[k].decode(), add_special_tokens=False).ids)
        if len(self.tails) > CACHE:
            self.tails = {"": b""}
        return packed


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids) for each row: ids packed, ``end_id`` last, n their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        end = np.array([end_id], t.dtype).tobytes()
        for b in batches:
            whole = texts(b.column(1))
            for at in range(0, len(whole), 1024):
                ids = [x + end for x in t.encode(whole[at : at + 1024])]
                n = [len(x) // t.dtype.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1024), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n long, ids binary")


Combination = tuple[tuple[int, int], ...]


def combinations(histogram: dict[int, int], window: int = WINDOW, gap: int | None = None) -> list[Combination]:
    """((count, length), ...) of up to three lengths, longest first, that fill a window up to the gap, exact ones first."""
    gap = GAP * window // WINDOW if gap is None else gap
    lengths = sorted(histogram)
    out: dict[Combination, int] = {}

    def fits(rest: int, below: int) -> int:
        """The longest length up to ``rest`` and below another, or 0."""
        i = bisect_right(lengths, min(rest, below - 1))
        return lengths[i - 1] if i else 0

    for a in reversed(lengths):
        most = min(window // a, histogram[a])
        for m in sorted({*(1 << k for k in range(most.bit_length())), *range(1, min(most, 4) + 1), most}):
            rest = window - m * a
            if rest <= gap:
                out[((m, a),)] = rest
                continue
            # one further length, in up to three pieces
            for n in (1, 2, 3):
                b = fits(rest // n, a)
                if b and rest - n * b <= gap and histogram[b] >= n:
                    out[((m, a), (n, b))] = rest - n * b
            # two further lengths; the second from all over what is left
            top = bisect_right(lengths, min(rest, a - 1))
            for i in {top - 1 - k * top // PARTNERS for k in range(PARTNERS) if top}:
                b = lengths[i]
                c = fits(rest - b, b)
                if c and rest - b - c <= gap:
                    out[((m, a), (1, b), (1, c))] = rest - b - c
    return sorted(out, key=lambda k: (out[k], len(k), k))


def solve(columns: list[Combination], histogram: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative repeat counts that come close to the histogram."""
    r = defaultdict(float, histogram)
    x = [0.0] * len(columns)
    norms = [float(sum(m * m for m, _ in c)) for c in columns]
    live = range(len(columns))
    for sweep in range(sweeps):
        moved, kept = 0.0, []
        for k in live:
            step = 0.0
            for m, a in columns[k]:
                step += m * r[a]
            step /= norms[k]
            if step < -x[k]:
                step = -x[k]
            if step:
                x[k] += step
                for m, a in columns[k]:
                    r[a] -= m * step
                moved = max(moved, abs(step))
            if x[k]:
                kept.append(k)
        if moved < SETTLED:
            # settled among those in use; a last look at all of them, unless this was one
            if len(live) == len(columns):
                break
            live = range(len(columns))
        else:
            live = kept if sweep % 10 else range(len(columns))
    return x


class Plan:
    """Rank intervals of each length, gaps and windows for what is laid end to end."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW) -> None:
        self.window = window
        gap = GAP * window // WINDOW
        left = dict(histogram)
        columns = combinations(left, window)
        x = solve(columns, histogram)
        chosen: list[tuple[Combination, int]] = []

        def take(column: Combination, most: float) -> int:
            k = int(min(most, *(left[a] // m for m, a in column)))
            if k > 0:
                chosen.append((column, k))
                for m, a in column:
                    left[a] -= m * k
            return k

        for k in sorted(range(len(columns)), key=lambda k: -x[k]):
            if x[k] < 0.5:
                break
            take(columns[k], math.floor(x[k] + 0.5))
        self.solved = sum(k * m * a for c, k in chosen for m, a in c)
        # longest first; a length is used up, or no longer fits, with each round
        lengths = sorted(a for a, c in left.items() if c)
        while lengths:
            rest, column = window, []
            i = len(lengths)
            while i and rest > gap:
                i = min(i, bisect_right(lengths, rest))
                if not i:
                    break
                a = lengths[i - 1]
                n = min(rest // a, left[a])
                column.append((n, a))
                rest -= n * a
                i -= 1
            if rest > gap or not take(tuple(column), math.inf):
                lengths.pop()  # stays for what is laid end to end
            lengths = [a for a in lengths if left[a]]
        # gaps are filled with what is left, so there must be enough of it
        fill = lambda c: sum(m * a for m, a in c)
        gaps = sum(k * (window - fill(c)) for c, k in chosen)
        loose = sum(a * c for a, c in left.items())
        while loose < gaps:
            column, k = chosen.pop()
            give = min(k, -(-(gaps - loose) // window))
            if k > give:
                chosen.append((column, k - give))
            for m, a in column:
                left[a] += m * give
            loose += give * fill(column)
            gaps -= give * (window - fill(column))
        used = dict.fromkeys(left, 0)
        spans: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        #: Where what is laid end to end goes: (first place, size, first sequence, offset).
        runs: list[tuple[int, int, int, int]] = []
        self.sequences = place = 0
        for column, k in chosen:
            offset = 0
            for m, a in column:
                spans[a].append((used[a], k * m, self.sequences, m, offset))
                used[a] += k * m
                offset += m * a
            if offset < window:
                runs.append((place, window - offset, self.sequences, offset))
                place += k * (window - offset)
            self.sequences += k
        self.spans = {a: np.array(v, np.int64) for a, v in spans.items()}
        runs.append((place, window, self.sequences, 0))
        whole, rest = divmod(loose - place, window)
        place += whole * window
        self.after = self.sequences + whole
        for p in range(window.bit_length() - 1, -1, -1):
            if rest >> p & 1:
                runs.append((place, 1 << p, self.after, 0))
                self.after += 1
                place += 1 << p
        self.runs = np.array([r for i, r in enumerate(runs) if i + 1 == len(runs) or runs[i + 1][0] > r[0]], np.int64)
        # (first rank, first place) of each length among what is laid end to end
        self.rest: dict[int, tuple[int, int]] = {}
        place = 0
        for a in sorted(left, reverse=True):
            self.rest[a] = (used[a], place)
            place += left[a] * a
        self.loose = loose

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start, length, sequence, offset) of the item with this rank."""
        first, base = self.rest[length]
        if rank < first:
            s = self.spans[length]
            start, _, seq, count, offset = s[int(np.searchsorted(s[:, 0], rank, "right")) - 1].tolist()
            k = rank - start
            return [(0, length, seq + k // count, offset + k % count * length)]
        begin = at = base + (rank - first) * length
        end, out = at + length, []
        i = int(np.searchsorted(self.runs[:, 0], at, "right")) - 1
        while at < end:
            while i + 1 < len(self.runs) and self.runs[i + 1, 0] <= at:
                i += 1
            start, size, seq, offset = self.runs[i].tolist()
            k, inside = divmod(at - start, size)
            to = min(end, at + size - inside)
            out.append((at - begin, to - at, seq + k, offset + inside))
            at = to
        return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of ``docs`` (doc_id, text, ...)."""
    configure(docs.sparkSession)
    tokens = materialize(tokenize(docs, path, end_id), "tokens")
    numbers = tokens.select("doc_id", "n", "ids", (F.col("n") % window).alias("rem"), F.floor(F.col("n") / window).alias("full"))
    found = numbers.groupBy("rem").agg(F.count("*").alias("c"), F.sum("full").alias("f")).collect()  # at most a row a length
    plan = Plan({r.rem: r.c for r in found if r.rem}, window)
    full_base, at = {}, plan.after
    for r in sorted(found, key=lambda r: r.rem):
        full_base[r.rem] = at
        at += r.f
    many = {r.rem: -(-r.c // CELL) for r in found if r.c > CELL}
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("rem")), F.lit(1)) if many else F.lit(1)
    keyed = numbers.withColumn("h", F.xxhash64("doc_id", "ids")).withColumn("salt", F.pmod("h", salts))
    # written, so that Spark knows its size when it picks the join: a row for each length and CELL documents
    cells = materialize(keyed.groupBy("rem", "salt").agg(F.count("*").alias("c"), F.sum("full").alias("f")), "cells")
    before = Window.partitionBy("rem").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(cells.select("rem", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0")), "starts")
    inside = Window.partitionBy("rem", "salt").orderBy("doc_id", "n", "h")
    ranked = keyed.withColumn("r", F.row_number().over(inside) - 1)
    ranked = ranked.withColumn("g", F.coalesce(F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(starts, ["rem", "salt"]).select("doc_id", "n", "ids", (F.col("c0") + F.col("r")).alias("rank"), (F.col("f0") + F.col("g")).alias("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            source = []
            cols = [b.column(k).to_pylist() for k in ("n", "ids", "rank", "nth")]
            for row, (n, ids, rank, nth) in enumerate(zip(*cols, strict=True)):
                wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                full, rem = divmod(n, window)
                pieces = [(k * window, window, full_base[rem] + nth + k, 0) for k in range(full)]
                if rem:
                    pieces += [(full * window + s, m, q, o) for s, m, q, o in plan.place(rem, rank)]
                for s, m, q, o in pieces:
                    source.append(row)
                    out.append((s, m, zlib.crc32(wide[4 * s : 4 * (s + m)]), n, q, o))
            if out:
                arrays = [b.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
