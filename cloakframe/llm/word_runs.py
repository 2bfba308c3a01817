"""Periodic runs of words, and texts with what repeats taken out.

A run is a stretch of consecutive words with smallest period q and ``least`` words and
``exponent`` periods or more, that no neighbouring word extends.  For each stretch of words
a suffix automaton is built.  Its states are taken from the longest to the shortest; each
state's set of end positions, kept in order, goes into that of its suffix link, the smaller
set into the larger.  Two ends that become neighbours in the set of a state end two
occurrences of that state's longest string, and this string is all that the words before
both ends have in common.  If their distance d is not above the state's length, they seed a
square of period d; the stretch of length + d words cannot grow to the left, and where the
words behind both ends differ, it cannot grow to the right and is a run.  Of seeds with the
same stretch the smallest period is that of the run.

Before that, words that cannot lie in any run are left out, by counts over whole Arrow
batches: within a run each three words in turn are met at least min(exponent - 1, least - 2)
times.  Stretches end where a triple is met less often; the counts are made anew within
the stretches that remain, until none is cut.  A run lies in one stretch as a whole, so that
this loses none.

Defined cases: a null text counts as empty, has no runs and an empty collapsed text; a text
without words collapses to an empty one; rows are independent, so that repeated rows and ids,
nulls elsewhere and empty tables need nothing.  Words are compared as bytes.  A text's words
are in memory at once, and for the longest stretch of one text that still repeats there are
two automaton states a word, some 600 bytes a word.  Columns beside ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.scratch import configure
from cloakframe.llm.streams import texts, tidy

#: Periods and words that a run has at least.
EXPONENT, LEAST = 4, 6
#: Positions in a block of an ordered set before it is halved.
BLOCK = 2048
#: White space that parts words.
WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])
SPAN = "start long, length long, period long"


class Ends:
    """An ordered set of numbers, in blocks so that adding costs little whatever its size."""

    def __init__(self, x: int) -> None:
        self.blocks, self.tops, self.size = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Add a number that is not there yet; its neighbours below and above."""
        blocks, tops = self.blocks, self.tops
        k = bisect_left(tops, x)
        self.size += 1
        if k == len(tops):
            block = blocks[-1]
            below = block[-1]
            block.append(x)
            tops[-1] = x
            found: tuple[int | None, int | None] = (below, None)
            k -= 1
        else:
            block = blocks[k]
            i = bisect_left(block, x)
            found = (block[i - 1] if i else blocks[k - 1][-1] if k else None, block[i])
            block.insert(i, x)
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks[k : k + 1] = [block[:half], block[half:]]
            insort(tops, block[half - 1])
        return found


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(links, lengths, states): suffix links and lengths of the states, state 0 being the root, and the state of each prefix."""
    steps: list[dict[int, int]] = [{}]
    links, lengths, states, last = [-1], [0], [], 0
    for c in words:
        new = len(lengths)
        lengths.append(lengths[last] + 1)
        links.append(0)
        steps.append({})
        at = last
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = links[at]
        if at >= 0:
            to = steps[at][c]
            if lengths[to] == lengths[at] + 1:
                links[new] = to
            else:
                split = len(lengths)
                lengths.append(lengths[at] + 1)
                links.append(links[to])
                steps.append(dict(steps[to]))
                links[to] = links[new] = split
                while at >= 0 and steps[at].get(c) == to:
                    steps[at][c] = split
                    at = links[at]
        states.append(new)
        last = new
    return links, lengths, states


def runs(words: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, in this order."""
    n = len(words)
    if n < max(least, exponent):
        return []
    links, lengths, states = automaton(words)
    # shorter common strings cannot make a run of any period
    enough = min(max((exponent - 1) * d, least - d) for d in range(1, least + 1))
    ends: list[Ends | None] = [None] * len(lengths)
    for i, state in enumerate(states):
        ends[state] = Ends(i)
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(lengths)), key=lengths.__getitem__, reverse=True):
        to, small = links[state], ends[state]
        ends[state] = None
        common = lengths[to]
        if small is None or common < enough:
            continue
        large = ends[to]
        if large is None:
            ends[to] = small
            continue
        if large.size < small.size:
            large, small = small, large
        ends[to] = large
        before = None
        for x in small:
            below, above = large.add(x)
            if below == before:  # both are from the smaller set, and have more in common
                below = None
            before = x
            for a, b in ((below, x), (x, above)):
                if a is None or b is None or b - a > common:
                    continue
                d = b - a
                if common + d < max(least, exponent * d) or (b + 1 < n and words[a + 1] == words[b + 1]):
                    continue
                at = (a - common + 1, common + d)
                if d < found.get(at, n):
                    found[at] = d
    return sorted((start, length, d) for (start, length), d in found.items())


def stretches(words: np.ndarray, owner: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, lengths) of stretches of words outside which no run lies; ``owner`` tells the texts apart.

    Counts are kept by a hash; words that share a place by chance only stay in.
    """
    n, need = len(words), min(exponent - 1, least - 2)
    firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(firsts, n))
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    while True:
        whole = sizes >= least
        firsts, sizes = firsts[whole], sizes[whole]
        if not len(firsts) or need < 2:
            return firsts, sizes
        # a number for each triple within a stretch
        count = sizes - 2
        stretch = np.repeat(np.arange(len(firsts)), count)
        at = np.repeat(firsts - (np.cumsum(count) - count), count) + np.arange(count.sum())
        key = ((mixed[at] * np.uint64(3) + mixed[at + 1]) * np.uint64(5) + mixed[at + 2] + stretch.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        bits = max(10, int(len(at)).bit_length() + 2)
        place = (key >> np.uint64(64 - bits)).astype(np.int64)
        often = np.bincount(place, minlength=1 << bits)[place] >= need
        if often.all():
            return firsts, sizes
        # frequent triples in turn make a stretch; two stretches may share a word or two, but no run
        at, stretch = at[often], stretch[often]
        begins = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (stretch[1:] != stretch[:-1]))) if len(at) else np.zeros(0, bool)
        firsts = at[begins]
        sizes = np.diff(np.append(np.flatnonzero(begins), len(at))) + 2


def _words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, ends, words, owners): all texts behind one another, where words begin and end, a number for each distinct word, and whose it is."""
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    inside = np.concatenate(([False], ~WHITE[data]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    tight = data[inside[1:]]
    offsets = np.concatenate(([0], np.cumsum(ends - begins)))
    found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(tight)]).dictionary_encode()
    behind = np.cumsum([len(x) + 1 for x in raw])
    return data, begins, ends, found.indices.to_numpy().astype(np.int64), np.searchsorted(behind, begins, "right")


def _collapse(raw: list[bytes], exponent: int, least: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs and collapsed text of each of ``raw``."""
    data, begins, ends, words, owner = _words(raw)
    out: list[list[tuple[int, int, int]]] = [[] for _ in raw]
    kept = np.ones(len(words), bool)
    first = np.searchsorted(owner, np.arange(len(raw) + 1))
    for a, size in zip(*(x.tolist() for x in stretches(words, owner, exponent, least)), strict=True):
        k = int(owner[a])
        for start, length, period in runs(words[a : a + size].tolist(), exponent, least):
            kept[a + start + period : a + start + length] = False
            out[k].append((a + start - int(first[k]), length, period))
    for found in out:
        found.sort(key=lambda x: (x[0], x[2]))
    # the bytes of kept words and one space behind each
    step = np.zeros(len(data) + 1, np.int8)
    step[begins[kept]] += 1
    step[ends[kept] + 1] -= 1
    mine = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    spaced = np.where(WHITE[data], np.uint8(0x20), data)[mine].tobytes()
    sizes = np.bincount(owner[kept], weights=(ends - begins + 1)[kept], minlength=len(raw)).astype(np.int64)
    to = np.cumsum(sizes)
    return out, [spaced[b - s : b - 1] if s else b"" for b, s in zip(to.tolist(), sizes.tolist(), strict=True)]


def find_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its runs by start and period, and its kept words joined by one space.

    A word is dropped if a run contains it behind the run's first period.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    configure(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, collapsed = _collapse(texts(b.column(1)), exponent, least)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id long, runs array<struct<{SPAN.replace(' long', ':bigint')}>>, collapsed string")


def greatest(found: Column) -> Column:
    """Of an array of runs the one with the greatest exact length / period; ties go to the smallest start, then period; null if there is none."""

    def order(a: Column, b: Column) -> Column:
        here, there = a["length"] * b["period"], b["length"] * a["period"]
        less = (here > there) | ((here == there) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
        return F.when(less, -1).when((here == there) & (a["start"] == b["start"]) & (a["period"] == b["period"]), 0).otherwise(1)

    return F.try_element_at(F.array_sort(found, order), F.lit(1))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose id has a CRC-32 divisible by ten repeat from some word on, others stay as they are.

    With g the tenth part of the CRC-32 of the decimal id and n words, from word a = g % n on the
    words a, ..., a + p - 1 follow one another again and again, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    w = w.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")))
    w = w.withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    w = w.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    edited = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return w.select("doc_id", F.when(F.col("n") > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))
