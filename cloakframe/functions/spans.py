"""Spans of text: matches with offsets, selection, segments and splicing.

Offsets count code points inside the engine; ``utf16_length`` gives the offsets in
UTF-16 units that are stored beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(_text(text), "UTF-16BE")) / 2).cast("int")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), lambda v: use(v))[0]


#: Items that a fold appends to one array; longer arrays are folded block by block.
BLOCK = 256


def _folded(items: Column, state: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The items that ``step`` (state, item) -> (state, array of items to add) gives from left to right.

    An array that grows by one is copied each time, so what a block adds is gathered by
    itself and blocks are put together at the end: time is linear in the items, but for
    one reference a block.  ``none``: an empty array of the result's type.
    """
    last = F.greatest(F.ceil(F.size(items) / BLOCK), F.lit(1)).cast("int") - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))

    def add(acc: Column, x: Column) -> Column:
        after, more = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(acc["state"].alias("state"), none.alias("out")), add)
        return _once(inner, lambda v: F.struct(v["state"].alias("state"), F.concat(acc["out"], F.array(v["out"])).alias("out")))

    at_once = F.aggregate(items, F.struct(state.alias("state"), none.alias("out")), add, lambda a: a["out"])
    by_block = F.aggregate(blocks, F.struct(state.alias("state"), F.slice(F.array(none), 1, 0).alias("out")), block, lambda a: F.flatten(a["out"]))
    return F.when(F.size(items) <= BLOCK, at_once).otherwise(by_block)


def matches(text: Column | str, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches of a pattern that never matches empty text."""
    t = _text(text)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return e, F.array(F.struct(s.alias("start"), e.alias("end"), x["hit"].alias("value")))

    def walk(v: Column) -> Column:
        # the gap behind the last match has no partner
        pairs = F.filter(F.arrays_zip(v["gap"], v["hit"]), lambda x: x["hit"].isNotNull())
        return _once(pairs, lambda p: _folded(p, F.lit(0), none, step))

    return _once(F.struct(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit")), walk)


def select_greedy(spans: Column) -> Column:
    """Spans without overlaps: by start, longest first, then rule; each that starts behind the last accepted end.

    ``spans``: array of structs with start, end, rule and any further fields.
    """

    def pick(v: Column) -> Column:
        ordered = F.array_sort(
            v,
            lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["rule"] - b["rule"]).cast("int"),
        )
        none = F.slice(v, 1, 0)

        def step(reach: Column, x: Column) -> tuple[Column, Column]:
            free = x["start"] >= reach
            return F.when(free, x["end"]).otherwise(reach), F.when(free, F.array(x)).otherwise(none)

        return _once(ordered, lambda o: _folded(o, F.lit(0), none, step))

    return _once(spans, pick)


def wide_places(text: Column | str) -> Column:
    """Places of the characters beyond the basic plane, which UTF-16 writes as two units; none in most texts."""
    t = _text(text)
    found = F.transform(matches(t, "[\\x{10000}-\\x{10FFFF}]"), lambda m: m["start"])
    none = F.array().cast("array<int>")
    return F.when(F.octet_length(t) == F.length(t), none).when(utf16_length(t) == F.length(t), none).otherwise(found)


def to_units(places: Column | str, at: Column | str) -> Column:
    """Offset in UTF-16 units of an offset in code points; ``places``: ``wide_places`` of the text, computed once for all its offsets."""
    p, k = _text(places), _text(at)
    return (k + F.size(F.filter(p, lambda x: x < k))).cast("int")


def from_units(places: Column | str, units: Column | str) -> Column:
    """Offset in code points of an offset in UTF-16 units."""
    p, u = _text(places), _text(units)
    return (u - F.size(F.filter(F.transform(p, lambda x, i: x + i), lambda x: x < u))).cast("int")


def span_text(text: Column | str, start: Column, end: Column) -> Column:
    """Code points from start up to end."""
    return F.substring(_text(text), start + 1, end - start)


def splice(text: Column | str, replacements: Column) -> Column:
    """Text with each (start, end, value) replaced, from the right to the left."""
    t = _text(text)
    from_right = F.array_sort(replacements, lambda a, b: (b["start"] - a["start"]).cast("int"))
    return F.aggregate(from_right, t, lambda acc, r: F.concat(F.substring(acc, F.lit(1), r["start"]), r["value"], F.substring(acc, r["end"] + 1, F.length(acc))))


def replacement_errors(text: Column | str, replacements: Column) -> Column:
    """Whether a range is empty, out of the text, or overlaps another one."""
    n = F.length(_text(text))
    bad = F.exists(replacements, lambda r: r["start"].isNull() | r["end"].isNull() | (r["start"] < 0) | (r["end"] > n) | (r["start"] >= r["end"]))
    by_start = F.array_sort(replacements, lambda a, b: (a["start"] - b["start"]).cast("int"))
    walk = F.aggregate(by_start, F.struct(F.lit(0).alias("end"), F.lit(False).alias("bad")), lambda a, r: F.struct(r["end"].cast("int").alias("end"), (a["bad"] | (r["start"] < a["end"])).alias("bad")))
    return bad | walk["bad"]


def segments(text: Column | str, spans: Column) -> Column:
    """array<struct<text, mention_id>>: plain text and mentions from left to right; overlapping mentions are left out."""
    t = _text(text)
    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]).cast("int"))
    kind = "array<struct<text:string,mention_id:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def plain(a: Column, to: Column) -> Column:
        piece = F.array(F.struct(F.substring(t, a["at"] + 1, to - a["at"]).alias("text"), F.lit(None).cast("string").alias("mention_id")))
        return F.when(to > a["at"], F.concat(a["out"], piece)).otherwise(a["out"])

    def step(a: Column, s: Column) -> Column:
        hit = F.array(F.struct(F.substring(t, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["id"].alias("mention_id")))
        fits = (s["start"] >= a["at"]) & (s["end"] > s["start"]) & (s["end"] <= F.length(t))
        return F.when(fits, F.struct(s["end"].cast("int").alias("at"), F.concat(plain(a, s["start"]), hit).alias("out"))).otherwise(a)

    return F.aggregate(by_start, start, step, lambda a: plain(a, F.length(t)))
