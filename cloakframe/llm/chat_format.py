"""Chat formatting by a finite-state machine over roles.

A template states declaratively how a conversation, and each role's turn, begins and
ends, which strings steer the format, and whose text bears loss.  Turns of a
conversation run in order through the machine, which emits text segments, each with a
loss flag, and notes whether the order of roles is allowed.  Inside texts the control
strings are escaped, so the output can be read back without loss.

The output is read back by a scanner that goes from mark to mark and takes it in pieces
cut anywhere, so conversations of any length stream through a task; a turn takes memory
in proportion to its text, a few bytes for each character.

A conversation's turns come sorted by turn, then role and text, which settles ties.  Null
turns come first, null roles are roles named by an empty string, null texts are empty;
rows with a null conv_id are one conversation; repeated rows are turns of their own;
unknown roles use the template's ``other``; further columns are left out whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.scratch import configure


@dataclass(frozen=True)
class Role:
    """What stands before and after a role's text, and whether the text bears loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    end: str = "</s>"
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>", "<</SYS>>"),
            "user": Role("[INST]", "[/INST]"),
            "assistant": Role("<ANS>", "</ANS>", True),
        }
    )
    #: Stands for the roles not listed; the role's name goes between the two parts of ``before``.
    other: Role = Role("<ROLE:|>", "</ROLE>")
    escape: str = "\\"
    #: Allowed moves of the machine.
    moves: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "start": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        o = self.other.before.split("|")
        marks = [self.begin, self.end, self.other.after, *o, *(m for r in self.roles.values() for m in (r.before, r.after))]
        return sorted({m for m in marks if m}, key=lambda m: (-len(m), m))


DEFAULT = Template()


class Machine:
    """Formats turns and reads the format back."""

    def __init__(self, template: Template = DEFAULT) -> None:
        t = self.template = template
        marks = t.controls()
        if any(t.escape in m for m in marks):
            raise ValueError("a control string holds the escape sign")
        firsts = "".join(sorted({m[0] for m in marks}))
        # each first letter of a control string is escaped where one stands, and the sign itself
        self._inside = re.compile("|".join([re.escape(t.escape), *(f"(?={re.escape(m)})" for m in marks)]))
        self._firsts = frozenset(firsts + t.escape)
        self._head, self._tail = t.other.before.split("|")
        # what a scanner stops at: an escaped sign, or a control string
        self._mark = re.compile("|".join([re.escape(t.escape) + ".", *map(re.escape, marks)]), re.DOTALL)
        self.longest = max(2, *map(len, marks))
        self.opening = {r.before: (name, r) for name, r in t.roles.items()}

    def escape(self, text: str) -> str:
        e = self.template.escape
        return self._inside.sub(lambda m: e + m.group(), text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) segments of a turn."""
        r = self.template.roles.get(role)
        if r is None:
            return [(self._head + self.escape(role) + self._tail, False), (self.escape(text), self.template.other.loss), (self.template.other.after, False)]
        return [(r.before, False), (self.escape(text), r.loss), (r.after, False)]

    def read(self, formatted: str) -> tuple[str, str, bool]:
        """(role, text, loss) of one formatted turn."""
        reader = Reader(self, begun=True)
        found = [*reader.feed(formatted), *reader.feed("", last=True)]
        if len(found) != 1 or reader.place != len(formatted):
            raise ValueError("this is not a formatted turn")
        return found[0][:3]

    def split(self, conversation: str) -> list[str]:
        """The formatted turns of a formatted conversation."""
        reader = Reader(self)
        ends = [len(self.template.begin), *(x[3] for x in [*reader.feed(conversation), *reader.close()])]
        return [conversation[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def allowed(self, state: str, role: str) -> bool:
        return role in self.template.moves.get(state, frozenset())


class Reader:
    """Finds the turns of one formatted conversation that comes in pieces, cut anywhere.

    Holds the text of the open turn and what may be the beginning of a mark.
    """

    def __init__(self, machine: Machine, begun: bool = False) -> None:
        self.machine = machine
        #: Letters read so far that belong to whole marks and turns.
        self.place = 0
        self._rest = ""
        self._state = "turn" if begun else "begin"
        self._role, self._rule = "", machine.template.other
        self._text: list[str] = []

    def feed(self, piece: str, last: bool = False) -> list[tuple[str, str, bool, int]]:
        """(role, text, loss, place of the end) of each turn that ends in this piece."""
        m, t, out = self.machine, self.machine.template, []
        held = self._rest + piece
        at, stop = 0, len(held) if last else len(held) - m.longest + 1
        while at < stop:
            inside = self._state in ("name", "text")
            found = (m._mark.search if inside else m._mark.match)(held, at)
            if found is None or found.start() >= stop:
                if not inside:
                    raise ValueError("this is not a formatted conversation")
                self._text.append(held[at:stop])
                at = stop
                break
            self._text.append(held[at : found.start()])
            at, mark = found.end(), found.group()
            if inside and mark[0] == t.escape:
                self._text.append(mark[1] if mark[1] in m._firsts else mark)
            elif self._state == "begin" and mark == t.begin:
                self._state = "turn"
            elif self._state == "turn" and mark in m.opening:
                self._role, self._rule = m.opening[mark]
                self._state = "text"
            elif self._state == "turn" and mark == m._head:
                self._rule, self._state = t.other, "name"
            elif self._state == "name" and mark == m._tail:
                self._role, self._state = "".join(self._text), "text"
                self._text = []
            elif self._state == "text" and mark == self._rule.after:
                out.append((self._role, "".join(self._text), self._rule.loss, self.place + at))
                self._text, self._state = [], "turn"
            elif self._state == "turn" and mark == t.end:
                self._state = "end"
            else:
                raise ValueError("this is not a formatted conversation")
        self.place += at
        self._rest = held[at:]
        return out

    def close(self) -> list[tuple[str, str, bool, int]]:
        """The turns that end in what is held back; the conversation's end must be the last."""
        out = self.feed("", last=True)
        if self._state != "end":
            raise ValueError("this is not a formatted conversation")
        return out


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns of each conversation together and in order."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, str, str]]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)


def format_turns(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, turn, position, segments, allowed) for each turn: segments are (text, loss) structs.

    The segments of a conversation, in order of position, are its formatted text; those
    of the whole conversation's begin and end belong to its first and last turn.
    """
    configure(conversations.sparkSession)
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(template)
        held: list[tuple] = []
        size = 0
        for c, turn, position, segments, ok in _formatted(_rows(batches), machine):
            held.append((c, turn, position, [{"text": s, "loss": on} for s, on in segments], ok))
            size += sum(len(s) for s, _ in segments)
            if size > 4 << 20 or len(held) >= 4096:
                yield _batch(held, kind)
                held, size = [], 0
        if held:
            yield _batch(held, kind)

    return _turns(conversations).mapInArrow(run, "conv_id long, turn long, position long, segments array<struct<text:string,loss:boolean>>, allowed boolean")


def _batch(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    c, turn, position, segments, ok = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(turn, pa.int64()), pa.array(position, pa.int64()), pa.array(segments, kind), pa.array(ok, pa.bool_())], ["conv_id", "turn", "position", "segments", "allowed"])


def _formatted(rows: Iterable[tuple], machine: Machine) -> Iterator[tuple]:
    """Turns with their segments; one turn is held back to know the last of a conversation."""
    t = machine.template
    last = None
    state = "start"
    for c, turn, role, text in rows:
        begins = last is None or last[0] != c
        if last is not None:
            if begins:
                yield (*last[:3], [*last[3], (t.end, False)], last[4] and state in t.final)
            else:
                yield last
        if begins:
            state = "start"
        segments = machine.segments(role, text)
        if begins:
            segments = [(t.begin, False), *segments]
        last = (c, turn, 0 if begins else last[2] + 1, segments, machine.allowed(state, role))
        state = role
    if last is not None:
        yield (*last[:3], [*last[3], (t.end, False)], last[4] and state in t.final)


def digests(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What can be read back from each formatted conversation.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid):
    the turns' digest is of role, line feed, text, line feed for each turn, the loss
    digest of all text under the loss mask, both unescaped.  Turns, their number and the
    loss come from reading the joined output; valid is the formatting machine's word.
    """
    configure(conversations.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in _read_back(_rows(batches), Machine(template)):
            held.append(row)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return _turns(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _read_back(rows: Iterable[tuple], machine: Machine) -> Iterator[tuple]:
    """Rows of digests, from what a reader finds in the joined segments of each conversation."""
    now: list | None = None
    reader = Reader(machine)

    def note(found: list[tuple]) -> None:
        for role, text, loss, _ in found:
            now[1] += 1
            for part in (role, "\n", text, "\n"):
                now[2].update(part.encode())
            if loss:
                now[3] += len(text)
                now[4].update(text.encode())

    def done() -> tuple:
        note(reader.close())
        return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), reader.place, now[5])

    for c, _, position, segments, ok in _formatted(rows, machine):
        if position == 0:
            if now is not None:
                yield done()
            now, reader = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), True], Reader(machine)
        for piece, _ in segments:
            note(reader.feed(piece))
        now[5] = now[5] and ok
    if now is not None:
        yield done()
