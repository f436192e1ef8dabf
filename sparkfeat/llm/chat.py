"""Chat formatting: a finite-state machine over roles, segments with loss flags, and the way back.

A ``Template`` is data: the marks before and after a turn of each role, whether the turn's text is
learned from, and the machine's transitions. Turns are dealt by ranges of (conversation, turn), so that one
long conversation spreads over tasks. Each task sums up the pieces of conversations at its ends as maps
from states to states; composed in the order of the ranges, these give every task the state and
position with which it starts, and a second pass emits the segments.

Control strings inside texts are broken up by the escape character after their first character, and
the escape character itself is doubled; ``unescape`` is the exact inverse, so the reader finds a turn's end at the
first closing mark whatever the text says.

Defined results: a null text or role is the empty text; a role that the template does not know takes
the fallback turn, which carries its name; rows of equal conversation and turn go by role, then text, repeated
rows are turns of their own, null turns come first, null conversation ids are one conversation. A
conversation that the machine rejects is formatted all the same, ``state`` is "error" from the first wrong turn on.
Very long texts are cut nowhere; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import partitions
from sparkfeat.session import ensure_checkpoint_dir

ESCAPE = "\\"
ERROR = "error"


@dataclass(frozen=True)
class Turn:
    """The marks around a turn's text, and whether the text is learned from."""
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    fallback: Turn                       # after its opening mark comes the role's name, then ``name_end``
    name_end: str
    start: str
    transitions: dict[tuple[str, str], str]
    names: list[str] = field(init=False)

    def __post_init__(self):
        opening = [t.before for t in self.turns.values()] + [self.fallback.before]
        closing = [t.after for t in self.turns.values()] + [self.fallback.after, self.name_end]
        for a in opening:
            if not a or sum(b.startswith(a) for b in opening) > 1:
                raise ValueError(f"opening mark {a!r} is empty or begins another")
        for c in closing:
            if any(c[:i] == c[-i:] for i in range(1, len(c))):
                raise ValueError(f"closing mark {c!r} overlaps itself")
        for c in self.controls:
            if len(c) < 2 or ESCAPE in c:
                raise ValueError(f"control string {c!r} is too short or holds the escape character")
        states = {self.start, *self.transitions.values(), *(s for s, _ in self.transitions)} - {ERROR}
        object.__setattr__(self, "names", [*sorted(states), ERROR])

    @property
    def controls(self) -> list[str]:
        """What a text may not hold: the marks without surrounding white space."""
        marks = [self.name_end, *(m for t in [*self.turns.values(), self.fallback] for m in (t.before, t.after))]
        return sorted({m.strip() for m in marks})

    @cached_property
    def _control(self) -> re.Pattern:
        # the rest is looked at, not consumed: overlapping control strings are all broken up
        return re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)]))

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: m[0] + ESCAPE, text)

    @staticmethod
    def unescape(text: str) -> str:
        return _ESCAPED.sub(lambda m: ESCAPE * (len(m[0]) // 2), text) if ESCAPE in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's formatted text as pieces with loss flags."""
        turn = self.turns.get(role)
        if turn is None:
            return [(self.fallback.before + self.escape(role) + self.name_end, False),
                    (self.escape(text), self.fallback.loss), (self.fallback.after, False)]
        return [(turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]

    def step(self, role: str) -> tuple[int, ...]:
        """The machine's move on a role, as a map from every state to the next."""
        return tuple(self.names.index(self.transitions.get((s, role), ERROR)) for s in self.names)


#: ``escape`` doubles an escape character and puts a single one behind a control string's first
#: character; a run of 2n + 1 of them is n own ones and that mark, whichever came first
_ESCAPED = re.compile(re.escape(ESCAPE) + "+")

INSTRUCT = Template(
    turns={"system": Turn("<<SYS>> ", " <</SYS>>\n"), "user": Turn("[INST] ", " [/INST]\n"),
           "assistant": Turn("<s> ", " </s>\n", loss=True)},
    fallback=Turn("[ROLE] ", " [END]\n"), name_end=" [/ROLE]\n", start="start",
    transitions={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
                 ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
)


class Reader:
    """Reads turns back from a conversation's formatted text, given in chunks of any size. Holds one turn."""

    def __init__(self, template: Template):
        self.template, self.rest = template, ""
        self.opening = [(t.before, role, t.after) for role, t in template.turns.items()]

    def read(self, chunk: str) -> Iterator[tuple[str, str]]:
        self.rest += chunk
        at = 0
        while at < len(self.rest):
            found = self._turn(at)
            if found is None:
                break
            role, text, at = found
            yield role, text
        self.rest = self.rest[at:]

    def _turn(self, at: int) -> tuple[str, str, int] | None:
        t = self.template
        for before, role, after in self.opening:
            if self.rest.startswith(before, at):
                begin = at + len(before)
                break
        else:
            if not self.rest.startswith(t.fallback.before, at):
                if any(b.startswith(self.rest[at:]) for b in [*(o[0] for o in self.opening), t.fallback.before]):
                    return None                                       # the chunk ends inside the mark
                raise ValueError(f"no turn begins at {self.rest[at:at + 40]!r}")
            begin, after = at + len(t.fallback.before), t.fallback.after
            end = self.rest.find(t.name_end, begin)
            if end < 0:
                return None
            role, begin = t.unescape(self.rest[begin:end]), end + len(t.name_end)
        end = self.rest.find(after, begin)
        return None if end < 0 else (role, t.unescape(self.rest[begin:end]), end + len(after))


def _compose(first: tuple[int, ...], then: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(then[s] for s in first)


def format_turns(df: DataFrame, template: Template = INSTRUCT, *, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, place (from 0, in its conversation), role, state (of the machine after the turn),
    segments (array of text and loss). A conversation's formatted text is its segments' texts in order."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                      text(role_col).alias("role"), text(text_col).alias("text"))
    # the ranges hold their rows in order and keep them: a checkpoint is read partition by partition
    ranged = (turns.repartitionByRange(partitions(spark), "conv_id", "turn", "role", "text")
              .sortWithinPartitions("conv_id", "turn", "role", "text")
              .select("conv_id", "role", "text", F.spark_partition_id().alias("part")).checkpoint())
    same = tuple(range(len(template.names)))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's first and last piece of a conversation: (id, map, turns)."""
        pieces: list[list] = []
        part = None
        moves: dict[str, tuple[int, ...]] = {}
        for b in batches:
            for conv, role, part in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "part")), strict=True):
                if not pieces or pieces[-1][0] != conv:
                    pieces = [*pieces[:1], [conv, same, 0]]
                move = moves.get(role) or template.step(role)
                if len(moves) < 1000:
                    moves[role] = move
                pieces[-1][1:] = _compose(pieces[-1][1], move), pieces[-1][2] + 1
        if pieces:
            yield pa.RecordBatch.from_pydict({
                "part": [part], "alone": [len(pieces) == 1], "first": pa.array([pieces[0][0]], pa.int64()), "last": pa.array([pieces[-1][0]], pa.int64()),
                "first_map": [list(pieces[0][1])], "last_map": [list(pieces[-1][1])], "first_n": [pieces[0][2]], "last_n": [pieces[-1][2]]})

    begin = template.names.index(template.start)
    carried: dict[int, tuple[int, int]] = {}                        # range → state and place of its first turn
    conv, state, n = object(), begin, 0
    # one row per range, whatever the ranges hold
    for r in sorted(ranged.select("conv_id", "role", "part").mapInArrow(
            ends, "part long, alone boolean, first long, last long, first_map array<long>, last_map array<long>, first_n long, last_n long").collect(),
            key=lambda r: r["part"]):
        state, n = (state, n) if r["first"] == conv else (begin, 0)
        carried[r["part"]] = (state, n)
        if r["alone"]:
            conv, state, n = r["first"], r["first_map"][state], n + r["first_n"]
        else:
            conv, state, n = r["last"], r["last_map"][begin], r["last_n"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, n, begun = None, begin, 0, False
        moves: dict[str, tuple[int, ...]] = {}
        for b in batches:
            convs, roles, texts, parts = (b.column(c).to_pylist() for c in ("conv_id", "role", "text", "part"))
            places, states, segments = [], [], []
            for c, role, t, part in zip(convs, roles, texts, parts, strict=True):
                if not begun:
                    conv, begun, (state, n) = c, True, carried[part]
                elif c != conv:
                    conv, state, n = c, begin, 0
                move = moves.get(role) or template.step(role)
                if len(moves) < 1000:
                    moves[role] = move
                state = move[state]
                places.append(n)
                states.append(template.names[state])
                segments.append([{"text": s, "loss": loss} for s, loss in template.segments(role, t)])
                n += 1
            yield pa.RecordBatch.from_pydict({
                "conv_id": b.column("conv_id"), "place": pa.array(places, pa.int64()), "role": b.column("role"), "state": states,
                "segments": pa.array(segments, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))})
    return ranged.mapInArrow(emit, "conv_id long, place long, role string, state string, segments array<struct<text:string,loss:boolean>>")


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation of ``format_turns``, from its formatted text alone: conv_id, n_turns, turns_sha256 (of
    role, newline, text, newline per turn), loss_chars and loss_sha256 (of the unescaped text under the loss
    mask), formatted_chars, and valid (the machine's verdict). The digests of a conversation are sequential, so
    one task reads it, turn by turn, and holds no more than one turn."""
    ordered = (formatted.select("conv_id", "place", "state", "segments").repartition(partitions(formatted.sparkSession), "conv_id")
               .sortWithinPartitions("conv_id", "place"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for conv, state, segments in zip(*(b.column(c).to_pylist() for c in ("conv_id", "state", "segments")), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Digest(conv, template)
                now.take(state, segments)
            yield _table(done)
        if now:
            yield _table([now.row()])
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


class _Digest:
    def __init__(self, conv: int | None, template: Template):
        self.conv, self.template, self.reader = conv, template, Reader(template)
        self.turns, self.loss, self.n, self.learned, self.chars, self.state = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""

    def take(self, state: str, segments: list[dict]) -> None:
        self.state = state
        for s in segments:
            self.chars += len(s["text"])
            if s["loss"]:
                text = self.template.unescape(s["text"])
                self.learned += len(text)
                self.loss.update(text.encode())
        for role, text in self.reader.read("".join(s["text"] for s in segments)):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())

    def row(self) -> tuple:
        if self.reader.rest:
            raise ValueError(f"conversation {self.conv} ends inside a turn")
        return (self.conv, self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.chars, self.state != ERROR)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
             "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "valid": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _digest_sql(t: Template) -> str:
    """The query of operator 13 in DuckDB: lengths of marks by role, and one character for each escaped place."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    marks = " ".join(f"WHEN {quoted(r)} THEN {len(x.before) + len(x.after)}" for r, x in t.turns.items())
    other = len(t.fallback.before) + len(t.name_end) + len(t.fallback.after)
    escapes = lambda c: " + ".join(
        f"(length({c}) - length(replace({c}, {quoted(s)}, ''))) // {len(s)}" for s in [ESCAPE, *t.controls])
    learned = ", ".join(quoted(r) for r, x in t.turns.items() if x.loss)
    moves = ", ".join(quoted(f"{a}>{b}") for a, b in _pairs(t))
    return f"""
WITH given AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
        coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), {quoted(t.start)}) || '>' || role AS move FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({learned})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role IN ({learned})), '')) AS loss_sha256,
  CAST(sum(length(text) + {escapes("text")} + CASE role {marks} ELSE {other} + length(role) + {escapes("role")} END) AS BIGINT) AS formatted_chars,
  bool_and(move IN ({moves})) AS valid
FROM o GROUP BY conv_id
"""


def _pairs(t: Template) -> list[tuple[str, str]]:
    """The moves of a template whose states are the roles last seen."""
    return [(a, b) for (a, b), to in t.transitions.items() if to == b]


DIGEST_SQL = _digest_sql(INSTRUCT)
