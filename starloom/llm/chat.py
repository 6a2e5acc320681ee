"""Chat formatting: a finite-state machine over roles and a declarative template.

Each turn becomes three segments: an opening control string, the escaped text and a
closing control string; only the text of a role in ``Template.learn`` carries loss.
Escaping puts a backslash before each backslash and each control string inside a
text; no control string holds a backslash, so dropping it again is exact.

Turns go through in order, one conversation after another, with O(1) state for each
conversation: a conversation of any length is neither collected nor buffered.

Defined results: null text and null role are empty; a role without a form in the
template takes the generic form, which carries the role's name; a turn order the
machine refuses is formatted all the same and its conversation has valid = false;
turns with equal numbers go by role, then text (null turns first); rows with a null
conversation id are one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


@dataclass(frozen=True)
class Template:
    """forms: role -> (opening, closing).  generic: (opening, after the name, closing) for other roles."""

    forms: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")})
    generic: tuple[str, str, str] = ("<role:>", "<text:>", "<end:>")
    learn: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str], ...] = (("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    final: tuple[str, ...] = ("user", "assistant")

    def controls(self) -> list[str]:
        return sorted({s.strip() for f in (*self.forms.values(), self.generic) for s in f}, key=lambda s: (-len(s), s))

    def escape(self, text: str) -> str:
        return re.sub(r"\\|" + "|".join(map(re.escape, self.controls())), lambda m: "\\" + m[0], text)

    def opening(self, role: str) -> str:
        return self.forms[role][0] if role in self.forms else self.generic[0] + self.escape(role) + self.generic[1]

    def closing(self, role: str) -> str:
        return self.forms[role][1] if role in self.forms else self.generic[2]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n (place in the conversation), part (0 opening, 1 text, 2 closing), segment, loss, allowed.

    ``allowed`` says whether the machine could take this turn; rows of a conversation
    come out together and in order.
    """
    small_batches(turns.sparkSession)
    t = template or Template()
    moves, escaped = set(t.moves), t.escape
    learn = set(t.learn)
    df = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        now, state, n = object(), t.start, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    now, state, n = conv, t.start, 0
                ok, state = (state, role) in moves, role
                for part, s in enumerate((t.opening(role), escaped(text), t.closing(role))):
                    for column, v in zip(out, (conv, n, part, s, part == 1 and role in learn, ok), strict=True):
                        column.append(v)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_()), pa.array(out[5], pa.bool_())], ["conv_id", "n", "part", "segment", "loss", "allowed"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return df.mapInArrow(run, f"conv_id {kind}, n bigint, part int, segment string, loss boolean, allowed boolean")


class Reader:
    """Reads formatted text back, turn by turn, from the text and the loss mask alone."""

    def __init__(self, template: Template):
        self.t = template
        controls = template.controls()
        self.token = re.compile(r"\\.|" + "|".join(map(re.escape, controls)), re.S)
        self.opens = {o.strip(): r for r, (o, _) in template.forms.items()}

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn in a text made of whole turns."""
        at = 0
        while at < len(text):
            m = self.token.match(text, at)
            role = self.opens.get(m[0])
            if role is not None:
                opening, closing = self.t.forms[role]
                at += len(opening)
            else:
                after, closing = self.t.generic[1:]
                end = self._find(text, m.end(), after)
                role, at = unescape(text[m.end() : end]), end + len(after)
            bare = self._find(text, at, closing.strip())
            end = bare - (len(closing) - len(closing.lstrip()))
            yield role, unescape(text[at:end])
            at = end + len(closing)

    def _find(self, text: str, at: int, control: str) -> int:
        """The next place of an unescaped control string."""
        for m in self.token.finditer(text, at):
            if m[0] == control:
                return m.start()
        raise ValueError("a turn has no end")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid from the segments, in one pass."""
    t = template or Template()
    final = set(t.final)

    def run(batches):
        reader, now, sums, pending = Reader(t), None, None, ""
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

        def closed(conv, s, kind):
            row = [conv, s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"], s["ok"] and s["role"] in final]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]

        kind = None
        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for conv, n, part, s, loss, ok in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sums is None or n == 0 and part == 0:
                    if sums is not None:
                        rows.append(closed(now, sums, kind))
                    now, sums = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "ok": True, "role": ""}
                pending += s
                sums["all"] += len(s)
                sums["ok"] &= ok
                if loss:
                    plain = unescape(s)
                    sums["chars"] += len(plain)
                    sums["loss"].update(plain.encode())
                if part == 2:
                    for role, text in reader.turns(pending):
                        sums["n"] += 1
                        sums["role"] = role
                        sums["turns"].update(f"{role}\n{text}\n".encode())
                    pending = ""
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows, strict=True)], names)
        if sums is not None:
            yield pa.RecordBatch.from_arrays(closed(now, sums, kind), names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
