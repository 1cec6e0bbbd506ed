"""Conversations to text segments with loss flags, from a declarative template.

A finite-state machine over the roles says for every turn whether it may follow the ones before; a turn that may not
is formatted all the same and marked. The template lists, per role, the marks around the text and which part counts
for the loss. Reserved strings inside roles and texts are escaped: a backslash goes in behind their first character,
and one more where backslashes stand there already, so taking one away again restores every text exactly.

Rules: a null text or role is empty; turns are ordered by (turn, role, text), nulls first; repeated rows are turns of
their own; rows with a null conversation id form one conversation; a role that the template doesn't list uses its
`other` parts and is never allowed; other columns are ignored; an empty table gives no segments.

Rows of a conversation are sorted and streamed: a task holds one batch and the state of one conversation, so a
conversation that has a third of all rows takes long, but no more memory than a short one. (SHA-256 of a whole
conversation can only be computed in order; the formatting itself needs one turn of look-back.)
"""

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts of a template; every other part is a mark.
ROLE, TEXT, LOSS_TEXT = "{role}", "{text}", "{text:loss}"

_PLAIN = ("<|turn|>", ROLE, "<|text|>", TEXT, "<|end|>")
_LEARNED = ("<|turn|>", ROLE, "<|text|>", LOSS_TEXT, "<|end|>")


@dataclass(frozen=True)
class Template:
    """`parts` per role, `other` for the rest; each begins with `turn`, has one role, `text` mark, one text, and `end`.

    `moves` maps a state and a role to the next state, which carries the role's name; `final` are the states in
    which a conversation may end.
    """

    parts: dict = field(default_factory=lambda: {"system": _PLAIN, "user": _PLAIN, "assistant": _LEARNED})
    other: tuple = _PLAIN
    moves: dict = field(default_factory=lambda: {
        "start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    final: frozenset = frozenset({"user", "assistant"})
    reserved: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def marks(self):
        found = {p for parts in [*self.parts.values(), self.other] for p in parts if p not in (ROLE, TEXT, LOSS_TEXT)}
        return sorted(found | set(self.reserved), key=lambda m: (-len(m), m))

    def check(self):
        """Escaping is reversible if no mark has a backslash and no end of a mark begins another one."""
        marks = self.marks()
        for a in marks:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"mark {a!r}: at least two characters, no backslash")
            for b in marks:
                if a != b and a in b or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")
        for parts in [*self.parts.values(), self.other]:
            if len(parts) != 5 or parts[1] != ROLE or parts[3] not in (TEXT, LOSS_TEXT):
                raise ValueError(f"parts {parts}: mark, role, mark, text, mark")
        return self

    def escaper(self):
        found = re.compile("|".join(f"{re.escape(m[0])}\\\\*{re.escape(m[1:])}" for m in self.marks()))
        return lambda s: found.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", s)

    def unescaper(self):
        found = re.compile("|".join(f"{re.escape(m[0])}\\\\+{re.escape(m[1:])}" for m in self.marks()))
        return lambda s: found.sub(lambda m: m[0][0] + m[0][2:], s)


DEFAULT = Template()

SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int64()), ("text", pa.string()),
                      ("loss", pa.bool_()), ("allowed", pa.bool_())])
CONVERSATIONS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                           ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                           ("valid", pa.bool_())])
_NONE = object()


def _segments(template):
    def run(batches):
        escape, conv, state, turn_no, at = template.escaper(), _NONE, "start", 0, 0
        for batch in batches:
            out = [[] for _ in SEGMENTS]
            for c, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "role", "text")]):
                if c != conv:
                    conv, state, turn_no, at = c, "start", 0, 0
                role, text = role or "", text or ""
                allowed = role in template.moves.get(state, ())
                state = role
                for part in template.parts.get(role, template.other):
                    said = escape(role) if part == ROLE else escape(text) if part in (TEXT, LOSS_TEXT) else part
                    for column, value in zip(out, (c, turn_no, at, said, part == LOSS_TEXT, allowed)):
                        column.append(value)
                    at += 1
                turn_no += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, SEGMENTS)], schema=SEGMENTS)
    return run


def segments(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, turn_no, segment, text, loss, allowed: the formatted conversations, partitioned by conversation and in
    order within a partition. The formatted text of a conversation is its segments, one after the other."""
    template.check()
    rows = (conversations.selectExpr("CAST(conv_id AS BIGINT) conv_id", "CAST(turn AS BIGINT) turn",
                                     "CAST(role AS STRING) role", "CAST(text AS STRING) text")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))
    return rows.mapInArrow(_segments(template), "conv_id long, turn_no long, segment long, text string, loss boolean, allowed boolean")


class _Reader:
    """Reads one conversation back from its segments."""

    def __init__(self, template, conv):
        self.template, self.conv, self.turns, self.chars, self.loss_chars, self.valid = template, conv, 0, 0, 0, True
        self.said, self.loss, self.buffer, self.role = hashlib.sha256(), hashlib.sha256(), [], None

    def row(self):
        return (self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.valid and self.role in self.template.final)


def _read(template):
    def run(batches):
        unescape = template.unescaper()
        ends = {parts[-1] for parts in [*template.parts.values(), template.other]}
        opens = "|".join(re.escape(m) for m in sorted({p[0] for p in [*template.parts.values(), template.other]}))
        middles = "|".join(re.escape(m) for m in sorted({p[2] for p in [*template.parts.values(), template.other]}))
        turn = re.compile(f"(?:{opens})(.*?)(?:{middles})(.*)(?:{'|'.join(map(re.escape, sorted(ends)))})", re.DOTALL)
        now, done = None, []

        def flush():
            rows = list(zip(*done)) or [[] for _ in CONVERSATIONS]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(rows, CONVERSATIONS)], schema=CONVERSATIONS)

        for batch in batches:
            for conv, text, loss, allowed in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "text", "loss", "allowed")]):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(template, conv)
                now.chars += len(text)
                now.buffer.append(text)
                now.valid &= allowed
                if loss:
                    plain = unescape(text)
                    now.loss_chars += len(plain)
                    now.loss.update(plain.encode())
                if text in ends:
                    now.role, said = map(unescape, turn.fullmatch("".join(now.buffer)).groups())
                    now.said.update(f"{now.role}\n{said}\n".encode())
                    now.turns += 1
                    now.buffer = []
            yield flush()
        if now is not None:
            done.append(now.row())
            yield flush()
    return run


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, parsed from the text and loss flags of `segments` as that function returns them:
    roles and texts are found by the marks and unescaped. `valid`: all turns in order, and an end the machine accepts."""
    return formatted.mapInArrow(_read(template.check()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                                         "loss_sha256 string, formatted_chars long, valid boolean")
