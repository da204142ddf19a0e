"""Chat formatting with a grammar round trip.

The grammar of a formatted conversation (a concatenation of turns; the opening string tells which):

    system     "<<SYS>>\\n" text "\\n<</SYS>>\\n\\n"
    user       "<s>[INST] " text " [/INST]"
    assistant  " " text " </s>"
    any other  "[ROLE " name "] " text " [/ROLE]"

A turn's text ends at the first closing string of its kind and holds no control string. Sources may
hold them, so every turn is rendered, parsed again and compared with its source; while that fails
or differs, the text is escaped. Escaping puts a backslash after the first character of each control
string, and one more where backslashes are already there; unescaping takes one away, so nothing is
lost. Turns are rendered one by one, so a conversation of any length needs no more memory.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import NULL_ID, Batches, map_batches, shown_id

# The strings that the template gives a meaning.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]")
OPENING = {"system": "<<SYS>>\n", "user": "<s>[INST] ", "assistant": " "}
CLOSING = {"system": "\n<</SYS>>\n\n", "user": " [/INST]", "assistant": " </s>"}
OTHER_OPENING, OTHER_NAME_END, OTHER_CLOSING = "[ROLE ", "] ", " [/ROLE]"

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile("|".join(rf"{re.escape(x[0])}\\*{re.escape(x[1:])}" for x in CONTROL))
_UNESCAPE = re.compile("|".join(rf"{re.escape(x[0])}\\+{re.escape(x[1:])}" for x in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def _escape_name(name: str) -> str:
    return escape(name).replace("%", "%25").replace("]", "%5D")


def _unescape_name(name: str) -> str:
    return unescape(name.replace("%5D", "]").replace("%25", "%"))


def _render(role: str, text: str) -> tuple[str, int]:
    """The turn and where its text begins in it."""
    if role in OPENING:
        return OPENING[role] + text + CLOSING[role], len(OPENING[role])
    start = OTHER_OPENING + _escape_name(role) + OTHER_NAME_END
    return start + text + OTHER_CLOSING, len(start)


def parse(formatted: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn at a place: role, unescaped text, begin and end of the text, end of the turn.

    Anything outside the grammar is a ValueError.
    """
    for role in ("system", "user", "assistant"):
        if formatted.startswith(OPENING[role], at):
            begin, closing = at + len(OPENING[role]), CLOSING[role]
            break
    else:
        if not formatted.startswith(OTHER_OPENING, at):
            raise ValueError(f"no turn begins at {at}")
        name_end = formatted.find(OTHER_NAME_END, at)
        if name_end < 0:
            raise ValueError(f"the role at {at} does not end")
        role = _unescape_name(formatted[at + len(OTHER_OPENING) : name_end])
        begin, closing = name_end + len(OTHER_NAME_END), OTHER_CLOSING
    end = formatted.find(closing, begin)
    if end < 0:
        raise ValueError(f"the turn at {at} does not end")
    if _CONTROL.search(formatted, begin, end):
        raise ValueError(f"a control string in the text at {begin}")
    return role, unescape(formatted[begin:end]), begin, end, end + len(closing)


def parse_all(formatted: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    at, out = 0, []
    while at < len(formatted):
        role, text, _, _, at = parse(formatted, at)
        out.append((role, text))
    return out


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text, escaped only as far as the round trip needs."""
    inner = text
    for _ in range(3):
        turn, begin = _render(role, inner)
        try:
            if parse(turn) == (role, text, begin, begin + len(inner), len(turn)):
                return turn, begin, begin + len(inner)
        except ValueError:
            pass
        inner = escape(inner)
    raise ValueError("a turn that can't be formatted")


def _format(batches: Batches) -> Batches:
    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        made = [format_turn(r or "", t or "") for r, t in zip(roles, texts)]
        loss = [r == "assistant" for r in roles]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] if x else None for m, x in zip(made, loss)], pa.int32()),
                pa.array([m[2] if x else None for m, x in zip(made, loss)], pa.int32()),
            ],
            ["conv_id", "turn", "formatted", "loss_begin", "loss_end"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_begin, loss_end), a row for each turn.

    A conversation is the concatenation of its turns' formatted text by turn, and equal turns by
    that text; NULL turns come first. The loss mask covers code points loss_begin up to loss_end of
    an assistant's turn and nothing of others (NULL). NULL texts and roles are empty; a role other than system,
    user and assistant, empty included, is written by name. Repeated rows are turns of their own.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return map_batches(own, _format, "conv_id long, turn long, formatted string, loss_begin int, loss_end int")


class _Summary:
    """Counts and digests of one conversation, read back from its formatted turns."""

    def __init__(self, conv_id: int):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: int | None, end: int | None) -> None:
        at = 0
        while at < len(formatted):
            role, text, _, _, at = parse(formatted, at)
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)
        if begin is not None:
            text = unescape(formatted[begin:end])
            self.loss += len(text)
            self.masked.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id,
            "n_turns": self.turns,
            "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.loss,
            "loss_sha256": self.masked.hexdigest(),
            "formatted_chars": self.chars,
        }


_SUMMARY = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _read_back(batches: Batches) -> Batches:
    """Turns sorted by conversation and place: one open conversation at a time, none held."""
    now, rows = None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_begin", "loss_end"))
        for conv_id, formatted, begin, end in zip(*columns):
            if now is None or now.conv_id != conv_id:
                if now:
                    rows.append(now.row())
                now = _Summary(conv_id)
            now.add(formatted, begin, end)
        if len(rows) >= 5000:
            yield pa.RecordBatch.from_pylist(rows, _SUMMARY)
            rows = []
    if now:
        rows.append(now.row())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SUMMARY)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what parsing the result of format_turns gives: counts and digests.

    The digest of a conversation needs its turns in order; they stream through one task, sorted by
    Spark, which spills, so a conversation of any size is neither collected nor joined to one text.
    A NULL conv_id is a conversation of its own. No rows give no rows.
    """
    keyed = formatted.withColumn("conv_id", F.coalesce("conv_id", F.lit(NULL_ID)))
    ordered = keyed.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "formatted")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_batches(ordered, _read_back, schema).withColumn("conv_id", shown_id("conv_id"))
