"""Chat formatting with a grammar round trip.

A conversation is rendered as turns ``<|im_start|>role\\ntext<|im_end|>\\n``. Conflicting content is escaped reversibly: one
backslash is put after the ``<`` of a ``<``, backslashes, ``|``, and taken out again when it is read. A turn is rendered with ever more of it escaped
(nothing, then all such sequences) and reparsed by a deterministic parser, whose grammar has no control string (``<|word|>``) inside a turn, until
the recovered role and text are those of the source.

The formatted conversation is a run of *pieces*, one a turn, each with its place in the whole and with the *loss mask*: the interval of the formatted
text that holds an assistant's words. ``read_back`` then takes nothing but the formatted text and the mask: it
parses the conversation as one text, whatever the pieces' borders, compares every recovered turn with the source's digest
and cuts the loss text out by the mask.

Turns are independent, so rendering runs before anything is shuffled. One conversation's digest needs its turns in order:
they are sorted by Spark within partitions and streamed, so a conversation of any length takes constant memory.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
#: The role whose texts the loss mask covers.
LEARN = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
#: Whatever looks like a control string, of this template or another.
_CONTROL = re.compile(r"<\|[A-Za-z0-9_]+\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) turns of rendered text, unescaped. ValueError unless it is made of whole turns whose roles and texts
    hold no control string."""
    out, at = [], 0
    while at < len(rendered):
        line = rendered.find("\n", at)
        if line < 0 or not rendered.startswith(START, at) or _CONTROL.search(rendered, at + len(START), line):
            raise ValueError(f"no turn begins at {at}")
        stop = _CONTROL.search(rendered, line + 1)
        if not stop or stop[0] != STOP or not rendered.startswith("\n", stop.end()):
            raise ValueError(f"the turn at {at} doesn't end")
        out.append((_unescape_role(rendered[at + len(START) : line]), unescape(rendered[line + 1 : stop.start()])))
        at = stop.end() + 1
    return out


def parse_ahead(text: str) -> tuple[list[tuple[str, str]], int]:
    """The whole turns at the beginning of text and where they end; ValueError if what follows can't become a turn."""
    out, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        stop = _CONTROL.search(text, line + 1) if line >= 0 else None
        if stop is None or stop.end() == len(text):  # not whole yet
            break
        out += parse(text[at : stop.end() + 1])
        at = stop.end() + 1
    return out, at


def render_turn(role: str, text: str) -> tuple[str, int, bool]:
    """One rendered turn, where its text begins and whether it had to be escaped: the first form that parses back to exactly this turn."""
    for conflict, (r, t) in ((False, (role, text)), (True, (_escape_role(role), escape(text)))):
        head = f"{START}{r}\n"
        form = f"{head}{t}{STOP}\n"
        try:
            if parse(form) == [(role, text)]:
                return form, len(head), conflict
        except ValueError:
            pass
    raise ValueError("the turn can't be rendered reversibly")


def _source(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{role}\n{text}\n".encode()).digest()


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, rendered, body (where the text begins), learn (whether the mask covers it), escaped, source (digest) for every row. Null roles and texts are empty."""
    names = "conv_id long, turn long, rendered string, body long, learn boolean, escaped boolean, source binary"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            turns = [(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            made = [(form, body, r == LEARN, escaped, _source(r, t)) for r, t in turns for form, body, escaped in [render_turn(r, t)]]
            types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), *columns], [x.split(" ")[0] for x in names.split(", ")])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, names)


PIECES = "conv_id long, n long, start long, formatted string, loss_start long, loss_end long, escaped boolean, source binary"


def pieces(conversations: DataFrame) -> DataFrame:
    """The formatted conversations: one row per turn with its number ``n``, its text and where that starts in the whole, and the interval
    of the loss mask in the whole (null: none). A conversation's rows are together, in order.

    Order: turn (nulls first), then the rendered text, so ties and repeated rows have one order. Null conv_id is a conversation. Very long
    texts are rendered whole. An empty table gives none.
    """

    def place(batches):
        import pyarrow as pa

        key, n, at = object(), 0, 0
        for b in batches:
            rows = []
            for conv, form, body, learn, escaped, source in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rendered", "body", "learn", "escaped", "source"))):
                if n == 0 or conv != key:
                    key, n, at = conv, 0, 0
                mask = (at + body, at + len(form) - len(STOP) - 1) if learn else (None, None)
                rows.append((conv, n, at, form, *mask, escaped, source))
                n, at = n + 1, at + len(form)
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split(" ")[0] for x in PIECES.split(", ")])

    placed = render(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return placed.mapInArrow(place, PIECES)


class _Reader:
    """Reads one conversation back from its formatted text, handed over in order, and its mask."""

    def __init__(self):
        self.rest, self.turns, self.chars, self.escaped = "", 0, 0, 0
        self.turn_hash, self.loss_hash, self.loss = hashlib.sha256(), hashlib.sha256(), 0
        self.want: list[bytes] = []

    def take(self, start: int, text: str, loss_start: int | None, loss_end: int | None, escaped: bool, source: bytes) -> None:
        if start != self.chars:
            raise ValueError("the pieces have gaps")
        self.chars += len(text)
        self.escaped += escaped
        self.want.append(source)
        self.rest += text
        found, at = parse_ahead(self.rest)
        self.rest = self.rest[at:]
        for role, said in found:
            if _source(role, said) != self.want.pop(0):
                raise ValueError("a recovered turn differs from its source")
            self.turns += 1
            self.turn_hash.update(f"{role}\n{said}\n".encode())
        if loss_start is not None:
            said = unescape(text[loss_start - start : loss_end - start])
            self.loss += len(said)
            self.loss_hash.update(said.encode())

    def close(self) -> tuple:
        if self.rest or self.want:
            raise ValueError("the formatted text ends inside a turn")
        return self.turns, self.turn_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars, self.escaped


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its pieces in order: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_escaped. Fails the job
    if a recovered turn isn't the source's."""
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long"

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split(" ")[0] for x in names.split(", ")])
        key, reader, out = None, None, []
        for b in batches:
            for conv, *piece in zip(*(b.column(c).to_pylist() for c in ("conv_id", "start", "formatted", "loss_start", "loss_end", "escaped", "source"))):
                if reader is None or conv != key:
                    if reader is not None:
                        out.append((key, *reader.close()))
                    key, reader = conv, _Reader()
                reader.take(*piece)
            if len(out) >= 2000:
                yield flush(out)
                out = []
        if reader is not None:
            out.append((key, *reader.close()))
        if out:
            yield flush(out)

    return formatted.mapInArrow(run, names)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation of conversations (conv_id, turn, role, text), read back from its formatted text; an empty table gives none."""
    return read_back(pieces(conversations))
