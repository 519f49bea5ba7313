"""Chat formatting with a grammar that reads its own output back.

A conversation is its turns one after the other, each ``<|start|>role<|text|>text<|end|>`` with a line end. Rendering
takes the lightest form of a turn that the parser gives back unchanged: first as it is, then with control strings
escaped, then with every character escaped that is not a letter, a digit or a blank. Turns are rows in order, so a conversation may be
longer than a cell can hold.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
# Control strings of common templates (fixed values).
CONTROL_STRINGS = (
    START, TEXT, "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<unk>", "<pad>",
)
#: An escaped character is this mark, its code point in hexadecimal, and a semicolon.
MARK = "\\u"
_MARKED = re.compile(r"\\u([0-9a-f]+);")
_CONTROL = re.compile("|".join(map(re.escape, sorted((*CONTROL_STRINGS, MARK), key=len, reverse=True))))
_ODD = re.compile(r"[^0-9A-Za-z ]")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)


def _escaped_first(match: re.Match) -> str:
    return f"{MARK}{ord(match[0][0]):x};{match[0][1:]}"


#: Forms of a text, lightest first; the last one can't conflict with any control string.
FORMS = (lambda text: text, lambda text: _CONTROL.sub(_escaped_first, text), lambda text: _ODD.sub(_escaped_first, text))


def unescape(text: str) -> str:
    return _MARKED.sub(lambda match: chr(int(match[1], 16)), text)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """Turns of a formatted text: role, text, and the range of the text's form; None if it is not of the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        match = _TURN.match(formatted, at)
        if not match:
            return None
        turns.append((unescape(match[1]), unescape(match[2]), match.start(2), match.end(2)))
        at = match.end()
    return turns


def render_turn(role: str, text: str) -> str:
    """The turn in the lightest form that holds no control string and parses to itself."""
    for form in FORMS:
        bare = form(role) + "\n" + form(text)
        formatted = START + form(role) + TEXT + form(text) + END
        if any(control in bare for control in CONTROL_STRINGS):
            continue
        turns = parse(formatted)
        if turns is not None and [turn[:2] for turn in turns] == [(role, text)]:
            return formatted
    raise AssertionError("the last form always parses")


def render(batches: Iterator[pa.RecordBatch], trained_role: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces, starts, ends = [], [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            formatted = render_turn(role or "", text or "")
            pieces.append(formatted)
            start, end = parse(formatted)[0][2:]
            trained = role == trained_role
            starts.append(start if trained else None)
            ends.append(end if trained else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array(pieces, pa.string()),
             pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            names=["conv_id", "turn", "formatted", "loss_start", "loss_end"],
        )


def format_conversations(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, turn, formatted, loss_start and loss_end: each row's formatted piece and, for turns to train on, the
    characters of it under the loss mask.

    A conversation's text is its pieces in the order of turn, then of the piece. Null texts and roles are empty. Null
    conv_ids are one conversation, repeated rows repeat their turn. Other columns are not read.
    """
    kinds = {name: conversations.schema[name].dataType.simpleString() for name in ("conv_id", "turn")}
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(
        lambda batches: render(batches, trained_role),
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, loss_start long, loss_end long",
    )


class _Reading:
    """What has been read of one conversation so far."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, piece: str, loss_start: int | None, loss_end: int | None) -> None:
        turns = parse(piece)
        if turns is None:
            raise ValueError(f"conversation {self.conv_id} is not of the grammar")
        for role, text, _, _ in turns:
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        self.chars += len(piece)
        if loss_start is not None:
            trained = unescape(piece[loss_start:loss_end])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_pieces(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its pieces in order; one conversation's text is never held as a whole."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    reading, done = None, []

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if reading is None or reading.conv_id != row[0]:
                if reading is not None:
                    done.append(reading.row())
                reading = _Reading(row[0])
            reading.take(*row[1:])
        if done:
            yield flushed()
            done = []
    if reading is not None:
        done.append(reading.row())
        yield flushed()


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, parsed back from formatted pieces.

    Pieces are sorted by Spark and streamed, so a very long conversation costs time, not memory.
    """
    id_type = formatted.schema["conv_id"].dataType
    arrow_type = pa.int32() if id_type.simpleString() == "int" else pa.string() if id_type.simpleString() == "string" else pa.int64()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        lambda batches: read_pieces(batches, arrow_type),
        f"conv_id {id_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )
