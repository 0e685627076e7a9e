"""Operator 3: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that
reply is trainable.  Every example is stored whole, context and reply, however long it is; it lies in rows of at most
``WHOLE`` characters (most examples fit into one), each with its place in the example, where its new text starts and,
where the loss mask reaches into it (``trainable``), the start and end of the mask in the example.  ``expand`` joins them.
Turns after the last reply are stored in the same way, with all before them, and have no mask.

Template: ``### role: text</turn>`` and a line feed for each turn.  In texts and roles a backslash is
put before every backslash and before the control strings ``###`` and ``</turn>``, in roles also before
``:``; ``unescape`` takes each such backslash away, so any text comes back unchanged.

Scale: rows are dealt by conversation, sorted by turn on disk, and streamed; state is a turn and ``LINK`` bytes of the
conversation, what is beyond lies in a temporary file of the task (``expand`` needs one whole example).  What is stored
grows with the square of a conversation's turns, and one task makes the examples of a conversation: that is the
method's size.  Reading back, each row is reduced to what is new in it and to checks of the rest before the shuffle.

Defined results: null text or role counts as empty.  A null turn sorts first; rows that share a turn
are ordered by role, then text, and all count.  A null conv_id is a conversation of its own.
An empty table gives no rows.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import zlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TURN_END = "</turn>"
WHOLE = 1 << 14  # characters of a stored row at most
LINK = 1 << 20  # bytes of a conversation in memory; more are linked in from a file
EXAMPLES = "conv_id long, example long, trainable boolean, chars_before long, text string, new_from long, loss_start long, loss_end long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_FORMATTED = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head(role: str) -> str:
    return f"### {_ROLE_CONTROL.sub(lambda m: chr(92) + m[0], role)}: "


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of every turn."""
    out, at = [], 0
    while at < len(formatted):
        m = _FORMATTED.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_EXAMPLE_TYPES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("trainable", pa.bool_()), ("chars_before", pa.int64()), ("text", pa.string()), ("new_from", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_NEW_TYPES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("chars_before", pa.int64()), ("new_from", pa.int64()), ("new", pa.string()), ("masked", pa.string()), ("crc_before", pa.int64()), ("crc", pa.int64())])
_NEW = "conv_id long, example long, chars_before long, new_from long, new string, masked string, crc_before long, crc long"
_DIGEST_TYPES = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])
_NO = object()


class _Text:
    """A growing text in pieces of ``WHOLE`` characters; all but the last lie in a file once they take ``LINK`` bytes."""

    def __init__(self):
        self.width, self.tail, self.places, self.file = WHOLE, "", [0], None

    def __len__(self) -> int:
        return (len(self.places) - 1) * self.width + len(self.tail)

    def add(self, text: str) -> None:
        text, full = self.tail + text, (len(self.tail) + len(text)) // self.width
        if full:
            self.file = self.file or tempfile.SpooledTemporaryFile(LINK)
            self.file.seek(self.places[-1])
            for k in range(full):
                self.places.append(self.places[-1] + self.file.write(text[k * self.width : (k + 1) * self.width].encode()))
        self.tail = text[full * self.width :]

    def pieces(self) -> Iterator[tuple[int, str]]:
        """(characters before, text) of each."""
        for k, (a, b) in enumerate(pairwise(self.places)):
            self.file.seek(a)
            yield k * self.width, self.file.read(b - a).decode()
        if self.tail:
            yield (len(self.places) - 1) * self.width, self.tail

    def close(self) -> None:
        if self.file:
            self.file.close()


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Turns in order -> the rows of every example."""
    conv, whole, before, example = _NO, _Text(), 0, 0  # before: characters up to the last reply

    def stored(start: int | None = None, end: int | None = None) -> Iterator[tuple]:
        for at, text in whole.pieces():
            upto = at + len(text)
            trainable = start is not None and (at <= start < upto or start < at < end)
            yield conv, example, trainable, at, text, min(len(text), max(0, before - at)), *((start, end) if trainable else (None, None))

    for conv_id, _, role, text in _rows(batches):
        if conv_id != conv:
            if len(whole) > before:
                yield from stored()
            whole.close()
            conv, whole, before, example = conv_id, _Text(), 0, 0
        top, body = head(role or ""), escape(text or "")
        start = len(whole) + len(top)
        whole.add(f"{top}{body}{TURN_END}\n")
        if role == "assistant":
            yield from stored(start, start + len(body))
            before, example = len(whole), example + 1
    if len(whole) > before:
        yield from stored()
    whole.close()


def format_examples(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """The examples of all conversations (conv_id, turn, role, text)."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    dealt = (turns.repartition(partitions, "conv_id") if partitions else turns.repartition("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lambda batches: _batches(_examples(batches), _EXAMPLE_TYPES), EXAMPLES)


def expand(examples: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: the whole text of every trainable example."""
    types = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, parts, size, mask = (_NO, _NO), [], 0, None
            for conv_id, example, trainable, before, text, _, start, end in _rows(batches):
                if (conv_id, example) != at:
                    if mask:
                        yield *at, "".join(parts), *mask
                    at, parts, size, mask = (conv_id, example), [], 0, None
                assert before == size, "a row of an example is missing"
                parts.append(text)
                size += len(text)
                mask = (start, end) if trainable else mask
            if mask:
                yield *at, "".join(parts), *mask

        yield from _batches(rows(), types)

    names = [f.name for f in _EXAMPLE_TYPES]
    ordered = examples.select(*names).repartition("conv_id", "example").sortWithinPartitions("conv_id", "example", "chars_before")
    return ordered.mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")


def _crc(text: str, start: int = 0) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"), start)


def _new(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each row: what is new in its text, what of that is under the loss mask, and checks of the context and of all."""
    for conv_id, example, trainable, before, text, new_from, start, end in _rows(batches):
        masked = text[max(0, start - before) : end - before] if trainable else None
        check = _crc(text[:new_from])
        yield conv_id, example, before, new_from, text[new_from:], masked, check, _crc(text[new_from:], check)


class _Read:
    """A conversation read back row by row: every example has to hold the same text as the one before it, and more."""

    def __init__(self):
        self.turns, self.sha, self.loss_chars, self.loss_sha, self.chars, self.examples = 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0
        self.known: dict[int, tuple[int, int]] = {}  # length and check of the text at each place
        self.example, self.covered, self.rest, self.masked, self.last = None, 0, [], None, None

    def add(self, example: int, before: int, new_from: int, new: str, masked: str | None, crc_before: int, crc: int) -> None:
        if example != self.example:
            self.end()
            self.example, self.covered = example, 0
        assert example == self.examples and before == self.covered, "an example is missing"
        assert self.known.get(before, (0, 0)) == (new_from, crc_before), "the context of an example is not what stands before it"
        self.covered += new_from + len(new)
        self.known[before] = new_from + len(new), crc
        self.chars += len(new)
        if new:
            self.rest.append(new)
            if TURN_END + "\n" in "".join(self.rest[-2:])[-len(new) - len(TURN_END) :]:
                self.parsed()
        if masked is not None:
            self.masked = [*(self.masked or []), masked]

    def parsed(self) -> None:
        """Takes the turns that are complete."""
        text, at = "".join(self.rest), 0
        while m := _FORMATTED.match(text, at):
            self.last, at = (unescape(m[1]), unescape(m[2])), m.end()
            self.turns += 1
            self.sha.update(f"{self.last[0]}\n{self.last[1]}\n".encode("utf-8", "surrogatepass"))
        self.rest = [text[at:]] if at < len(text) else []

    def end(self) -> None:
        """An example ends."""
        assert not self.rest, f"no turn at character {self.chars - sum(map(len, self.rest))}"
        assert self.covered == self.chars, "an example is not whole"
        if self.masked is not None:
            reply = unescape("".join(self.masked))
            assert self.last == ("assistant", reply), "the loss mask is not on the reply"
            self.loss_chars += len(reply)
            self.loss_sha.update(reply.encode("utf-8", "surrogatepass"))
            self.examples, self.masked = self.examples + 1, None

    def result(self) -> tuple:
        self.end()
        return self.turns, self.sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars, self.examples


def digest(examples: DataFrame) -> DataFrame:
    """What the stored examples hold, read back: a row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conv, read = _NO, None
            for conv_id, *row in _rows(batches):
                if conv_id != conv:
                    if read:
                        yield conv, *read.result()
                    conv, read = conv_id, _Read()
                read.add(*row)
            if read:
                yield conv, *read.result()

        yield from _batches(rows(), _DIGEST_TYPES)

    reduced = examples.select(*(f.name for f in _EXAMPLE_TYPES)).mapInArrow(lambda batches: _batches(_new(batches), _NEW_TYPES), _NEW)
    return reduced.repartition("conv_id").sortWithinPartitions("conv_id", "example", "chars_before").mapInArrow(run, DIGEST)


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """The query: all conversations and conversation -7, written as examples and read back."""
    text = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    conversations = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(added)
    return digest(common.materialize(format_examples(conversations), "chat"))
