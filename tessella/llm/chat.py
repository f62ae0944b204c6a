"""Chat formatting with offset-aligned loss masks.

A conversation's turns are rendered by a template whose control strings cannot occur in a rendered
text, the whole is encoded once with character offsets, and the assistant texts' spans are
intersected with the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessella.llm.common import checkpoint, rows_as_batches, shuffle_width

#: The template: what begins a turn, parts role and text, and ends a turn.
BEGIN, PART, END = "<turn>### ", ": ", "</turn>\n"
#: How characters of control strings are written inside roles and texts, where they then never stand.
_WRITTEN = {"\\": "\\\\", "<": "\\l", ":": "\\c", "#": "\\h"}
_READ = {written: character for character, written in _WRITTEN.items()}
_SPECIAL = re.compile(r"[\\<:#]")
_ESCAPED = re.compile(r"\\[\\lch]")
#: Characters of a piece above which the next turn begins another.
PART_CHARS = 4_000_000


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: _WRITTEN[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _READ[m[0]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted turns, and the span of each text in them."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = BEGIN + escape(role) + PART, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts that :func:`render` formatted."""
    turns, at = [], 0
    while at < len(formatted):
        end = formatted.index(END, at)  # a written text has no "<", a written role no ":"
        role, _, text = formatted[at + len(BEGIN) : end].partition(PART)
        turns.append((unescape(role), unescape(text)))
        at = end + len(END)
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that the sorted ``spans`` touch, with the part of each token that lies in a span.

    ``offsets`` has a sorted row (start, end) for each token; a token over two spans appears twice.
    Tokens that share a character (bytes of one code point) have it in the first of them only.
    """
    if not len(offsets) or not spans:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    start = np.maximum(offsets[:, 0], np.concatenate([[0], np.maximum.accumulate(offsets[:, 1])[:-1]]))
    end = np.maximum(offsets[:, 1], start)
    low, high = np.array(spans, dtype=np.int64).T
    first = np.searchsorted(end, low, side="right")
    last = np.searchsorted(start, high, side="left")
    n = np.maximum(last - first, 0)
    span = np.repeat(np.arange(len(spans)), n)
    token = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[span]
    a, b = np.maximum(start[token], low[span]), np.minimum(end[token], high[span])
    real = b > a
    return token[real], a[real], b[real]


def encoder(vocabulary: str | None = None):
    """Encoder to ids and character offsets; control strings of the vocabulary are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True

    def encode(text: str) -> tuple[list[int], np.ndarray]:
        found = tokenizer.encode(text, add_special_tokens=False)
        return found.ids, np.array(found.offsets, dtype=np.int64).reshape(-1, 2)

    return encode


SCHEMA = "conv_id {id}, part int, formatted string, ids array<int>, mask array<struct<token:int,start:int,end:int>>, summary struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string,formatted_chars:long>, place long"


class _Summary:
    """What is read back from the pieces of a conversation, in order."""

    def __init__(self):
        self.pieces = self.turns = self.loss = self.chars = 0
        self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[tuple[int, int]]) -> None:
        for role, text in parse(formatted):
            self.turns += 1
            self.turn_digest.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        learned = unescape("".join(formatted[a:b] for a, b in spans))
        self.loss += len(learned)
        self.loss_digest.update(learned.encode("utf-8", "replace"))
        self.chars += len(formatted)
        self.pieces += 1

    def row(self) -> dict:
        return {"n_turns": self.turns, "turns_sha256": self.turn_digest.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.loss_digest.hexdigest(), "formatted_chars": self.chars}


def format_conversations(conversations: DataFrame, learn_from: str = "assistant", vocabulary: str | None = None, part_chars: int = PART_CHARS, outputs: bool = True) -> DataFrame:
    """Format ``conversations(conv_id, turn, role, text)``, turns in order.

    One row for each piece of a conversation, counted by ``part``: ``formatted``, token ``ids``,
    ``mask`` (tokens with loss, and the characters of each that lie in a text of role
    ``learn_from``), and, in the last piece, a ``summary`` that is read back from these: turns and
    their digest, characters and digest of the text under the mask, formatted characters. Turns are
    dealt out by ranges of (conversation, turn), so a conversation of any size is rendered and
    encoded by many tasks; it has one piece, but for one that goes beyond a range or ``part_chars``
    characters. Pieces are cut between turns, where the vocabulary's splitter cuts in any case (a
    line feed, then no white space), so their ids in order are those of the whole. Only the digests
    of what crosses ranges go through one task, which streams.

    Null texts and roles are empty; equal turn numbers come by role and text; rows with a null
    conversation id are one conversation; repeated rows are turns of their own. An empty table gives
    none. ``outputs=False`` leaves out all but summaries.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = conversations.schema["conv_id"].dataType
    token = pa.struct([("token", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    summary = pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    arrow = pa.schema([("conv_id", to_arrow_type(kind)), ("part", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(token)), ("summary", summary), ("place", pa.int64())])

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for row in rows:
            held.append(row)
            chars += len(row[2] or "")
            if len(held) >= 256 or chars >= part_chars:
                yield from rows_as_batches(arrow, held)
                held, chars = [], 0
        yield from rows_as_batches(arrow, held)

    def closed(key, pieces: Iterator[tuple]) -> Iterator[tuple]:
        """Rows of a conversation from its pieces ``(formatted, ids, mask)``; one piece is held back to be the last."""
        sums, held = _Summary(), None
        for formatted, ids, masked in pieces:
            sums.add(formatted, [(m["start"], m["end"]) for m in masked])
            if held is not None and outputs:
                yield held
            held = (key, sums.pieces - 1, *((formatted, ids, masked) if outputs else (None, None, None)), None, None)
        yield (*held[:5], sums.row(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        place = itertools.count(TaskContext.get().partitionId() << 32)

        def made(turns: list[tuple[str, str]]) -> tuple:
            formatted, spans = render(turns)
            ids, offsets = encode(formatted)
            tokens, low, high = mask(offsets, [s for s, (role, _) in zip(spans, turns, strict=True) if role == learn_from])
            return formatted, ids if outputs else [], [{"token": t, "start": a, "end": b} for t, a, b in zip(tokens.tolist(), low.tolist(), high.tolist(), strict=True)]

        def pieces() -> Iterator[tuple]:
            key, turns, chars, begun = None, [], 0, False
            for batch in batches:
                for i in range(batch.num_rows):
                    conv, role, text = (batch.column(c)[i].as_py() for c in range(3))
                    if begun and (conv != key or chars > part_chars):
                        yield key, made(turns)
                        turns, chars = [], 0
                    key, begun = conv, True
                    turns.append((role or "", text or ""))
                    chars += len(text or "") + len(role or "")
            if begun:
                yield key, made(turns)

        def rows() -> Iterator[tuple]:
            """Closed rows of the conversations inside the range; the first, the last and those of many pieces are passed on."""
            held, first = None, True
            for key, group in itertools.groupby(pieces(), key=lambda x: x[0]):
                if held:
                    yield from closed(held[0], iter(held[1:]))
                    held = None
                own = (piece for _, piece in group)
                some = list(itertools.islice(own, 2))
                if first or len(some) > 1:
                    yield from ((key, None, *piece, None, next(place)) for piece in itertools.chain(some, own))
                    first = False
                else:
                    held = (key, some[0])
            if held:
                yield (held[0], None, *held[1], None, next(place))

        yield from batched(rows())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(batch.column(c)[i].as_py() for c in ("conv_id", "formatted", "ids", "mask"))

        yield from batched(r for key, group in itertools.groupby(pieces(), key=lambda x: x[0]) for r in closed(key, (x[1:] for x in group)))

    ddl = SCHEMA.format(id=kind.simpleString())
    keys = ["conv_id", "turn", "role", "text"]
    ordered = conversations.select(*keys).repartitionByRange(shuffle_width(conversations.sparkSession), "conv_id", "turn").sortWithinPartitions(*keys)
    found = checkpoint(ordered.select("conv_id", "role", "text").mapInArrow(run, ddl))
    crossing = found.where("place is not null").repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(merge, ddl)
    return found.where("place is null").unionByName(crossing).drop("place")
