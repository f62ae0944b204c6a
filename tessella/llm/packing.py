"""Cost-balanced packing of token sequences.

A task tokenizes the documents it reads and packs them in rounds of a bounded number of tokens, so
the job needs neither a shuffle nor a global order. In a round, whole sequences are first cut from
long documents; what remains goes, longest piece first, to the open sequence of the lowest
estimated cost (linear plus quadratic in each piece's length, as attention within a document costs)
that has room for it. Capacities of a round add up to exactly its tokens: sequences of ``capacity``
and, for the rest, sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import rows_as_batches

SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"

#: Fixed value: the control string of the vocabulary and its id.
CONTROL = {"<|endoftext|>": 50256}

#: Stands where no sequence is open; dearer than any.
NONE = (float("inf"), -1)

#: Sequence ids of a task begin at its partition number times this.
IDS_PER_TASK = 1 << 36


def vocabulary_encoder(ranks_file: str | None = None, vocabulary: str | None = None):
    """Encoder of the public 50k byte-level BPE; its control string in a text gets its own id.

    The ranks file holds the vocabulary of ``byte_bpe_50k.json``; its ids are the same, several
    times faster (the tests compare the two). Its splitter gives up on runs of about a million
    white-space characters; such a text goes to the JSON vocabulary's own encoder.
    """
    import tiktoken

    with open(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("public_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=CONTROL)

    @functools.cache
    def slower():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except ValueError:
            return slower().encode(text, add_special_tokens=False).ids

    return encode


def attention_cost(length: int, linear: float, quadratic: float) -> float:
    """Estimated cost of one piece in a sequence."""
    return linear * length + quadratic * length * length


class Cheapest:
    """Open sequences by the room they have left: a heap for each room, and a tree of the least over ranges of rooms."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.least: list[tuple[float, int]] = [NONE] * (2 * self.width)

    def add(self, room: int, cost: float, k: int) -> None:
        heapq.heappush(self.heaps[room], (cost, k))
        self._renew(room)

    def take(self, length: int) -> tuple[float, int] | None:
        """Remove and return ``(cost, k)`` of the cheapest sequence with room for ``length``, the lowest k of equals."""
        low, high, node = length + self.width, 2 * self.width, 0
        while low < high:  # the right border is that of the tree, so only left borders are looked at
            if low & 1:
                node = low if self.least[low] < self.least[node] else node
                low += 1
            low, high = low >> 1, high >> 1
        if self.least[node] == NONE:
            return None
        while node < self.width:
            node = 2 * node if self.least[2 * node] == self.least[node] else 2 * node + 1
        found = heapq.heappop(self.heaps[node - self.width])
        self._renew(node - self.width)
        return found

    def _renew(self, room: int) -> None:
        node = room + self.width
        self.least[node] = self.heaps[room][0] if self.heaps[room] else NONE
        while node > 1:
            node >>= 1
            self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])


def pack_round(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 512) -> list[tuple[int, int, int, int, int]]:
    """Place documents of the given token counts; returns ``(document, start, length, sequence, offset)``.

    Every token is placed once and every sequence is full: of ``capacity`` tokens, or a power of two.
    Documents of more than ``capacity`` tokens fill sequences of their own first. A piece for which
    no open sequence has room is cut to fill the cheapest one. Ties go to the earlier document and
    the lower sequence number.
    """
    pieces, placed, sequences = [], [], 0
    for document, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            placed.append((document, k * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            pieces.append((n % capacity, document, whole * capacity))
    rest = sum(p[0] for p in pieces)
    sizes = [capacity] * (rest // capacity)
    rest %= capacity
    sizes += [1 << bit for bit in range(capacity.bit_length(), -1, -1) if rest >> bit & 1]
    pieces.sort(key=lambda p: (-p[0], p[1]))
    used = [0] * len(sizes)
    cost = [0.0] * len(sizes)
    cheapest = Cheapest(capacity)
    for k, size in enumerate(sizes):
        cheapest.add(size, 0.0, k)
    for length, document, start in pieces:
        while length:
            found = cheapest.take(length) or cheapest.take(1)  # none has room: fill the cheapest, and go on with the rest
            k = found[1]
            taken = min(length, sizes[k] - used[k])
            placed.append((document, start, taken, sequences + k, used[k]))
            used[k] += taken
            cost[k] += attention_cost(taken, linear, quadratic)
            if used[k] < sizes[k]:
                cheapest.add(sizes[k] - used[k], cost[k], k)
            length -= taken
            start += taken
    return placed


def pack(docs: DataFrame, capacity: int = 1024, round_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 512, ranks_file: str | None = None) -> DataFrame:
    """Pack whole documents ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, start (the document's ids before it), length, ids_crc32 (unsigned,
    of the ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    sequence_length``. A document is its ids followed by id 0, so null and empty texts are one
    token. A task holds ``round_tokens`` tokens at most, besides one document. Sequence ids follow
    from the partition number and do not change when a lost task runs again over the same rows.
    Repeated rows are packed as often as they occur.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), *[(n, pa.int64()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary_encoder(ranks_file)
        first = itertools.count(TaskContext.get().partitionId() * IDS_PER_TASK)

        def rounds() -> Iterator[list]:
            held, tokens = [], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = np.array([*encode(batch.column(1)[i].as_py() or ""), 0], dtype="<u4")
                    held.append((batch.column(0)[i].as_py(), ids))
                    tokens += len(ids)
                    if tokens >= round_tokens:
                        yield held
                        held, tokens = [], 0
            if held:
                yield held

        def rows() -> Iterator[tuple]:
            for held in rounds():
                placed = pack_round([len(ids) for _, ids in held], capacity, linear, quadratic)
                full: dict[int, int] = {}
                for _, _, length, k, _ in placed:
                    full[k] = full.get(k, 0) + length
                number = {k: next(first) for k in sorted(full)}
                for document, start, length, k, offset in placed:
                    doc_id, ids = held[document]
                    yield doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), number[k], offset, full[k]

        yield from rows_as_batches(arrow, rows())

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA.format(id=kind.simpleString()))
