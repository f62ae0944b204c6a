"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``width`` consecutive words of the benchmark items (an item of fewer
words is one shorter window). For each pattern length a shift table over blocks of two words tells
how far the scan may jump, a bucket table over a window's first word and last block selects
candidates, and a direct comparison of words confirms them. Tables are sorted arrays over the
benchmark's words, each kept once. The scan runs inside the tasks that read the documents, so
nothing is shuffled; the benchmark is broadcast in blocks of a bounded size, one after another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import append_columns, checkpoint, shielded

#: Maps each byte that is not part of a word to a space, and A-Z to a-z; bytes from 0x80 are word characters.
_WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))

#: Most characters of benchmark text in one broadcast block.
BLOCK_CHARS = 32_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of a-z, 0-9 and non-ASCII characters, after lower-casing A-Z."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two."""
    return ((a * np.uint64(_MULTIPLIER)) ^ b) * np.uint64(_MULTIPLIER)


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length, one after another."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Benchmark:
    """Words of items, each word once, with their items and places."""

    def __init__(self, items: list[tuple]):
        known: dict[bytes, int] = {}
        places, self.items, self.bounds = [], [], [0]
        for item_id, text in items:
            found = words_of(text)
            if found:
                places.append(np.array([known.setdefault(w, len(known)) for w in found], dtype=np.int32))
                self.items.append(item_id)
                self.bounds.append(self.bounds[-1] + len(found))
        self.vocabulary = list(known)
        self.words = np.concatenate(places) if places else np.zeros(0, dtype=np.int32)
        self.bounds = np.array(self.bounds, dtype=np.int64)
        #: Hashes hold within one process only, in which tables are both made and used.
        self.hashes = np.array([hash(w) & _MASK for w in self.vocabulary], dtype=np.uint64)


class WuManber:
    """Search tables for all windows of one length of the given items of a benchmark."""

    def __init__(self, benchmark: Benchmark, length: int, items: np.ndarray):
        self.benchmark, self.length = benchmark, length
        self.block = min(2, length)
        self.free = length - self.block + 1
        first, size = benchmark.bounds[items], np.diff(benchmark.bounds)[items]
        own = benchmark.hashes[benchmark.words]
        block = own * np.uint64(_MULTIPLIER) if self.block == 1 else _pair(own[:-1], own[1:])
        # a block's shift: how far the end of the first window that has it lies ahead
        place = _ranges(size - self.block + 1)
        at = np.repeat(first, size - self.block + 1) + place
        order = np.lexsort((shift := np.maximum(self.free - 1 - place, 0), keys := block[at]))
        new = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        self.keys, self.shifts = keys[order[new]], shift[order[new]].astype(np.int16)
        starts = np.repeat(first, size - length + 1) + _ranges(size - length + 1)
        bucket = _pair(own[starts], block[starts + self.free - 1])
        order = np.argsort(bucket, kind="stable")
        self.buckets, self.starts = bucket[order], starts[order]

    def _blocks(self, words: list[bytes], at: list[int]) -> np.ndarray:
        """Hashes of the blocks that begin at some words."""
        one = np.array([hash(words[p]) & _MASK for p in at], dtype=np.uint64)
        return one * np.uint64(_MULTIPLIER) if self.block == 1 else _pair(one, np.array([hash(words[p + 1]) & _MASK for p in at], dtype=np.uint64))

    def _shifts(self, blocks: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
        return np.where(self.keys[at] == blocks, self.shifts[at], self.free)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Start in ``words`` and place in the benchmark of every occurrence of every window.

        An occurrence covers ``free`` blocks, so one of those that stand ``free`` apart; where that
        one is unknown the scan jumps over all of them. Otherwise it looks at the blocks from the
        one that the shift allows on; those of shift zero can end an occurrence.
        """
        free, last = self.free, len(words) - self.block
        probes = range(free - 1, last + 1, free)
        if not len(self.keys) or not len(probes):
            return
        shift = self._shifts(self._blocks(words, probes))
        ends = [e for k in np.flatnonzero(shift < free).tolist() for e in range(probes[k] + int(shift[k]), min(probes[k] + free, last + 1))]
        if not ends:
            return
        blocks = self._blocks(words, ends)
        at = np.flatnonzero(self._shifts(blocks) == 0)
        starts = [ends[k] - free + 1 for k in at.tolist()]
        wanted = _pair(np.array([hash(words[p]) & _MASK for p in starts], dtype=np.uint64), blocks[at])
        low, high = np.searchsorted(self.buckets, wanted), np.searchsorted(self.buckets, wanted, side="right")
        own, vocabulary = self.benchmark.words, self.benchmark.vocabulary
        for k in np.flatnonzero(high > low).tolist():
            start = starts[k]
            for place in self.starts[low[k] : high[k]].tolist():
                if all(vocabulary[own[place + i]] == words[start + i] for i in range(self.length)):
                    yield start, place


def windows(items: list[tuple], width: int) -> list[WuManber]:
    """Search tables, one for each length of window that the items have."""
    benchmark = Benchmark(items)
    length = np.minimum(np.diff(benchmark.bounds), width)
    return [WuManber(benchmark, n, np.flatnonzero(length == n)) for n in np.unique(length).tolist()]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Occurrences of benchmark windows in whole documents.

    Adds to every row of ``docs`` (which has ``text``): ``n_words long``, ``hits array<int>`` (the
    positions of the words inside any occurrence, in order) and ``items array<string>`` (the items
    that occur, sorted as strings). Null and empty texts have no words; items without words or with
    a null id own no window; repeated items count once; an empty benchmark hits nothing. The
    benchmark goes to the tasks in blocks of about ``block_chars`` characters, its size being
    measured first. The blocks are searched one after another, with a checkpoint between, so that
    the tables of one block are alive at a time; neither a larger benchmark nor a hot passage makes
    a shuffle.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>")})
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        out = _search(out, [tuple(r) for r in part.dropDuplicates().collect()], width)
        out = checkpoint(out) if k < blocks - 1 else out
    return out


#: Tables of the last block that this process searched; further tasks of the stage find them made.
_MADE: dict[str, list[WuManber]] = {}


def _tables(name: str, shared, width: int) -> list[WuManber]:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = windows(shared.value, width)
    return _MADE[name]


def _search(docs: DataFrame, items: list[tuple], width: int) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def make():
        tables = _tables(name, shared, width)

        def scan(text, hits, owners):
            words = words_of(text)
            hit, of = set(hits or ()), set(owners or ())
            for table in tables:
                places = []
                for start, place in table.search(words):
                    hit.update(range(start, start + table.length))
                    places.append(place)
                of.update(table.benchmark.items[k] for k in np.unique(np.searchsorted(table.benchmark.bounds, places, side="right") - 1).tolist())
            return len(words), sorted(hit), sorted(of)

        return scan

    named = docs.withColumnsRenamed({"hits": "__hits", "items": "__items"})
    fields = [("n_words", "long", pa.int64()), ("hits", "array<int>", pa.list_(pa.int32())), ("items", "array<string>", pa.list_(pa.string()))]
    return append_columns(named, ["text", "__hits", "__items"], fields, make).drop("__hits", "__items")


def is_contaminated(per: int) -> Column:
    """At least one word, and one in ``per``, lies in a benchmark window."""
    n_hit = F.size("hits")
    return (n_hit > 0) & (n_hit.cast("long") * per >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, per: int = 20) -> DataFrame:
    """Verdict per row of ``docs(doc_id, text)``, in the form of the contract."""
    return benchmark_hits(docs.select("doc_id", "text"), benchmark, width).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), is_contaminated(per).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, per: int = 20) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with their columns (a null text is clean)."""
    free, own = shielded(docs, ["n_words", "hits", "items"])
    return benchmark_hits(free, benchmark, width).where(~is_contaminated(per)).select(*own)
