"""URL filtering with a cascade of Bloom filters.

Level 0 encodes the listed keys; each further level encodes the false positives that the level
before has among the rest, over the complete universe of keys in the corpus, until none is left.
Membership of any key of that universe is then exact: it is listed if the first level that does not
have it is odd. The cascade is a few bitmaps, sent to the tasks, so no URL takes part in a join. Keys
whose bitmap would be too large are dealt into parts by their hash, with a cascade for each part and
a pass over the URLs for each; a pass has one part's bitmaps in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import checkpoint

#: Bytes of one bitmap that goes to the tasks, above which keys are dealt into more parts.
MAX_BYTES = 256 << 20
#: Rate of false positives of all filters but the first.
LATER = 0.25


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    from tessella.llm.common import ascii_lower

    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_hashes(key: Column) -> Column:
    """Two 64-bit hashes of a key, which stand for it."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


@dataclass
class Cascade:
    """Bitmaps by level, with the number of bits and of hash functions of each."""

    levels: list[tuple[np.ndarray, int, int]] = field(default_factory=list)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed."""
        answer = np.zeros(len(h1), dtype=bool)
        left = np.arange(len(h1))
        for level, (bits, m, k) in enumerate(self.levels):
            inside = probe(bits, m, k, level, h1[left], h2[left])
            answer[left[~inside]] = level % 2 == 1
            left = left[inside]
            if not len(left):
                return answer
        answer[left] = len(self.levels) % 2 == 1
        return answer


def places(m: int, k: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Bit numbers of keys at a level, one column for each hash function."""
    with np.errstate(over="ignore"):
        a = h1.astype(np.uint64) * np.uint64(2 * level + 0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(31)
        b = (h2.astype(np.uint64) + np.uint64(level)) * np.uint64(0xC2B2AE3D27D4EB4F)
        b = (b ^ (b >> np.uint64(29))) | np.uint64(1)
        return (a[:, None] + np.arange(k, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(m)


def probe(bits: np.ndarray, m: int, k: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = places(m, k, level, h1, h2)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=1)


def _bitmap(keys: DataFrame, m: int, k: int, level: int) -> np.ndarray:
    """Bitmap of ``keys(h1, h2)``: tasks give 64-bit words, merged by aggregation; it has ``m`` bits whatever the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(m, k, level, batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            word, starts = np.unique((at >> np.uint64(6)).astype(np.int64), return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(-(-m // 64), dtype=np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint64)
    return out


def first_rate(listed: int, rest: int) -> float:
    """Rate of false positives of the first filter: the share of listed keys, so that these are about as many."""
    return min(0.5, max(listed, 1) / max(rest, 1))


def bits_per_key(rate: float) -> float:
    return max(1.0, -math.log2(rate) * 1.4427)


def parts_of(universe: DataFrame, max_bytes: int = MAX_BYTES) -> int:
    """Number of parts of ``universe``, such that each bitmap of a part's cascade has about ``max_bytes`` at most.

    The first bitmap or the second is the largest: the keys that the second holds are no more than the listed ones.
    """
    row = universe.agg(F.count_if("listed").alias("n"), F.count("*").alias("all")).first()
    rate = first_rate(row.n, row["all"] - row.n)
    return max(1, math.ceil(row.n * max(bits_per_key(rate), bits_per_key(LATER)) / (8 * max_bytes)))


def part_of(h1: np.ndarray, parts: int) -> np.ndarray:
    """Part of keys by the leading 24 bits of their first hash."""
    return (h1.astype(np.uint64) >> np.uint64(40)) % np.uint64(parts)


def build_cascade(universe: DataFrame, most: int = 40) -> Cascade:
    """Cascade for ``universe(h1, h2, listed boolean)``, every key of the corpus once.

    The first filter's rate is the share of listed keys, so its false positives are about as many as
    these; further ones keep a quarter. A level that stands still is built anew with other hashes;
    after ``most`` levels an error is raised.
    """
    inside = universe.where("listed").select("h1", "h2")
    outside = universe.where("not listed").select("h1", "h2")
    n, rest = inside.count(), outside.count()
    cascade = Cascade()
    rate = first_rate(n, rest)
    while n:
        if len(cascade.levels) >= most:
            raise ValueError("the cascade does not end")
        m, k = max(64, int(n * bits_per_key(rate)) + 1), max(1, round(-math.log2(rate)))
        level = len(cascade.levels)
        bits = _bitmap(inside, m, k, level)
        cascade.levels.append((bits, m, k))
        found = checkpoint(outside.mapInArrow(_keep(bits, m, k, level), "h1 long, h2 long"))
        outside, inside, n, rate = inside, found, found.count(), LATER
    return cascade


def _keep(bits: np.ndarray, m: int, k: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probe(bits, m, k, level, batch.column(0).to_numpy(), batch.column(1).to_numpy())))

    return run


def candidates(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Possible rules for a URL, longest first: suffixes of the host of at most ``labels`` labels, with path prefixes of ``lengths``."""
    parts = F.split(host, "\\.", -1)
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(n - labels, F.lit(0)) + 1, n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.array_sort(F.array_distinct(pairs), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def marked(urls: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, Cascade, int]:
    """``urls(host, ...)`` with ``listed boolean`` for hosts of all parts but the last, the last part's cascade and the number of parts.

    With one part nothing is read: the column is false, and the cascade is that of all hosts.
    """
    parts = parts_of(universe, max_bytes)
    urls = urls.withColumn("listed", F.lit(False))
    if parts == 1:
        return urls, build_cascade(universe), 1
    of = (F.shiftrightunsigned("h1", 40) % parts).alias("part")
    for part in range(parts - 1):
        shared = urls.sparkSession.sparkContext.broadcast(build_cascade(universe.where(of == part)))
        hashed = urls.withColumn("own", key_hashes(F.col("host")))
        urls = checkpoint(hashed.mapInArrow(_mark(shared, part, parts), urls.schema))
        shared.unpersist()
    return urls, build_cascade(universe.where(of == parts - 1)), parts


def _mark(shared, part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own")
            listed = listed_too(batch.column("listed"), own, shared.value, part, parts)
            kept = batch.drop_columns(["own"])
            yield kept.set_column(kept.schema.get_field_index("listed"), "listed", pa.array(listed))

    return run


def listed_too(before: pa.Array, own: pa.StructArray, cascade: Cascade, part: int, parts: int) -> np.ndarray:
    """What was listed before, or is among the keys of this part."""
    h1, h2 = own.field(0).to_numpy(), own.field(1).to_numpy()
    listed = before.to_numpy(zero_copy_only=False).copy()
    at = np.flatnonzero(part_of(h1, parts) == part)
    listed[at] = cascade.contains(h1[at], h2[at])
    return listed


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed_hosts: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Verdict on the URL of every row of ``pages(page_id, url)``.

    ``rules`` are ``(verdict, host, path prefix)``; the longest that fits a URL's host or a parent
    domain of it, and its path, decides; of two of one length, that of the smaller text (host and
    path together); of two equal ones, the last in the list. Where none fits, a URL is blocked if its
    whole host is in ``listed_hosts(host)``, else allowed. Returns ``page_id, host, path, rule,
    verdict``; a null URL, or one without ``://``, has an empty host and path, which can be listed like
    any other; null listed hosts count for nothing. Rules' keys are encoded by one cascade, listed
    hosts by one for each part (:func:`parts_of`), over all candidate keys and hosts of ``pages``.
    """
    verdicts = {host + path: verdict for verdict, host, path in rules}
    labels = max((host.count(".") + 1 for _, host, _ in rules), default=1)
    lengths = sorted({len(path) for _, _, path in rules}) or [0]
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = candidates(F.col("host"), F.col("path"), labels, lengths)
    spark = pages.sparkSession
    ruled = spark.createDataFrame([(key,) for key in verdicts], "key string")
    by_rule = build_cascade(_universe(urls.select(F.explode(keys).alias("key")), ruled))
    urls, by_host, parts = marked(urls, _universe(urls.select(F.col("host").alias("key")), listed_hosts.select(F.col("host").alias("key"))), max_bytes)
    shared = spark.sparkContext.broadcast((by_rule, by_host, verdicts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_cascade, host_cascade, verdict_of = shared.value
        for batch in batches:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            flat = hashes.flatten()
            offsets = hashes.offsets.to_numpy() - hashes.offsets[0].as_py()
            fits = rule_cascade.contains(flat.field(0).to_numpy(), flat.field(1).to_numpy())
            listed = listed_too(batch.column("listed"), batch.column("own"), host_cascade, parts - 1, parts)
            names = keys.flatten()
            at = np.flatnonzero(fits)
            place = np.searchsorted(at, offsets[:-1])
            first = np.where(place < len(at), at[np.minimum(place, max(len(at) - 1, 0))] if len(at) else -1, -1)
            rule = [names[int(f)].as_py() if 0 <= f < end else None for f, end in zip(first, offsets[1:], strict=True)]
            verdict = [verdict_of[r] if r is not None else "block" if x else "allow" for r, x in zip(rule, listed, strict=True)]
            kept = [batch.column(c) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    hashed = urls.withColumn("keys", keys).select("page_id", "host", "path", "listed", "keys", F.transform("keys", key_hashes).alias("hashes"), key_hashes(F.col("host")).alias("own"))
    schema = T.StructType([pages.schema["page_id"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    return hashed.mapInArrow(run, schema)


def _universe(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Every distinct key as ``h1, h2, listed``; keys listed but not in the corpus are left out."""
    marked = keys.select("key", F.lit(False).alias("listed"), F.lit(True).alias("asked")).unionByName(listed.where("key is not null").select("key", F.lit(True).alias("listed"), F.lit(False).alias("asked")))
    hashed = marked.select(key_hashes(F.col("key")).alias("h"), "listed", "asked").groupBy("h").agg(F.max("listed").alias("listed"), F.max("asked").alias("asked"))
    return checkpoint(hashed.where("asked").select("h.h1", "h.h2", "listed"))
