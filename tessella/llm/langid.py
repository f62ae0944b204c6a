"""Language identification by interpolated Kneser-Ney character models.

Training counts the words of every labelled text by language in one aggregation, and the character
n-grams of the distinct words in another; Kneser-Ney probabilities follow from these by joins and
aggregations, under 63-bit hashes of the n-grams. A model keeps, for each order, a sorted array of
hashes and a matrix with a column for each language. Languages go to the tasks by groups of bounded
size, a language larger than that by parts, whose log probabilities add up. A text's words are
scored each as ``^word$``; its language is the one of lowest cross-entropy per character.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import append_columns, checkpoint
from tessella.operators.graph import shared_folder

#: Runs of letters with their marks.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ORDER = 4
#: Distinct (language, word) pairs that a task holds before it passes its counts on.
HELD_WORDS = 200_000
#: Bytes of text whose tokens a task holds at most, in counting as in scoring.
HELD_BYTES = 32 << 20
#: Characters that are scored or counted as arrays at a time; a longer word is cut, with its context.
SCORED_CHARS = 1 << 18
#: Languages that a model may have, more than have a code; tables by language are broadcast.
MAX_LANGUAGES = 8192
#: Languages of one group.
GROUP_LANGUAGES = 512
#: Bytes of the arrays that one group of languages sends to the tasks; further languages make further groups.
MODEL_BYTES = 128 << 20
#: Bytes of the scores of known tokens that a task holds.
SCORES_BYTES = 64 << 20
#: N-grams of a language in parts are dealt from this size on, by the characters before the last in an n-gram of this size.
DEALT = 3
#: Standard deviations above the mean misfit of a language's own texts, beyond which a text is rejected.
REJECT = 4.0
#: Text lengths, in characters, at which the evidence of a text may come to its half; calibration picks one.
HALVES = tuple(6.25 * 2**k for k in range(10))
#: Probability of any character whatever.
UNIFORM = 1.0 / (1 << 16)

#: Marks of a word's begin and end, which are no letters.
BEGIN, END = "\x01", "\x02"

#: Maps A-Z to a-z and every other ASCII byte that is no letter to a space.
_ASCII = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    """A text cut at all ASCII characters but letters; :func:`words_in` gives a token's words."""
    return (text or "").encode("utf-8", "replace").translate(_ASCII).split()


def words_in(token: bytes) -> list[str]:
    """Runs of letters in a token, in lower case (one, but for tokens with other non-ASCII characters)."""
    return WORD.findall(token.decode("utf-8").lower())


@dataclass
class Grams:
    """For each predicted character its word, the hash of the n-gram that ends there and that of the n - 1 characters before it, by order."""

    word: np.ndarray
    full: list[np.ndarray]
    context: list[np.ndarray]

    def where(self, some: np.ndarray) -> Grams:
        """Those of some of the characters."""
        return Grams(self.word[some], [x[some] for x in self.full], [x[some] for x in self.context])


def grams_of(words: list[str], order: int = ORDER) -> Iterator[Grams]:
    """Hash the n-grams of ``^word$``; at a word's start the missing characters are all ``^``. About ``SCORED_CHARS`` characters at a time."""
    owner, pieces, held = [], [], 0
    for k, word in enumerate(words):
        marked = BEGIN * (order - 1) + word + END
        for at in range(0, len(word) + 1, SCORED_CHARS):
            owner.append(k)
            pieces.append(marked[at : at + SCORED_CHARS + order - 1])
            held += len(pieces[-1])
            if held >= SCORED_CHARS:
                yield _hashed(owner, pieces, order)
                owner, pieces, held = [], [], 0
    if pieces:
        yield _hashed(owner, pieces, order)


def _hashed(owner: list[int], pieces: list[str], order: int) -> Grams:
    """N-grams of the characters of pieces, whose first ``order - 1`` are context only."""
    line = np.frombuffer("".join(pieces).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) - (order - 1)
    start = np.cumsum(length + order - 1) - length
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    full = [hash_of([line[at - k] for k in range(n - 1, -1, -1)]) for n in range(1, order + 1)]
    first = np.cumsum(length) - length
    context = [np.zeros(len(at), dtype=np.int64)]
    for n in range(2, order + 1):
        before = np.empty(len(at), dtype=np.int64)
        before[1:] = full[n - 2][:-1]
        before[first] = hash_of([line[start - k] for k in range(n - 1, 0, -1)])
        context.append(before)
    return Grams(np.repeat(np.array(owner, dtype=np.int64), length), full, context)


def hash_of(columns: list[np.ndarray]) -> np.ndarray:
    """Multiplicative hash of code point sequences, 63 bits wide."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]), len(columns), dtype=np.uint64)
        for c in columns:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over all rows of ``docs(lang, text)`` with a language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        read = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, tokens in held.items():
                counts: Counter = Counter()
                for token, n in tokens.items():
                    for word in words_in(token):
                        counts[word] += n
                words = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words), pa.array(counts.values(), pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                held.setdefault(batch.column(0)[i].as_py(), Counter()).update(tokens_of(text))
                read += len(text)
                if read > HELD_BYTES // 4 or sum(map(len, held.values())) > HELD_WORDS:
                    yield from flush()
                    read = 0
        yield from flush()

    counted = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, size, gram, context, suffix, n``: n-grams of every size up to ``order`` over counted words."""
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("context", pa.int64()), ("suffix", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                part = batch.take(pa.array(np.flatnonzero(langs == lang)))
                n = part.column(2).to_numpy()
                for grams in grams_of(part.column(1).to_pylist(), order):
                    for size in range(1, order + 1):
                        keys, first, inverse = np.unique(grams.full[size - 1], return_index=True, return_inverse=True)
                        total = np.bincount(inverse, weights=n[grams.word]).astype(np.int64)
                        suffix = grams.full[size - 2][first] if size > 1 else np.zeros(len(keys), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), size, dtype=np.int32)), pa.array(keys), pa.array(grams.context[size - 1][first]), pa.array(suffix), pa.array(total)], schema=schema)

    found = words.mapInArrow(run, "lang string, size int, gram long, context long, suffix long, n long")
    return found.groupBy("lang", "size", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, size, gram, context, suffix, n, p, back``: interpolated Kneser-Ney probabilities of counted n-grams.

    ``n`` is the count at the highest order, and below it in how many n-grams one longer an n-gram
    is the suffix. One discount for each order and language is n1 / (n1 + 2 n2), kept within 0.1 and
    0.95. ``back`` is the weight that an n-gram's context leaves to the order below.
    """
    kinds = grams.where("size > 1").groupBy("lang", (F.col("size") - 1).alias("size"), F.col("suffix").alias("gram")).agg(F.count("*").alias("kinds"))
    counted = grams.join(kinds, ["lang", "size", "gram"], "left").withColumn("n", F.when(F.col("size") < order, F.coalesce("kinds", F.lit(1))).otherwise(F.col("n"))).drop("kinds")
    counted = checkpoint(counted)
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    rates = counted.groupBy("lang", "size").agg(F.least(F.lit(0.95), F.greatest(F.lit(0.1), once / F.greatest(once + 2 * twice, F.lit(1)))).alias("discount"))
    contexts = counted.groupBy("lang", "size", "context").agg(F.sum("n").alias("total"), F.count("*").alias("followers")).join(F.broadcast(rates), ["lang", "size"])  # at most order * MAX_LANGUAGES rows
    full = counted.join(contexts, ["lang", "size", "context"])
    own = full.select("lang", "size", "gram", "context", "suffix", "n", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("own"), (F.col("discount") * F.col("followers") / F.col("total")).alias("back"))
    own = checkpoint(own)
    done = checkpoint(own.where("size = 1").withColumn("p", F.col("own") + F.col("back") * UNIFORM).drop("own"))
    every = done
    for size in range(2, order + 1):
        lower = done.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        done = checkpoint(own.where(F.col("size") == size).join(lower, ["lang", "suffix"]).withColumn("p", F.col("own") + F.col("back") * F.col("lower")).drop("own", "lower"))
        every = every.unionByName(done)
    return every


class Model:
    """Sorted hash arrays with log probabilities of a group of languages, for every order.

    A part of a language knows only the characters that follow the contexts dealt to it, and scores only these.
    """

    def __init__(self, languages: list[str], rows: dict[str, np.ndarray] | None = None, order: int = ORDER, part: int = 0, parts: int = 1):
        """``rows`` has ``lang`` (place in ``languages``), ``size``, ``gram``, ``context``, ``suffix``, ``p`` and ``back`` of every n-gram.

        A language that lacks an n-gram which another has gets what it backs off to there.
        """
        self.languages, self.order, self.part, self.parts = languages, order, part, parts
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.context_keys: list[np.ndarray] = []
        self.context_logs: list[np.ndarray] = []
        rows = rows or {c: np.zeros(0, dtype=np.int64) for c in ("lang", "size", "gram", "context", "suffix", "p", "back")}
        for size in range(1, order + 1):
            here = rows["size"] == size
            lang = rows["lang"][here]
            contexts, at = np.unique(rows["context"][here], return_inverse=True)
            back = np.zeros((len(contexts), len(languages)), dtype=np.float32)  # no weight lost where a language has no such context
            back[at, lang] = np.log(rows["back"][here])
            if size == 1:
                self.floor = (back[0] if len(contexts) else np.zeros(len(languages), dtype=np.float32)) + np.float32(math.log(UNIFORM))
            keys, first, at = np.unique(rows["gram"][here], return_index=True, return_inverse=True)
            if size == 1:
                logs = np.tile(self.floor, (len(keys), 1))
            else:
                logs = self._lower(rows["suffix"][here][first], size - 1) + back[np.searchsorted(contexts, rows["context"][here][first])]
            logs[at, lang] = np.log(rows["p"][here])
            self.keys.append(keys)
            self.logs.append(logs)
            self.context_keys.append(contexts)
            self.context_logs.append(back)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log probability of each word in each language (in a part, of the characters that are its own), and characters of the word."""
        cost, length = np.zeros((len(words), len(self.languages))), np.zeros(len(words), dtype=np.int64)
        for grams in grams_of(words, self.order):
            length += np.bincount(grams.word, minlength=len(words))
            if self.parts > 1:
                grams = grams.where(grams.context[min(DEALT, self.order) - 1] % self.parts == self.part)
            starts = np.flatnonzero(np.diff(grams.word, prepend=-1))
            if len(starts):
                cost[grams.word[starts]] -= np.add.reduceat(self._logs(grams), starts, axis=0)
        return cost, length

    def _lower(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Log probabilities of n-grams of a size; of unknown ones those of a new character."""
        keys = self.keys[size - 1]
        if not len(keys):
            return np.tile(self.floor, (len(hashes), 1))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where((keys[at] == hashes)[:, None], self.logs[size - 1][at], self.floor)

    def _logs(self, grams: Grams) -> np.ndarray:
        """Log probability of each character: that of its longest known n-gram, less what the longer contexts leave."""
        logs = np.tile(self.floor, (len(grams.word), 1))
        for size in range(1, self.order + 1):
            keys, hashes = self.keys[size - 1], grams.full[size - 1]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            found = keys[at] == hashes
            logs[found] = self.logs[size - 1][at[found]]
            if size > 1:
                missing = np.flatnonzero(~found)
                held, asked = self.context_keys[size - 1], grams.context[size - 1][missing]
                at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
                known = held[at] == asked
                logs[missing[known]] += self.context_logs[size - 1][at[known]]
        return logs


@dataclass
class Group:
    """Languages whose arrays go to the tasks together, or a part of one language's."""

    languages: list[str]
    rows: DataFrame | None
    order: int = ORDER
    part: int = 0
    parts: int = 1

    def load(self) -> Model:
        """Bring the n-grams to the driver and sort them into arrays."""
        if self.rows is None:
            return Model(self.languages, None, self.order)
        place = F.array_position(F.array(*[F.lit(x) for x in self.languages]), F.col("lang")).cast("int") - 1
        found = self.rows.select(place.alias("lang"), "size", "gram", "context", "suffix", F.col("p").cast("float").alias("p"), F.col("back").cast("float").alias("back")).toArrow()
        return Model(self.languages, {c: found.column(c).to_numpy() for c in found.column_names}, self.order, self.part, self.parts)


@dataclass
class Identifier:
    """Models of all languages in groups, how a language's own words and texts fit, and how evidence saturates."""

    groups: list[Group]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    half: float = 50.0
    held: tuple[int, Model] | None = None

    @property
    def languages(self) -> list[str]:
        return list(dict.fromkeys(lang for g in self.groups for lang in g.languages))

    @property
    def places(self) -> list[list[int]]:
        """For each group the places of its languages among all."""
        at = {lang: k for k, lang in enumerate(self.languages)}
        return [[at[lang] for lang in g.languages] for g in self.groups]

    def model(self, k: int) -> Model:
        """The arrays of a group; the driver holds those of one group at a time."""
        if self.held is None or self.held[0] != k:
            self.held = None
            self.held = k, self.groups[k].load()
        return self.held[1]

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((len(words), len(self.languages)))
        for k, at in enumerate(self.places):
            cost, length = self.model(k).score(words)
            total[:, at] += cost
        return total, length

    def misfit(self, k: int, rate: float, words: float) -> float:
        """Standard errors by which a text's cross-entropy lies above that of the language's own words."""
        return float((rate - self.mean[k]) / (self.spread[k] / math.sqrt(words)))

    def posterior(self, rate: np.ndarray, characters: float, half: float | np.ndarray) -> np.ndarray:
        """Posterior of each language; words are not independent, so evidence saturates: ``half`` characters count half. A column of halves gives a row for each."""
        weight = np.exp(-(rate - rate.min()) * characters / (1 + characters / half))
        return weight / weight.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, order: int = ORDER, model_bytes: int = MODEL_BYTES) -> Identifier:
    """Fit the models on all rows of ``docs(lang, text)`` that have a language and a text.

    The counts are aggregated over the whole corpus, and the probabilities computed by Spark; the
    n-gram tables, measured first, come to the driver by groups of languages of at most
    ``model_bytes``, one group at a time. A language that is larger alone comes in parts: its
    n-grams of ``DEALT`` characters or more are dealt by the context of the last character, so all
    that the probability of a character needs is in one part, and the parts' costs add up to those
    of the whole. Parts are about ``model_bytes``: shorter n-grams are in each of them. The misfit and
    the evidence of all these texts are then measured in another pass.
    Null and empty texts, and rows without a language, count for nothing.
    """
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    model = _fitted(labelled, order, model_bytes)
    if model.languages:
        _calibrate(model, _measured(labelled.withColumnRenamed("lang", "__own"), model))
    return model


def learn_and_identify(docs: DataFrame, learned: Column, order: int = ORDER, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """What :func:`identify` adds to every row of ``docs(text, lang)`` after :func:`train` on the rows where ``learned`` holds; without the texts.

    Each text is scored once: what a text's verdict and the calibration need is kept in a
    checkpoint, some twenty numbers whatever the number of languages. Predictions use the text only.
    """
    model = _fitted(docs.where(learned).where("lang is not null and text is not null").select("lang", "text"), order, model_bytes)
    if not model.languages:
        return identify(docs, model).drop("text")
    own = F.when(learned & F.col("text").isNotNull(), F.col("lang"))
    measured = checkpoint(_measured(docs.withColumn("__own", own), model).drop("text"))
    _calibrate(model, measured)
    verdict, at = _verdict(model), HALVES.index(model.half)

    def finish(best: int | None, rate: float, words: float, posterior: list[float]) -> tuple:
        return verdict(best, rate, words, None if best is None else posterior[at])

    return append_columns(measured, ["__best", "__rate", "__words", "__posterior"], FIELDS, lambda: finish).drop("__own", *[name for name, _, _ in MEASURED])


def _fitted(labelled: DataFrame, order: int, model_bytes: int) -> Identifier:
    """Models of the languages, and how a language's own words fit; not calibrated."""
    words = checkpoint(word_counts(labelled))
    table = probabilities(checkpoint(gram_counts(words, order)), order)
    model = Identifier(_groups(table, model_bytes, order) or [Group([], None, order)])
    if model.languages:
        _fit_words(model, words)
    return model


def _groups(table: DataFrame, model_bytes: int, order: int) -> list[Group]:
    """Groups of languages whose dense arrays stay within ``model_bytes``, and the parts of languages that do not."""
    level = min(DEALT, order)
    sizes = {r.lang: (r.n, r.short) for r in table.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("size") < level).alias("short")).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{len(sizes)} languages; a model has at most {MAX_LANGUAGES}")
    most = model_bytes // 24
    room = lambda names: sum(sizes[x][0] for x in names) * (16 + 8 * len(names))
    together: list[list[str]] = []
    out = []
    for lang in sorted(sizes):
        n, short = sizes[lang]
        if n > most and level > 1:
            parts = math.ceil(2 * (n - short) / max(most - short, most // 2, 1))  # twice as many as if all were equal
            out.extend(_parts(table.where(F.col("lang") == lang), lang, parts, order))
            continue
        if not together or room([*together[-1], lang]) > model_bytes or len(together[-1]) == GROUP_LANGUAGES:
            together.append([])
        together[-1].append(lang)
    return [Group(names, table.where(F.col("lang").isin(names)), order) for names in together] + out


def _parts(rows: DataFrame, lang: str, parts: int, order: int) -> list[Group]:
    """Deal a language's n-grams; the parts are written in the shared folder, a folder for each."""
    level = min(DEALT, order)
    columns = ["lang", "size", "gram", "context", "suffix", "p", "back"]
    rows = rows.select(*columns)
    sized = rows.where(F.col("size") == level).withColumn("dealt", F.col("context"))
    every = sized
    for size in range(level + 1, order + 1):  # a longer n-gram goes where its suffix goes
        above = sized.select(F.col("gram").alias("suffix"), "dealt")
        sized = rows.where(F.col("size") == size).join(above, "suffix").select(*columns, "dealt")
        every = every.unionByName(sized)
    folder = f"{shared_folder(rows.sparkSession)}/language-parts-{uuid.uuid4().hex}"
    every.withColumn("part", F.pmod("dealt", F.lit(parts)).cast("int")).drop("dealt").repartition("part", F.pmod("gram", F.lit(8))).write.partitionBy("part").parquet(folder)
    written = rows.sparkSession.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, part int").parquet(folder)
    short = rows.where(F.col("size") < level)
    return [Group([lang], written.where(F.col("part") == k).drop("part").unionByName(short), order, k, parts) for k in range(parts)]


def _fit_words(model: Identifier, words: DataFrame) -> None:
    languages = model.languages
    sums = np.zeros((len(languages), 3))
    for k, group in enumerate(model.groups):
        shared = words.sparkSession.sparkContext.broadcast(model.model(k))
        if group.part == 0:
            own = words.where(F.col("lang").isin(group.languages)).select("lang", "word", "n", F.lit(0.0).alias("cost"))
        if group.part < group.parts - 1:
            own = checkpoint(own.mapInArrow(_own_cost(shared), "lang string, word string, n long, cost double"))
        else:
            for lang, *values in own.mapInArrow(_own_fit(shared), "lang string, n double, s double, q double").groupBy("lang").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect():
                sums[languages.index(lang)] = values
        shared.unpersist()
    n = np.maximum(sums[:, 0], 1)
    model.mean = sums[:, 1] / n
    model.spread = np.sqrt(np.maximum(sums[:, 2] / n - model.mean**2, 1e-6))


def _measured(docs: DataFrame, model: Identifier) -> DataFrame:
    """Add to ``docs(text, __own)`` the columns ``MEASURED``: the best language with its rate and posterior for each of ``HALVES``, and how the text fits its ``__own``."""
    places, place, halves = model.places, {lang: k for k, lang in enumerate(model.languages)}, np.array(HALVES)[:, None]
    judge = Identifier([], model.mean, model.spread)

    def finish(costs: list, own: str | None) -> tuple:
        rate, characters, words = _rates(costs, places)
        if rate is None:
            return (None,) * len(MEASURED)
        posterior, best, k = judge.posterior(rate, characters, halves), int(np.argmin(rate)), place.get(own)
        fit = (None, None) if k is None else (judge.misfit(k, rate[k], words), np.log(np.maximum(posterior[:, k], 1e-12)).tolist())
        return best, float(rate[best]), float(words), posterior[:, best].tolist(), *fit

    return _scored(docs, model, MEASURED, finish, ["__own"])


def _calibrate(model: Identifier, measured: DataFrame) -> None:
    """Set the limits of rejection and the saturation of evidence by all measured texts that have a language of their own."""
    place = {lang: k for k, lang in enumerate(model.languages)}
    likelihood = [F.sum(F.get("__likelihood", F.lit(i))).alias(f"l{i}") for i in range(len(HALVES))]
    found = measured.where("__misfit is not null").groupBy("__own").agg(F.count("*").alias("n"), F.avg("__misfit").alias("mean"), F.stddev_pop("__misfit").alias("sd"), *likelihood).collect()
    model.limit = np.full(len(place), REJECT)
    for r in found:
        if r.n > 1:
            model.limit[place[r["__own"]]] = max(r.mean + REJECT * max(r.sd, 1.0), 1.0)
    if found:
        total = [sum(r[f"l{i}"] for r in found) for i in range(len(HALVES))]
        model.half = HALVES[max(range(len(HALVES)), key=lambda i: (total[i], -i))]


def _own_cost(shared):
    """Add what one part of a language takes of each word to its ``cost``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, _ = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(batch.column(3).to_numpy() + cost[:, 0])], names=["lang", "word", "n", "cost"])

    return run


def _own_fit(shared):
    """Sums over words of their weight, and of the cross-entropy per character in their own language and its square; ``cost`` is what the parts before took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {lang: k for k, lang in enumerate(own.languages)}
        sums = np.zeros((len(own.languages), 3))
        for batch in batches:
            if batch.num_rows:
                cost, length = own.score(batch.column(1).to_pylist())
                k = np.array([place[x] for x in batch.column(0).to_pylist()])
                n = batch.column(2).to_numpy()
                rate = (batch.column(3).to_numpy() + cost[np.arange(len(k)), k]) / length
                for c, v in enumerate((n, n * rate, n * rate * rate)):
                    sums[:, c] += np.bincount(k, weights=v, minlength=len(own.languages))
        yield pa.RecordBatch.from_arrays([pa.array(own.languages, pa.string()), *[pa.array(sums[:, c]) for c in range(3)]], names=["lang", "n", "s", "q"])

    return run


def _rates(costs: list, places: list[list[int]]) -> tuple[np.ndarray | None, float, float]:
    """Cross-entropy of a text per character in each language, its characters and its words, from the sums of each group at its ``places``."""
    total = np.zeros(1 + max((k for at in places for k in at), default=-1))
    for cost, at in zip(costs, places, strict=True):
        total[at] += cost[:-2]
    characters, words = costs[0][-2], costs[0][-1]
    return (total / characters, characters, words) if words and len(total) else (None, 0.0, 0.0)


def _scored(docs: DataFrame, model: Identifier, fields: list, finish: Callable[..., tuple], inputs: list[str] = [], cache: int = 200_000) -> DataFrame:  # noqa: B006
    """Add what ``finish`` makes of a text's costs, one group of languages after another; between groups a checkpoint, so that one model is held at a time."""
    names = [f"__costs{k}" for k in range(len(model.groups) - 1)]
    for k in range(len(model.groups)):
        shared = docs.sparkSession.sparkContext.broadcast(model.model(k))

        def make(k=k, shared=shared):
            scores = _Scores(shared.value, cache)

            def one(text, *others):
                total = np.zeros(len(shared.value.languages) + 2)
                for some in scores.parts(tokens_of(text)):
                    total += scores.total(some)
                return finish([*others[:k], total], *others[k:]) if k == len(names) else (total.tolist(),)

            return one, lambda texts: scores.learn(some for text in texts for some in scores.parts(tokens_of(text)))

        if k < len(names):
            docs = checkpoint(append_columns(docs, ["text"], [(names[k], "array<double>", pa.list_(pa.float64()))], make))
    return append_columns(docs, ["text", *names, *inputs], fields, make).drop(*names)


def identify(docs: DataFrame, model: Identifier, cache: int = 200_000) -> DataFrame:
    """Add ``lang_pred, score, cross_entropy, rejected`` to every row of ``docs``, which has ``text``.

    ``score`` (0 to 1) is the posterior of the language. A text is ``rejected`` if its misfit (the
    standard errors by which its cross-entropy lies above that of the language's own words) exceeds
    the language's calibrated limit; its score is then lowered by their ratio. A text that is null
    or has no letter, or a model without languages, gives ``und`` with score 0 and is rejected. A
    task keeps at most ``cache`` scored tokens, of ``HELD_BYTES`` together. Repeated rows are judged
    alike; other columns pass through, but those named like the results are replaced.
    """
    places, half, verdict = model.places, model.half, _verdict(model)
    judge = Identifier([])

    def finish(costs: list) -> tuple:
        rate, characters, words = _rates(costs, places)
        if rate is None:
            return verdict(None, 0.0, 0.0, None)
        best = int(np.argmin(rate))
        return verdict(best, rate[best], words, float(judge.posterior(rate, characters, half)[best]))

    return _scored(docs, model, FIELDS, finish, cache=cache)


def _verdict(model: Identifier) -> Callable[..., tuple]:
    """A function that gives ``FIELDS`` for the best language of a text, its rate, the words and the posterior."""
    languages, judge = model.languages, Identifier([], model.mean, model.spread, model.limit, model.half)

    def verdict(best: int | None, rate: float, words: float, score: float | None) -> tuple:
        if best is None:
            return "und", 0.0, None, True
        misfit = judge.misfit(best, rate, words)
        rejected = misfit > judge.limit[best]
        return languages[best], score * float(judge.limit[best]) / misfit if rejected else score, float(rate), bool(rejected)

    return verdict


FIELDS = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("cross_entropy", "double", pa.float64()), ("rejected", "boolean", pa.bool_())]
MEASURED = [
    ("__best", "int", pa.int32()), ("__rate", "double", pa.float64()), ("__words", "double", pa.float64()), ("__posterior", "array<double>", pa.list_(pa.float64())),
    ("__misfit", "double", pa.float64()), ("__likelihood", "array<double>", pa.list_(pa.float64())),
]


class _Scores:
    """Costs in each language, characters and words of the tokens seen so far."""

    def __init__(self, model: Model, cache: int):
        self.model, self.cache = model, max(min(cache, SCORES_BYTES // (8 * (len(model.languages) + 2))), 1)
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.table = np.zeros((self.cache, len(model.languages) + 2))

    def parts(self, tokens: list[bytes]) -> Iterator[list[bytes]]:
        """Tokens in lists that fit in the table."""
        size = min(100_000, self.cache)
        return (tokens[at : at + size] for at in range(0, len(tokens), size))

    def total(self, tokens: list[bytes]) -> np.ndarray:
        """Summed values of one of :meth:`parts`."""
        try:
            at = list(map(self.known.__getitem__, tokens))
        except KeyError:
            self.learn([tokens])
            at = list(map(self.known.__getitem__, tokens))
        return self.table[at].sum(axis=0)

    def learn(self, parts) -> None:
        """Score the unknown tokens of some parts together, as arrays cost little for many words at once."""
        fresh: set[bytes] = set()
        for tokens in parts:
            seen = set(tokens)
            new = {t for t in seen if t not in self.known and t not in fresh}
            fresh |= new
            self.held += sum(map(len, new))
            if len(self.known) + len(fresh) > self.cache or self.held > HELD_BYTES:
                self.known.clear()
                fresh = seen
                self.held = sum(map(len, seen))
        if not fresh:
            return
        order = list(fresh)
        words = [words_in(token) for token in order]
        flat = [word for some in words for word in some]
        first = len(self.known)
        values = np.zeros((len(order), self.table.shape[1]))
        if flat and self.model.languages:
            cost, length = self.model.score(flat)
            owner = np.repeat(np.arange(len(order)), [len(some) for some in words])
            np.add.at(values, owner, np.column_stack([cost, length, np.ones(len(flat))]))
        self.table[first : first + len(order)] = values
        self.known.update(zip(order, range(first, first + len(order)), strict=True))
