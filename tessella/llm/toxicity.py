"""Toxicity by maximum-scoring segments of token log-odds.

Tokens get log-odds of the toxic against the other class under an informative Dirichlet prior: a
word's prior is that of its longest known prefix, a prefix's that of the shorter one, the shortest's
the class itself. A token's score is its log-odds less a drift, as segment scores must fall in plain
text. A linear-time scan over a text finds all maximal segments of positive score; the extreme-value
distribution of such segments under the other class's token scores tells which are significant. A
text's score calibrates the significance of its segments together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import append_columns, checkpoint, shielded
from tessella.llm.langid import tokens_of

#: Lengths of the prefixes that words share evidence by.
PREFIXES = (4, 5, 6)
#: Labelled rows to fit on, at most; those of the smallest hash of their id.
MAX_LABELLED = 40_000
#: Odds of a feature against those of the class, above which it is kept.
LEADING = 4.0
#: Probability that a feature is in toxic rows alone by chance, above which its occurrences are too few.
CHANCE = 0.02
#: What a token's score falls short of its log-odds by.
DRIFT = 1.0
#: What missing a toxic row costs in calibration, against flagging another one.
MISSED = 3.0
#: Characters of a run of letters above which it is walked in pieces; also bytes of a word up to which its score is remembered.
LONGEST = 64
#: Characters of the pieces of a long run, and of a run in a script that sets no spaces; pieces overlap.
PIECE, UNSPACED_PIECE = 6, 2
#: Distinct features that a task holds before it passes their counts on.
HELD = 300_000


_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\u30fc]"
#: A run in a script without spaces, or one of other letters.
RUN = regex.compile(rf"((?:{_UNSPACED}\p{{M}}*)+)|(?!{_UNSPACED})\p{{L}}(?:(?!{_UNSPACED})[\p{{L}}\p{{M}}])*")


def words_of(text: str | None) -> list[bytes]:
    """The runs of letters of a text in lower case; long runs and scripts without spaces as overlapping pieces, over their whole length."""
    out = []
    for token in tokens_of(text):
        if token.isascii():
            out.extend([token] if len(token) <= LONGEST else _pieces(token.decode(), PIECE))
            continue
        for run in RUN.finditer(token.decode("utf-8").lower()):
            word = run[0]
            if run[1]:
                out.extend(_pieces(word, UNSPACED_PIECE))
            else:
                out.extend([word.encode()] if len(word) <= LONGEST else _pieces(word, PIECE))
    return out


def _pieces(run: str, n: int) -> list[bytes]:
    return [run[i : i + n].encode() for i in range(max(len(run) - n + 1, 1))]


def features(token: bytes) -> list[bytes]:
    """From the shortest prefix to the whole word; characters, not bytes, are counted."""
    word = token.decode("utf-8")
    return [b"%d:" % n + word[:n].encode() for n in PREFIXES if len(word) > n] + [b"w:" + token]


@dataclass
class Model:
    """Counts of the features that lead to the toxic class, extreme-value parameters, and the calibration."""

    counts: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    base: float = 0.1
    weight: float = 2.0
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    shift: float = -3.0
    without: tuple[int, int] = (0, 0)
    memo: dict = field(default_factory=dict)

    def leaving(self, toxic: int) -> Model:
        """The model as it is for a row of its own sample when that row's counts are taken out."""
        return replace(self, without=(toxic, 1 - toxic), memo={})

    def token(self, token: bytes) -> float:
        """Log-odds of a token less the class's own; zero where no feature of it is known."""
        share, start = self.base, math.log(self.base / (1 - self.base))
        for name in features(token):
            found = self.counts.get(name)
            if found is None:
                if name[:2] == b"w:":
                    break
                continue
            toxic, other = max(found[0] - self.without[0], 0), max(found[1] - self.without[1], 0)
            share = (toxic + self.weight * share) / (toxic + other + self.weight)
        return math.log(share / (1 - share)) - start

    def scores(self, tokens: list[bytes]) -> list[float]:
        if len(self.memo) > 1_000_000:
            self.memo.clear()
        memo, out = self.memo, []
        for t in tokens:
            s = memo.get(t)
            if s is None:
                s = self.token(t) - DRIFT
                if len(t) <= LONGEST:
                    memo[t] = s
            out.append(s)
        return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a score sequence, in linear time.

    These are the disjoint segments that no extension or cut improves (Ruzzo and Tompa, 1999).
    """
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, before = i, total
        total += s
        end, after = i + 1, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= after:
                stack.append((start, end, before, after))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, y - x) for a, b, x, y in stack]


def evidence(model: Model, tokens: list[bytes], significant: float = 0.05) -> tuple[float, list[tuple[int, int, float]]]:
    """Minus the log p-value of a text's significant segments together, and these segments.

    By the extreme-value law the best segment has p = 1 - exp(-E); further significant segments
    each add the log of their expected number. There is no upper bound.
    """
    found = maximal_segments(model.scores(tokens))
    if not found:
        return 0.0, []
    n = len(tokens)
    expectation = lambda score: math.log(model.scale * n) - model.rate * score
    strong = [s for s in found if expectation(s[2]) < math.log(significant)]
    best = max(s[2] for s in found)
    log_e = expectation(best)
    total = -log_e if log_e < -30 else -math.log(-math.expm1(-math.exp(min(log_e, 30))))
    return total + sum(-expectation(s) for _, _, s in strong if s < best), strong


def feature_counts(rows: DataFrame) -> DataFrame:
    """``feature, toxic, other``: in how many rows of ``rows(text, toxic)`` of each class a feature occurs."""
    schema = pa.schema([("feature", pa.binary()), ("toxic", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([held[1][x] for x in names], pa.int64()), pa.array([held[0][x] for x in names], pa.int64())], schema=schema)
            held[0].clear()
            held[1].clear()

        for batch in batches:
            for i in range(batch.num_rows):
                found = {f for token in set(words_of(batch.column(0)[i].as_py())) for f in features(token)}
                held[batch.column(1)[i].as_py()].update(found)
                if len(held[0]) + len(held[1]) > HELD:
                    yield from flush()
        yield from flush()

    counted = rows.select("text", "toxic").mapInArrow(run, "feature binary, toxic long, other long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``text, toxic`` of at most ``limit`` labelled documents; ids with several labels take the larger.

    The sample is broadcast (``limit`` ids), so the documents are read without a shuffle.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, least: int = 2) -> Model:
    """Fit on at most ``limit`` labelled rows of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    The documents are read once, to keep the sample. Only features with ``least`` occurrences in
    toxic rows, or more where so many would be in toxic rows alone by chance, and odds over
    ``LEADING`` times the class's come to the driver, no more than the bounded sample has; other
    tokens have log-odds of zero. Without labels of both classes, or without such features, the
    model knows no toxic token. Null texts are empty; rows with a null id or another label than 0
    and 1 count for nothing.
    """
    rows = checkpoint(labelled(docs, labels, limit))
    n = {int(k): c for k, c in rows.groupBy("toxic").count().collect()}
    model = Model()
    if len(n) < 2:
        return model
    model.base = n[1] / (n[0] + n[1])
    counts = feature_counts(rows)
    least = max(least, math.ceil(math.log(CHANCE) / math.log(model.base)))
    leading = counts.where(F.col("toxic") >= least).where(F.col("toxic") * F.lit(n[0]) > F.col("other") * F.lit(LEADING * n[1]))
    model.counts = {bytes(f): (float(t), float(o)) for f, t, o in leading.toArrow().to_pandas().itertuples(index=False)}
    if not model.counts:  # nothing to calibrate: the share alone would reject all or none
        return Model()
    _background(model, rows)
    _calibrate(model, rows)
    model.memo = {}
    return model


def _background(model: Model, rows: DataFrame) -> None:
    """Extreme-value parameters from the scores of the other class's tokens: their shares and the root of E[exp(rate * s)] = 1."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value.leaving(0), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(round(s, 2) for s in own.scores(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.float64()), pa.array(seen.values(), pa.int64())], names=["score", "n"])

    found = rows.where("toxic = 0").select("text").mapInArrow(run, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    model.rate, model.scale = extreme_values({r.score: r.n for r in found})


def extreme_values(seen: dict[float, int]) -> tuple[float, float]:
    """Rate and scale of the law of maximal segments for tokens that have each score so often.

    The rate is the positive root of E[exp(rate * s)] = 1, the scale the part of that mean which
    positive scores give; where none is positive one is counted as seen half a time.
    """
    seen = dict(seen)
    if not any(s > 0 for s in seen):
        seen[1.0] = 0.5
    n = sum(seen.values())
    mean = lambda rate, scores: sum(c * math.exp(min(rate * s, 700)) for s, c in seen.items() if s in scores) / n
    low, high = 1e-6, 50.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle, seen) < 1 else (low, middle)
    return low, max(mean(low, {s for s in seen if s > 0}), 1e-12)


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Logistic calibration of log(1 + evidence) on the sample, rows of each class without their own counts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = [shared.value.leaving(0), shared.value.leaving(1)], Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                seen[round(math.log1p(evidence(own[toxic.as_py()], words_of(text.as_py()))[0]), 2), toxic.as_py()] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.float64()), pa.array([k[1] for k in seen], pa.int32()), pa.array(seen.values(), pa.int64())], names=["x", "toxic", "n"])

    found = rows.mapInArrow(run, "x double, toxic int, n long").groupBy("x", "toxic").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    model.slope, model.shift = logistic(*(np.array(v, dtype=float) for v in zip(*[(r.x, r.toxic, r.n) for r in found], strict=True)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift for values ``x`` of class ``y`` seen ``n`` times, toxic ones counting ``MISSED`` times."""
    n = np.where(y == 1, MISSED * n, n)
    w = np.array([0.5, -2.0])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(60):  # Newton steps with a slight pull to zero
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (n * (p - y)) + 1e-2 * w
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return max(float(w[0]), 1e-3), float(w[1])


FIELDS = [("score", "double", pa.float64()), ("n_passages", "int", pa.int32()), ("passages", "array<struct<first:int,last:int,score:double>>", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])))]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1), ``n_passages`` and ``passages`` to every row of ``docs``, which has ``text``.

    ``passages`` are the significant segments as first and last token (counted from zero, in the
    cut of :func:`words_of`) and score. Null and empty texts have no evidence. Repeated rows are
    scored alike; columns named like the results are replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def one(text):
            x, found = evidence(own, words_of(text))
            value = 1 / (1 + math.exp(-(own.slope * math.log1p(x) + own.shift)))
            return value, len(found), [{"first": a, "last": b - 1, "score": s} for a, b, s in found]

        return one

    return append_columns(docs, ["text"], FIELDS, make)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is below the threshold, with their columns."""
    free, own = shielded(docs, [f[0] for f in FIELDS])
    return score(free, model).where(F.col("score") < threshold).select(*own)
