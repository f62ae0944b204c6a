"""Injected models: protocols, Arrow-batched calls, and deterministic stand-ins for tests."""

from __future__ import annotations

import hashlib
import itertools
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.limits import Limits, in_order
from tessella.functions.text import token_count
from tessella.operators import extraction


class Embed(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Complete(Protocol):
    def __call__(self, prompt: str, history: list[dict] | None = None) -> str: ...


class Score(Protocol):
    def __call__(self, query: str, texts: list[str]) -> list[float | None]: ...


def embedded(rows: DataFrame, embed: Embed, text: str = "content", key: str = "id", batch: int = 32, limits: Limits = Limits()) -> DataFrame:
    """``key, vector`` of every row, embedded ``batch`` texts a call inside the tasks, several calls at a time.

    A call that still fails after its retries, or gives another number of vectors than texts, fails
    its task, so no row is half done.
    """
    kind = dict(rows.dtypes)[key]

    def ask(part):
        vectors = embed(part[text].tolist())
        if len(vectors) != len(part):
            raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
        return vectors

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        held = deque()

        def parts() -> Iterator:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    held.append(frame.iloc[at : at + batch])
                    yield held[-1]

        for vectors, error in in_order(ask, parts(), limits):
            part = held.popleft()
            if error is not None:
                raise error
            yield pd.DataFrame({key: part[key].to_numpy(), "vector": list(vectors)})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def answered(rows: DataFrame, complete: Complete, prompt: str = "prompt", key: str = "id", limits: Limits = Limits()) -> DataFrame:
    """``key, answer, error`` of a model on every row's prompt, several calls at a time.

    A call that still fails after its retries, or has no answer by its deadline, is a row with the message.
    """
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        keys = deque()

        def prompts() -> Iterator[str]:
            for frame in frames:
                for k, asked in zip(frame[key], frame[prompt], strict=True):
                    keys.append(k)
                    yield asked

        made = []
        for answer, error in in_order(complete, prompts(), limits):
            made.append((keys.popleft(), answer, None if error is None else str(error)))
            if len(made) >= TOGETHER:
                yield pd.DataFrame(made, columns=[key, "answer", "error"])
                made = []
        if made:
            yield pd.DataFrame(made, columns=[key, "answer", "error"])

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, error string")


#: Answers of one output frame.
TOGETHER = 256


#: Prompts of extraction; an application gives its own.
EXTRACT = 'List entities as ("entity"<|>name<|>type<|>description) and relationships as ("relationship"<|>source<|>target<|>description<|>keywords<|>weight), joined by ## and ended by <|COMPLETE|>.\nText: '
SUMMARISE = "Summarise what these descriptions of one thing say.\n"
SAME = "Answer yes or no: do these two questions ask for the same?\n"
MORE, ASK = "Some were missed. Add them in the same format.", "Answer yes or no: are entities still missing?"


def gleaned(complete: Complete, text: str, rounds: int = 1, yes: tuple[str, ...] = ("yes", "是")) -> str:
    """Records of a text: a first call, then up to ``rounds`` further ones while the model says that some are missing."""
    history = [{"role": "user", "content": EXTRACT + text}]
    answer = complete(EXTRACT + text)
    history.append({"role": "assistant", "content": answer})
    for k in range(rounds):
        more = complete(MORE, history)
        history += [{"role": "user", "content": MORE}, {"role": "assistant", "content": more}]
        answer += extraction.RECORD + more
        if k == rounds - 1 or complete(ASK, history).strip().strip("\"'").lower() not in yes:
            break
    return answer


def extracted(chunks: DataFrame, complete: Complete, rounds: int = 1, limits: Limits = Limits()) -> DataFrame:
    """``chunk_id, text, error``: a model's records for every chunk ``(id, content)``, or the message of its failure."""
    found = answered(chunks, lambda text: gleaned(complete, text, rounds), "content", limits=limits)
    return found.select(F.col("id").alias("chunk_id"), F.col("answer").alias("text"), "error")


def scored(rows: DataFrame, score: Score, text: str = "content", query: str = "query", batch: int = 64, limits: Limits = Limits()) -> DataFrame:
    """Rows with the ``score`` of a reranker for their text and query, ``batch`` texts a call, several calls at a time.

    A call that still fails after its retries, or gives another number of scores than texts, leaves its rows with a null.
    """
    from pyspark.sql import types as T

    kept = rows.drop("score")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def ask(job):
        asked, texts, _ = job
        found = score(asked, texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} scores for {len(texts)} texts")
        return found

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in batches:
            texts, queries, out = part.column(text).to_pylist(), part.column(query).to_pylist(), [None] * part.num_rows
            jobs = []
            for asked in dict.fromkeys(queries):
                own = [i for i, q in enumerate(queries) if q == asked]
                jobs += [(asked, [texts[i] for i in own[at : at + batch]], own[at : at + batch]) for at in range(0, len(own), batch)]
            for (_, _, own), (found, error) in zip(jobs, in_order(ask, jobs, limits), strict=True):
                if error is None:
                    for i, value in zip(own, found, strict=True):
                        out[i] = value
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], names=[*part.schema.names, "score"])

    return kept.mapInArrow(run, schema)


def summarised(rows: DataFrame, complete: Complete, limit: int = 500, text: str = "description", key: str = "id", counter: Callable | None = None, limits: Limits = Limits()) -> DataFrame:
    """Rows whose text has over ``limit`` tokens with a model's summary instead; the text stays where a call fails (A4)."""
    long = rows.where((counter or token_count)(F.col(text)) > limit).select(key, F.concat(F.lit(SUMMARISE), F.col(text)).alias("prompt"))
    short = answered(long, complete, "prompt", key, limits).select(key, "answer")
    return rows.join(short, key, "left").withColumn(text, F.coalesce("answer", text)).select(*rows.columns)


def accepted(rows: DataFrame, complete: Complete, question: Callable[[str], str], text: str = "text", key: str = "id", yes: str = "是", limits: Limits = Limits()) -> DataFrame:
    """Rows for which a model answers exactly ``yes``."""
    asked = answered(rows.select(key, text), lambda t: complete(question(t)), text, key, limits)
    return rows.join(asked.where(F.trim("answer") == yes).select(key), key, "left_semi")


class routed:
    """Calls models in turn, the second first; safe where several calls are in flight, and each task counts for itself (U4)."""

    def __init__(self, models: list[Complete]):
        self.models, self.turns = models, itertools.count(1)

    def __call__(self, prompt: str, history: list[dict] | None = None) -> str:
        return self.models[next(self.turns) % len(self.models)](prompt, history)

    def __reduce__(self):  # a task begins its own count
        return routed, (self.models,)


def hashed_embedding(texts: list[str], size: int = 16) -> list[list[float]]:
    """Deterministic vectors from word digests, for tests."""
    out = []
    for text in texts:
        vector = [0.0] * size
        for word in text.lower().split():
            digest = hashlib.md5(word.encode()).digest()
            vector[digest[0] % size] += 1.0 if digest[1] % 2 else -1.0
        out.append(vector)
    return out
