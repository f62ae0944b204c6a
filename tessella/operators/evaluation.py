"""Evaluation tables."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.limits import Limits, in_order
from tessella.functions.vectors import cosine

METRICS = ("coverage", "depth", "hierarchy", "semantic_connectivity", "global_understanding")


def diversity(answer: Column) -> Column:
    """Five scores of a judge's JSON answer and their mean, to four places; zeros where one is missing."""
    parsed = F.from_json(answer, ", ".join(f"{m} double" for m in METRICS))
    whole = F.lit(True)
    for m in METRICS:
        whole &= parsed[m].isNotNull()
    whole = F.coalesce(whole, F.lit(False))
    values = [F.when(whole, F.round(parsed[m], 4)).otherwise(0.0).alias(m) for m in METRICS]
    mean = sum((parsed[m] * 0.2 for m in METRICS), F.lit(0.0))
    return F.struct(F.when(whole, F.round(mean, 4)).otherwise(0.0).alias("score"), *values)


def entity_recall(response: Column, reference: Column) -> Column:
    """Share of the reference's entities that the response has; null without any."""
    return F.size(F.array_intersect(F.array_distinct(response), F.array_distinct(reference))) / F.nullif(F.size(F.array_distinct(reference)), F.lit(0))


def sentinel(score: Column, failed: float = 10.0) -> Column:
    """A score as older tables keep it: ``failed`` where there is none or it is no number."""
    return F.coalesce(F.expr("try_cast(null as double)") if score is None else score.try_cast("double"), F.lit(failed))


def resume(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a result yet."""
    return items.join(done.select(key), key, "left_anti")


def judged(rows: DataFrame, judge, columns: list[str], key: str = "id", batch: int = 64, limits: Limits = Limits()) -> DataFrame:
    """``key, score, error`` by an injected ``judge(list of dicts) -> list of float or None``.

    ``batch`` rows a call, several calls at a time; a call that still fails after its retries gives
    null scores and its message, not a lost task.
    """
    kind = dict(rows.dtypes)[key]

    def ask(part):
        scores = judge(part[columns].to_dict("records"))
        if len(scores) != len(part):
            raise ValueError(f"{len(scores)} scores for {len(part)} rows")
        return scores

    def run(frames):
        import pandas as pd

        held = deque()

        def parts():
            for frame in frames:
                for at in range(0, len(frame), batch):
                    held.append(frame.iloc[at : at + batch])
                    yield held[-1]

        for scores, error in in_order(ask, parts(), limits):
            part = held.popleft()
            yield pd.DataFrame({key: part[key].to_numpy(), "score": pd.array(scores if error is None else [None] * len(part), dtype="Float64"), "error": None if error is None else str(error)})

    return rows.select(key, *columns).mapInPandas(run, f"{key} {kind}, score double, error string")


# metrics over a judge's verdicts: the judge says yes or no, the scores are computed here


def verdicts(rows: DataFrame, judge, key: str = "id", limits: Limits = Limits()) -> DataFrame:
    """``key, context, claim, supported, error``: the judge's word on each of ``claims`` by each of ``contexts`` of a row.

    ``judge(claims, context)`` gives a list of booleans; it is called once for each context, several
    contexts at a time. A call that still fails after its retries, or has another number of
    verdicts, leaves its claims with nulls and the message.
    """
    kind = dict(rows.dtypes)[key]
    each = rows.where(F.size("claims") > 0).select(key, "claims", F.posexplode("contexts").alias("context", "text"))

    def ask(row):
        found = [bool(v) for v in judge(list(row[1]), row[3])]
        if len(found) != len(row[1]):
            raise ValueError(f"{len(found)} verdicts on {len(row[1])} claims")
        return found

    def run(frames):
        import pandas as pd

        held = deque()

        def items():
            for frame in frames:
                for row in frame.itertuples(index=False, name=None):
                    held.append(row)
                    yield row

        for found, error in in_order(ask, items(), limits):
            k, claims, context, _ = held.popleft()
            yield pd.DataFrame({key: [k] * len(claims), "context": context, "claim": range(len(claims)), "supported": pd.array(found if error is None else [None] * len(claims), dtype="boolean"), "error": None if error is None else str(error)})

    return each.mapInPandas(run, f"{key} {kind}, context int, claim int, supported boolean, error string")


def supported_share(found: DataFrame, key: str = "id") -> DataFrame:
    """Share of the claims of ``found(key, context, claim, supported)`` that any context supports: faithfulness of a response's claims, recall of a reference's.

    Claims without a verdict by any context do not count; a row without claims has no score.
    """
    each = found.groupBy(key, "claim").agg(F.max("supported").alias("supported"))
    return each.where("supported is not null").groupBy(key).agg(F.avg(F.col("supported").cast("double")).alias("score"))


def context_precision(found: DataFrame, key: str = "id") -> DataFrame:
    """Mean of the precisions at the places of useful contexts in ``found(key, context, useful)``; zero without a useful one.

    Places are the order of ``context``; a context without a verdict holds a place and is not useful,
    one with several verdicts is useful if any says so.
    """
    once = found.groupBy(key, "context").agg(F.coalesce(F.max("useful"), F.lit(False)).alias("useful"))
    each = once.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("context", "useful"))).alias("c"))
    hits = F.array_compact(F.transform("c", lambda x, i: F.when(x["useful"], i + 1)))
    total = F.aggregate(F.transform(hits, lambda place, i: (i + 1) / place), F.lit(0.0), lambda a, x: a + x)
    return each.select(key, F.when(F.size(hits) > 0, total / F.size(hits)).otherwise(0.0).alias("score"))


def noise_sensitivity(answer_by_context: DataFrame, reference_by_context: DataFrame, answer_by_reference: DataFrame, key: str = "id") -> DataFrame:
    """Share of a response's claims that are wrong by the reference though a relevant context supports them.

    The tables are verdicts ``(key, context, claim, supported)`` on the response's and on the
    reference's claims by contexts, and ``(key, claim, supported)`` on the response's by the
    reference. A context is relevant if it supports a claim of the reference.
    """
    relevant = reference_by_context.where("supported").select(key, "context").distinct()
    misled = answer_by_context.where("supported").join(relevant, [key, "context"], "left_semi").select(key, "claim").distinct().withColumn("misled", F.lit(True))
    claims = answer_by_reference.where("supported is not null").groupBy(key, "claim").agg(F.max("supported").alias("right"))
    wrong = F.coalesce(F.col("misled"), F.lit(False)) & ~F.col("right")
    return claims.join(misled, [key, "claim"], "left").groupBy(key).agg(F.avg(wrong.cast("double")).alias("score"))


def response_relevancy(questions: DataFrame, generated: DataFrame, key: str = "id") -> DataFrame:
    """Mean cosine of ``questions(key, vector)`` with the questions ``generated(key, vector, noncommittal)`` from the response; zero if all are noncommittal."""
    pairs = generated.join(questions.select(key, F.col("vector").alias("__asked")), key)
    found = pairs.groupBy(key).agg(F.avg(cosine(F.col("vector"), F.col("__asked"))).alias("mean"), F.min(F.coalesce("noncommittal", F.lit(False))).alias("none"))
    return found.select(key, F.when(F.col("none"), 0.0).otherwise(F.col("mean")).alias("score"))
