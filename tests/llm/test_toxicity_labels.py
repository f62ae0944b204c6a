"""Toxicity learned from labels of other shares of toxic rows than the given ones."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import toxicity
from tessella.llm.common import held_out

SF01 = "/root/testdata/sf0.1"


@pytest.mark.parametrize("share", [0.25, 0.4, 0.6])
def test_labels_with_many_toxic_rows(spark, share):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    toxic, other = (labels.where(~out).where(F.col("toxic") == k) for k in (1, 0))
    other = other.orderBy(F.xxhash64("doc_id")).limit(int(toxic.count() * (1 - share) / share))
    model = toxicity.train(docs, toxic.unionByName(other))
    assert model.counts
    scored = toxicity.score(docs.where(out).select("doc_id", "text"), model).join(labels, "doc_id").select("score", "toxic").collect()
    found, flagged = ([r.score >= 0.5 for r in scored if r.toxic == k] for k in (1, 0))
    print(share, sum(found), len(found), sum(flagged), len(flagged))
    assert sum(found) > 0.75 * len(found) and sum(flagged) < 0.1 * len(flagged)


def test_labels_that_no_word_follows_reject_nothing(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(10)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i < 6)) for i in range(10)], "doc_id long, toxic int"))
    assert toxicity.drop_toxic(docs, model).count() == 10
