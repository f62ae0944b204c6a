"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest
from compare import connection, same
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessella.llm import lines, simhash, toxicity
from tessella.llm.common import held_out
from tessella.llm.oracles import ORACLES
from tessella.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), connection(sf), ORACLES[name])


def test_contract_columns(spark, sf):
    want = {
        "op2_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op3_simhash": {"doc_id", "fingerprint", "component_id"},
        "op7_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    }
    for name, columns in want.items():
        assert columns <= set(QUERIES[name](spark, sf).columns)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(spark.createDataFrame(out.collect(), out.schema) if (out := stage(spark, steps[-1], sf)) is not None else None)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all(s.columns == docs.columns for s in steps[1:5])
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
    model = toxicity.train(docs, labels)
    bad = {r.doc_id for r in toxicity.score(docs.select("doc_id", "text"), model).where("score >= 0.5").collect()}
    ids = [{r.doc_id for r in s.collect()} for s in steps]
    assert ids[1] == ids[0] - bad and ids[2] == ids[1]
    spread: dict = {}
    before = {r.doc_id: r.text for r in steps[1].collect()}
    for r in steps[1].collect():
        for line in (r.text or "").split("\n"):
            if line.strip(" \t\r"):
                spread.setdefault(line.strip(" \t\r"), []).append((r.doc_id, r.source))
    wide = {line for line, at in spread.items() if len({s for _, s in at}) >= 3}
    repeated = {line for line, at in spread.items() if len(line.split()) > 50 and len({before[d] for d, _ in at}) > 1}

    def stays(line, doc_id):
        bare = line.strip(" \t\r")
        first = min((d for d, _ in spread.get(bare, [])), default=doc_id)
        return doc_id <= first or not (bare in wide or (bare in repeated and before[first] != before[doc_id]))

    assert wide and repeated
    for r in steps[2].collect():
        assert r.text == "\n".join(x for x in before[r.doc_id].split("\n") if stays(x, r.doc_id))
    classes = {r.doc_id: r.component_id for r in simhash.near_copies(steps[2]).collect()}
    assert ids[3] == set(classes.values())
    assert ids[4] <= ids[3] and {r.doc_id for r in steps[5].collect()} == ids[4]
    assert lines.lines_of is not None


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
