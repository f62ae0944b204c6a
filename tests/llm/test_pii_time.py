"""Personal data in texts with very many matches: right places, in time that follows the text."""

import time

from tessella.llm import pii


def test_thousands_of_matches_in_one_text(spark):
    def found(n):
        text = "é " + " ".join(f"ab{i}@host.example ip 10.0.{i % 256}.{i // 256}" for i in range(n))
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
        rows.count()
        began = time.time()
        spans = pii.find_spans(rows).first().spans
        taken = time.time() - began
        assert len(spans) == 2 * n and all(text[s.start : s.end] == (f"ab{k // 2}@host.example" if k % 2 == 0 else f"10.0.{k // 2 % 256}.{k // 2 // 256}") for k, s in enumerate(spans))
        return taken

    found(10)
    few, many = min(found(4000), found(4000)), found(16000)
    assert many < 6 * few + 2


def test_contexts_across_blocks(spark):
    rows = [(n, "x" * n + " my ssn is 123-45-6789 " + "y" * 600) for n in range(480, 530, 3)]
    for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [(s.kind, s.start) for s in r.spans] == [("ssn", r.doc_id + 11)]
