"""The near-duplicate stage of the pipeline against all pairs of shingle sets."""

import random

import pytest

import corpus_pipeline
from tessella.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_classes(rows):
    label = {i: i for i, _ in rows}
    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = {x: low if y == high else y for x, y in label.items()}
    return label


def near_texts(seed, families=30):
    rng = random.Random(seed)
    rows = [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one  TWO")]
    for family in range(families):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([30, 80, 200]))]
        for copy in range(rng.randint(1, 8)):
            own = list(words)
            for _ in range(rng.randint(0, len(own) // 30)):
                own[rng.randrange(len(own))] = "changed"
            rows.append((family * 10 + copy, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [simhash.BLOCK, 300])
def test_near_copies_match_all_pairs(spark, block):
    rows = near_texts(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert 10 < len(set(want.values())) < len(rows) - 20
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df, block=block).collect()} == want
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_stage_drops_copies_with_a_few_words_changed(spark, sf):
    rows = near_texts(2)
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, df, sf)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(brute_classes(rows).values())
