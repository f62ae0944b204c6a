"""The filter audit against a plain simulation, whitening against numpy."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from tessella.llm import audit, whitening

DOCS = "doc_id long, text string, source string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def simulated(docs, labels):
    """All orders, step by step, over plain rows."""
    texts = [t or "" for _, t, _ in docs]
    fails = []
    for (doc_id, _, _), text in zip(docs, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(doc_id is not None and d is not None and d < doc_id and t == text for (d, _, _), t in zip(docs, texts, strict=True))
        caps, symbol = sum("A" <= c <= "Z" for c in text), any(c in "#$%&*|" for c in text)
        checks = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * caps > 2 * len(text), symbol, smaller)
        fails.append({f for f, hit in zip("ABCDE", checks, strict=True) if hit})
    out, total = {}, {}
    parts = {s or "" for _, _, s in docs}
    for part in parts:
        own = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        good, bad = ({i for i in own if any(x[0] is not None and x[0] == docs[i][0] and x[k] == 1 for x in labels)} for k in (1, 2))
        for order in map("".join, permutations("ABCDE")):
            left = set(own)
            for step, f in enumerate(order, 1):
                hit = {i for i in own if f in fails[i]}
                gone = hit & left
                out[part, order, step] = [len(left - gone), len(gone), len(hit - left), sum(fails[i] == {f} for i in own), len(gone & good), len(gone & bad)]
                total[part, f] = total.get((part, f), 0) + len(gone)
                left -= gone
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_a_simulation(spark):
    rng = random.Random(4)
    words = ["tree", "House", "river", "a#b", "NATO", "é", "of"]
    docs = [(None, "a b", "s1"), (1, None, None), (2, "", "s1"), (3, " \n\x0b", "s1"), (3, " \n\x0b", "s1"), (4, "x " * 30_000, "s2"), (None, "a b", "s1"), (1, "a b", "s3")]
    for i in range(5, 120):
        text = " ".join(rng.choice(words[: rng.randint(2, 7)]) + (str(rng.randint(0, 300)) if i % 3 else "") for _ in range(rng.choice([3, 150, 199, 200, 201, 260])))
        docs.append((i, docs[rng.randint(8, len(docs) - 1)][1] if i > 20 and rng.random() < 0.3 else text, rng.choice(["s1", "s1", "s2", None, ""])))
    docs.append((7, docs[12][1], "s2"))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130, 2)] + [(8, 1, 0), (8, 0, 1), (None, 1, 1)]
    found = audit.filter_audit(spark.createDataFrame([(*d, "other", 9) for d in docs], DOCS), spark.createDataFrame(labels, LABELS)).collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in found} == simulated(docs, labels)
    assert len(found) == 600 * len({d[2] or "" for d in docs})


def test_sums_are_turned_back_exactly(spark):
    rows = spark.createDataFrame([("p", 2, m) for m in range(32) for _ in range(m * m)], "part string, label int, mask int")
    (row,) = audit.parity_sums(rows).collect()
    assert (row.part, row.label, row.sums[0]) == ("p", 2, sum(m * m for m in range(32)))
    assert list(audit.cells(np.array(row.sums))) == [m * m for m in range(32)]


def test_audit_of_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert audit.filter_audit(empty, spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0
    one = audit.filter_audit(spark.createDataFrame([(1, "a", None, "x", 1)], DOCS), spark.createDataFrame([], LABELS))
    assert one.count() == 600 and {r.part for r in one.collect()} == {""}


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (5, 5), (8, 3), (33, 33)])
def test_jacobi_against_numpy(d, rank):
    x = np.random.default_rng(d).normal(size=(rank * 3 + 1, rank)) @ np.random.default_rng(1).normal(size=(rank, d))
    a = x.T @ x
    values, vectors = whitening.jacobi(a)
    assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1], rel=1e-9, abs=1e-9 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12 and np.abs(vectors @ np.diag(values) @ vectors.T - a).max() < 1e-11 * values[0]


def test_jacobi_keeps_small_eigenvalues_accurate():
    scale = np.diag([1e8, 1.0, 1e-8])
    a = scale @ np.array([[1.0, 0.3, 0.2], [0.3, 1.0, 0.4], [0.2, 0.4, 1.0]]) @ scale
    smallest = whitening.jacobi(a)[0][-1]
    assert smallest == pytest.approx(np.linalg.det(np.array([[1.0, 0.3, 0.2], [0.3, 1.0, 0.4], [0.2, 0.4, 1.0]])) / (1 - 0.09) * 1e-16, rel=1e-6)
    assert list(whitening.jacobi(np.diag([1.0, 3.0, 2.0]))[0]) == [3.0, 2.0, 1.0] and not whitening.jacobi(np.zeros((3, 3)))[0].any()


def plain_whitening(rows, k=4):
    good = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    once = np.array(sorted({tuple(x) for _, x in good}), dtype=np.int64)
    n, sums = len(once), once.sum(0)
    centred = once - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return {i: (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x) - sums / n) @ vectors / np.sqrt(values), values / np.trace(cov)) for i, x in good}, vectors


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 9)) * np.array([5, 3, 2, 1.5, 1, 0.7, 0.5, 0.2, 0.1])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # copies are fitted on once
    rows += [(2000, None), (2001, [float("nan"), *[0.0] * 8]), (2002, [None, *[0.0] * 8]), (2003, [float("inf"), *[0.0] * 8]), (2004, []), (2005, [-0.0] * 9), (2005, [-0.0] * 9)]
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, component int, whitened string")
    found = whitening.whiten(table).collect()
    want, _ = plain_whitening([(i, v) for i, v in rows])
    assert len(found) == 4 * (300 + 400 + 2) and {r.vec_id for r in found} == set(want)
    signs = {}
    for r in found:
        n, deviation, white, share = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(share[r.component - 1], rel=1e-9) and r.identity_error < 1e-10
        if abs(white[r.component - 1]) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * white[r.component - 1] > 0)
        assert abs(r.whitened) == pytest.approx(abs(white[r.component - 1]), rel=1e-7, abs=1e-9)
    assert all(len(s) == 1 for s in signs.values()) and set(signs) == {1, 2, 3, 4}


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0  # nothing varies
    line = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 6.0]), (3, [0.0, 0.0]), (4, [1.0])], kind)).collect()
    assert [(r.vec_id, r.component, r.n) for r in sorted(line, key=str)] == [(2, 1, 3), (3, 1, 3), (None, 1, 3)] and {round(r.explained, 9) for r in line} == {1.0}
    with pytest.raises(Exception, match="int64|too large|Overflow|overflow|bounds"):
        whitening.whiten(spark.createDataFrame([(1, [3e7, 0.0]), (2, [-3e7, 1.0])], kind)).collect()
    wide = whitening.whiten(spark.createDataFrame([(1, [1e6, 0.0]), (2, [-1e6, 1.0])], kind)).collect()
    assert {r.deviation for r in wide} == {(256 * 2 * 10**6) ** 2 + 256**2}
