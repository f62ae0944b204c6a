"""Toxic passages in texts without ASCII separators."""

import pytest

from tessella.llm import toxicity


def test_words_cover_the_whole_text():
    words = lambda text: [w.decode() for w in toxicity.words_of(text)]
    assert words(None) == [] and words("One, two-THREE 4\ud800x") == ["one", "two", "three", "x"]
    assert words("\u201cIdiot\u201d\u2014\u00c9t\u00e9\u00a0b") == ["idiot", "\u00e9t\u00e9", "b"]
    assert words("\u4f60\u597d\u5417\uff0cabc\u574f") == ["\u4f60\u597d", "\u597d\u5417", "abc", "\u574f"]
    for letter in "a\u00e9":
        assert words(letter * 5000 + "idiot") == [letter * 6] * 4995 + [letter * k + "idiot"[: 6 - k] for k in range(5, 0, -1)]
    assert words("a" * 64) == ["a" * 64]


SPELT = {
    "quotes": (lambda words: " ".join(f"\u201c{w}\u201d" for w in words), "stupid"),
    "joined": (lambda words: "\u00a0".join(words), "stupid"),
    "chinese": (lambda words: "".join(words), "\u574f\u86cb"),
}


@pytest.mark.parametrize("kind", SPELT)
def test_toxic_words_far_into_a_text(spark, kind):
    spell, bad = SPELT[kind]
    plain = ["\u4f60\u597d", "\u5929\u6c14", "\u597d\u5403", "\u8001\u5e08", "\u706b\u8f66"] if kind == "chinese" else ["river", "house", "garden", "letter", "winter"]
    filler = lambda i, n: [plain[(i * k + k // 3) % 5] for k in range(n)]
    text = lambda i, toxic: spell(filler(i, 60) + [bad] * 4 * toxic + filler(i + 1, 20))
    rows = [(i, text(i, i % 4 == 0)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs.where("doc_id < 60"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int"))
    kept = {r.doc_id for r in toxicity.drop_toxic(docs.where("doc_id >= 60"), model).collect()}
    assert kept == {i for i in range(60, 80) if i % 4}
