"""Tokenizers: white space, CJK characters, and injected encoders.

A tokenizer counts the tokens of a text and cuts it into overlapping windows ``(tokens, content)``.
Those of this module but :class:`Encoded` are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import strip, tokens

WINDOWS = "array<struct<tokens:int,content:string>>"


class Tokenizer(Protocol):
    def count(self, text: Column) -> Column: ...

    def windows(self, text: Column, size: int, overlap: int) -> Column: ...


def _cut(words: Column, size: int, overlap: int, join: Callable[[Column], Column]) -> Column:
    """Windows over an array of tokens; a last one may lie within that before it.

    The array is handed on as a lambda's variable, so that it is made once and not for each window.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(F.least(F.lit(size), n - s).alias("tokens"), join(F.slice(w, s + 1, F.lit(size))).alias("content")))

    return F.flatten(F.transform(F.array(words), windows))


class WhiteSpace:
    """Runs without white space."""

    def tokens(self, text: Column) -> Column:
        return tokens(text)

    def count(self, text: Column) -> Column:
        return F.size(self.tokens(text))

    def join(self, part: Column) -> Column:
        return F.array_join(part, " ")

    def windows(self, text: Column, size: int, overlap: int) -> Column:
        return _cut(self.tokens(text), size, overlap, self.join)

    def windows_if_long(self, text: Column, size: int, overlap: int) -> Column:
        """Windows of a text of over ``size`` tokens, a shorter one whole and stripped."""
        whole = lambda w: F.array(F.struct(F.size(w).alias("tokens"), strip(text).alias("content")))
        return F.flatten(F.transform(F.array(self.tokens(text)), lambda w: F.when(F.size(w) > size, _cut(w, size, overlap, self.join)).otherwise(whole(w))))


class Characters(WhiteSpace):
    """CJK ideographs one by one, other runs without white space as they are; windows keep the text's own spaces."""

    def tokens(self, text: Column) -> Column:
        wide = r"\x{4e00}-\x{9fff}"
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?U)\s*(?:[{wide}]|[^\s{wide}]+)"), F.lit(0))

    def join(self, part: Column) -> Column:
        return strip(F.array_join(part, ""))


class Encoded:
    """An injected encoder; ``make()`` opens it in a task and gives ``(encode, decode)``. Texts go in Arrow batches."""

    def __init__(self, make: Callable[[], tuple[Callable[[str], list[int]], Callable[[list[int]], str]]]):
        self.make = make

    def encode(self, text: Column) -> Column:
        return self._udf("array<int>", lambda encode, decode, text: encode(text or ""))(text)

    def decode(self, ids: Column) -> Column:
        return self._udf("string", lambda encode, decode, ids: None if ids is None else decode([int(i) for i in ids]))(ids)

    def count(self, text: Column) -> Column:
        return self._udf("int", lambda encode, decode, text: len(encode(text or "")))(text)

    def windows(self, text: Column, size: int, overlap: int) -> Column:
        def cut(encode, decode, text):
            ids = encode(text or "")
            return [{"tokens": min(size, len(ids) - at), "content": decode(ids[at : at + size])} for at in range(0, len(ids), size - overlap)]

        return self._udf(WINDOWS, cut)(text)

    def _udf(self, kind: str, one: Callable):
        make = self.make

        def run(batches):
            encode, decode = make()
            for batch in batches:
                yield pd.Series([one(encode, decode, x) for x in batch], dtype=object)

        from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

        return pandas_udf(run, kind, PandasUDFType.SCALAR_ITER)


WHITE = WhiteSpace()
