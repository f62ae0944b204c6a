"""Column functions on text: identity, cleaning, tokens and CSV."""

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Joins lists that older stores keep in one string.
SEP = "<SEP>"

def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def hash_id(prefix: str, text: Column) -> Column:
    """Content address: prefix and MD5 of the text."""
    return F.concat(F.lit(prefix), F.md5(F.encode(text, "UTF-8")))


def tokens(text: Column) -> Column:
    """White-space tokens of a text, in one pass; none for a blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+", -1), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """All named and numeric HTML entities as characters, in Arrow batches; no table of them has to be in a plan."""
    return texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def clean(text: Column) -> Column:
    """HTML entities undone, control characters dropped, stripped."""
    return F.regexp_replace(unescaped(strip(text)), r"[\x00-\x1f\x7f-\x9f]", "")


def decoded_escapes(text: Column) -> Column:
    r"""``\uXXXX`` escapes as characters; other backslashes stay."""
    body = F.regexp_replace(text, r"\\(?!u[0-9a-fA-F]{4})", r"\\\\")
    body = F.concat(F.lit('{"v":"'), F.replace(body, F.lit('"'), F.lit('\\"')), F.lit('"}'))
    return F.coalesce(F.from_json(body, "v string", {"allowUnquotedControlChars": "true"})["v"], text)


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def csv_fields(line: Column) -> Column:
    """Fields of a CSV row without NUL characters; quoted fields may hold commas and doubled quotes (inverse of :func:`csv_row`)."""
    parts = F.regexp_extract_all(F.concat(without_nul(line), F.lit(",")), F.lit(r'(?s)("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    bare = lambda p: F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))
    return F.transform(parts, lambda p: F.when(p.rlike(r'(?s)^".*"$'), bare(p)).otherwise(p))


def quoted(value: Column) -> Column:
    """A CSV field in double quotes."""
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_row(*values: Column) -> Column:
    """A CSV row with every field quoted."""
    return F.concat_ws(",", *[quoted(F.coalesce(v.cast("string"), F.lit(""))) for v in values])


def estimated_tokens(text: Column) -> Column:
    """One and a half tokens for each CJK character and a quarter for each other, cut to a whole number."""
    wide = F.regexp_count(text, F.lit("[\\x{4e00}-\\x{9fff}]"))
    return (wide * 1.5 + (F.length(text) - wide) * 0.25).cast("int")


def summary(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def is_float(text: Column) -> Column:
    """Whether a text is a number in the narrow form that record weights have."""
    return text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def json_body(text: Column) -> Column:
    """From the first brace to the last, without line breaks and with double quotes; null without braces."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    body = F.replace(F.replace(F.replace(body, F.lit("\\n"), F.lit("")), F.lit("\n"), F.lit("")), F.lit("'"), F.lit('"'))
    return F.when(body != "", body)


def label_code(name: Column) -> Column:
    """``x`` and the hexadecimal bytes of a name, a label that any graph store takes."""
    return F.concat(F.lit("x"), F.lower(F.hex(F.encode(name, "UTF-8"))))


def label_name(code: Column) -> Column:
    """Inverse of :func:`label_code`."""
    return F.decode(F.unhex(F.substring(code, 2, 1 << 20)), "UTF-8")
