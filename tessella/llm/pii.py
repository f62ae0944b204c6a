"""Personal data spans with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and value checks confirm them, and
context words nearby adjust their scores. Java's possessive quantifiers keep matching linear: no
class below can match what has to follow it, so giving nothing back changes no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, the first four as the contract lists them.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: Fixed patterns. In ``email`` a match may begin where a run begins or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: Cheap tests that a text must pass before a pattern is tried.
PROBES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z][A-Z][0-9][0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
}

#: Score of a span by its form and checksum alone, what a context word adds, and what a span beyond the base kinds needs.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT_ADDS = 0.3
LEAST = 0.6
#: Characters before and after a span in which context words count.
NEAR = 40

#: Fixed context words.
CONTEXT = {
    "email": "mail|e-mail|contact|correo|kontakt",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}

_VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CHUNK = 256


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mod97(compact: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters last and letters as two digits."""
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def step(rest: Column, character: Column) -> Column:
        value = F.call_function("instr", F.lit(_VALUES), character) - 1
        return (rest * F.when(value < 10, 10).otherwise(100) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def confirmed(kind: str, match: Column) -> Column:
    """Whether checks on its value confirm a match."""
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits(match))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        compact = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & (mod97(compact) == 1)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9[0-9][0-9])|^[0-9]{3}-00|0000$")
    return F.lit(True)


def running_starts(lengths: Column) -> Column:
    """Sum of the elements before each element, in two levels so that long arrays take no quadratic time."""

    def sums(array: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(array, empty, step, lambda acc: acc["out"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda k: F.slice(lengths, k * _CHUNK + 1, F.lit(_CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, sums(totals, F.lit(0)), sums))


def find_spans(docs: DataFrame) -> DataFrame:
    """Add ``spans array<struct<kind, start, end, rank, score>>`` to every row of ``docs``, which has ``text``.

    ``start`` and ``end`` (exclusive) count code points of the whole text; ``rank`` is the kind's
    place in the order of kinds. Matches of a kind are leftmost and do not overlap; those of
    different kinds may. Base kinds stay whatever their score; the further ones need a score of
    ``LEAST``. Null and empty texts have no spans. Spans come by start, then rank.
    """
    kept = [c for c in docs.columns if c != "spans"]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    none = F.lit(None).cast("array<string>")
    df = df.withColumns({f"__m_{k}": F.when(PROBES[k](F.col("__t")), F.regexp_extract_all("__t", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    found = {k: F.size(f"__m_{k}") > 0 for k in KINDS}
    df = df.withColumns({f"__a_{k}": F.when(found[k], _ahead(k)) for k in KINDS})
    df = df.withColumns({f"__s_{k}": F.when(found[k], F.zip_with(running_starts(F.col(f"__a_{k}")), F.col(f"__a_{k}"), lambda s, a: s + a)) for k in KINDS})
    some = F.coalesce(*[F.when(found[k], True) for k in KINDS])
    df = df.withColumn("__b", F.when(some, F.regexp_extract_all("__t", F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))))
    made = [F.when(found[k], _good(k, rank)).otherwise(F.array().cast(_TYPE)) for rank, k in enumerate(KINDS)]
    return df.withColumn("spans", F.array_sort(F.flatten(F.array(*made)))).select(*[F.col(f"`{c}`") for c in kept], "spans")


def _ahead(kind: str) -> Column:
    """What each match's start adds to that of the match before: the gap between and the match before.

    The gaps are an argument of ``zip_with``, so the text is split once and not for each match.
    """
    gaps, matches = F.split("__t", PATTERNS[kind], -1), F.col(f"__m_{kind}")
    before = F.concat(F.array(F.lit(0)), F.transform(matches, lambda m: F.length(m)))
    return F.slice(F.zip_with(gaps, before, lambda gap, n: F.length(gap) + n), F.lit(1), F.size(matches))


def _good(kind: str, rank: int) -> Column:
    """Confirmed spans of a kind."""
    pairs = F.zip_with(F.col(f"__s_{kind}"), F.col(f"__m_{kind}"), lambda s, m: F.struct(s.alias("s"), m.alias("m")))
    good = F.transform(F.filter(pairs, lambda x: confirmed(kind, x["m"])), lambda x: _span(kind, rank, x["s"], x["m"]))
    return F.filter(good, lambda x: x["score"] >= LEAST) if rank >= 4 else good


#: Characters of the blocks that contexts are taken from, so that a span needs no walk through the whole text.
_BLOCK = 512


def _between(start: Column, n: Column) -> Column:
    """At most ``_BLOCK`` characters of the text from a place on, out of two blocks."""
    k = F.floor(start / _BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(F.col("__b"), k), F.lit("")), F.coalesce(F.get(F.col("__b"), k + 1), F.lit("")))
    return F.substring(two, start - k * _BLOCK + 1, n)


_TYPE = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _span(kind: str, rank: int, start: Column, match: Column) -> Column:
    end = start + F.length(match)
    from_ = F.greatest(start - NEAR, F.lit(0))
    around = F.concat(_between(from_, start - from_), F.lit(" "), _between(end, F.lit(NEAR)))
    score = F.least(F.lit(SCORES[kind]) + F.when(F.lower(around).rlike(rf"(?<!\p{{L}})(?:{CONTEXT[kind]})(?!\p{{L}})"), CONTEXT_ADDS).otherwise(0.0), F.lit(1.0))
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), score.cast("double").alias("score"))


def has_context(span: Column) -> Column:
    """Whether a context word near a span raised its score."""
    alone = F.lit(0.0)
    for kind, score in SCORES.items():
        alone = F.when(span["kind"] == kind, score).otherwise(alone)
    return span["score"] > alone


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "*") -> DataFrame:
    """Rows of ``docs`` with every character inside a span replaced by ``mark`` in ``text``; a null text stays null."""
    found = find_spans(docs)
    masked = F.aggregate("spans", F.col("text"), lambda t, s: F.overlay(t, F.repeat(F.lit(mark), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))
    return found.withColumn("text", masked).select(*[F.col(f"`{c}`") for c in docs.columns])
