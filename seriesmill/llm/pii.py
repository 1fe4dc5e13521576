"""Personal data spans, in DataFrame functions only.

A regular expression of each kind proposes spans, left to right without overlap.
Checks confirm them: the parts of an address, the digit count, the Luhn sum of a
card, the mod-97 rest of an account number. Context words within ``NEAR``
characters on either side raise the score of a span; a span counts from
``THRESHOLD`` on. The confirmed kinds reach it alone; an account number with a
valid check also; a national number or a loose phone number (digits in
groups, without a plus sign) only with a context word beside it.

Positions come from cutting the text at the matches: the gaps and the matches
alternate, so a running sum of their lengths is the place of each, in code
points. Where a pattern could start inside a run that it has failed on, a
look-behind stops it; ``\\G`` keeps the start right after the last match.

Defined cases: a null or empty text has no spans; overlapping spans of different
kinds are all reported; rows that repeat a doc_id are searched one by one; extra
columns are kept, but for one with the name of the spans; ``redacted`` keeps a null text null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.quality import let

#: The kinds of the contract in their order, then those of the method.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national", "loosephone")
NEAR, THRESHOLD = 40, 0.6

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind: (substring that any match has, pattern, score alone, score beside a context word, context words)
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+", 0.9, 1.0, "mail|contact"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, 0.9, "ip|host|address|server"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++", 0.8, 1.0, "card|visa|credit|pay"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, 0.9, "tel|phone|call|fax|mobile"),
    "iban": ("", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])", 0.8, 1.0, "iban|account|konto"),
    "national": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, 0.8, "ssn|social|national|passport"),
    "loosephone": ("", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", 0.3, 0.7, "tel|phone|call|fax|mobile"),
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """An account number's rest: country and check go to the end, letters count from 10, base 97."""
    moved = F.concat(F.substring(match, 5, 40), F.substring(match, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


def _confirmed(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return _mod97(match) == 1
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """The spans of one kind: array of (kind, start, stop, score), by start."""
    has, pattern, alone, beside, context = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,score:double>>")

    def placed(found: Column) -> Column:
        """Walks over gaps and matches; keeps the confirmed ones with their place."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,start:int,stop:int>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(found["gaps"], i))
            end = begin + F.length(F.get(found["hits"], i))
            one = F.struct(i.alias("i"), begin.alias("start"), end.alias("stop"))
            keep = F.when(_confirmed(kind, F.get(found["hits"], i)), F.array(one)).otherwise(F.array().cast("array<struct<i:int,start:int,stop:int>>"))
            return F.struct(end.alias("at"), F.concat(acc["out"], keep).alias("out"))

        places = F.aggregate(F.sequence(F.lit(0), F.size(found["hits"]) - 1), start, step, lambda acc: acc["out"])

        def scored(x: Column) -> Column:
            around = F.concat_ws(
                " ", F.substring(text, F.greatest(x["start"] - NEAR, F.lit(0)) + 1, F.least(x["start"], F.lit(NEAR))), F.substring(text, x["stop"] + 1, F.lit(NEAR))
            )
            score = F.when(F.lower(around).rlike(rf"(?<![a-z])(?:{context})"), beside).otherwise(alone)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), score.cast("double").alias("score"))

        return F.filter(F.transform(places, scored), lambda x: x["score"] >= THRESHOLD)

    def cut(hits: Column) -> Column:
        return F.when(F.size(hits) == 0, none).otherwise(
            let(F.struct(hits.alias("hits"), F.split(text, pattern).alias("gaps")), placed)
        )

    likely = F.contains(text, F.lit(has)) if has else F.lit(True)
    return F.when(likely, let(matches, cut)).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the column ``out`` at the end: a struct with an array of spans for each kind; a column of that name is replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.struct(*[_spans(body, kind).alias(kind) for kind in KINDS])
    return docs.select(*[c for c in docs.columns if c.lower() != out.lower()], F.inline(F.array(F.struct(found.alias(out)))))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def all_spans(pii: str = "pii", kinds: tuple[str, ...] = KINDS) -> Column:
    """The spans of these kinds, by kind in that order, then by start."""
    return F.concat(*[F.col(f"{pii}.{kind}") for kind in kinds])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first is named, and the longest of those; the rest of the overlap goes with it.
    """
    columns = docs.columns
    found = with_spans(docs.select(F.struct(*columns).alias("doc"), F.col(text).alias("body")), "body")

    def replaced(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            begin = F.greatest(acc["at"], s["start"])
            gap = F.substring(F.col("body"), acc["at"] + 1, begin - acc["at"])
            name = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], F.array(gap, name)).alias("out"))

        done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("body"), acc["at"] + 1, F.length("body")))
        return F.aggregate(spans, start, step, done)

    by_start = F.transform(
        F.sort_array(F.transform(all_spans(), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("stop"), s["kind"].alias("kind")),
    )
    clean = F.when(F.size(all_spans()) == 0, F.col("body")).otherwise(let(by_start, replaced))
    return found.select(*[clean.alias(c) if c == text else F.col("doc")[c].alias(c) for c in columns])
