"""Small column functions: quality formulas and probabilities, parts of headers, colour space."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z]\w*)|(\*\*|[-+*/^()]))")
#: Functions that a formula may use; log is the natural one, as ln.
_FUNCTIONS = {"ln": F.ln, "log": F.ln, "log10": F.log10, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs}


def formula(text: str, x: Column) -> Column:
    """The value of ``f(x) = ...``: numbers, x, + - * / ^ (or **), parentheses and ln, log, log10, exp, sqrt, abs.

    The text is parsed, never evaluated; anything else in it is a ValueError.
    """
    body = re.sub(r"^\s*f\s*\(\s*x\s*\)\s*=", "", text).strip()
    tokens, at = [], 0
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise ValueError(f"cannot read {body[at:]!r} in a formula")
        tokens.append(m.group(m.lastindex))
        at = m.end()
    tokens.append("")
    place = 0

    def take(*wanted: str) -> str:
        nonlocal place
        if wanted and tokens[place] not in wanted:
            raise ValueError(f"{' or '.join(wanted)} wanted at {tokens[place] or 'the end'!r}")
        place += 1
        return tokens[place - 1]

    def total() -> Column:
        out = product()
        while tokens[place] in ("+", "-"):
            out = out + product() if take() == "+" else out - product()
        return out

    def product() -> Column:
        out = signed()
        while tokens[place] in ("*", "/"):
            out = out * signed() if take() == "*" else out / signed()
        return out

    def signed() -> Column:
        if tokens[place] in ("+", "-"):
            return -signed() if take() == "-" else signed()
        base = value()
        if tokens[place] in ("^", "**"):
            take()
            return F.pow(base, signed())
        return base

    def value() -> Column:
        word = take()
        if word == "(":
            out = total()
            take(")")
            return out
        if word == "x":
            return x.cast("double")
        if word in _FUNCTIONS:
            take("(")
            out = _FUNCTIONS[word](total())
            take(")")
            return out
        try:
            return F.lit(float(word))
        except ValueError:
            raise ValueError(f"{word or 'the end'!r} is not known in a formula") from None

    out = total()
    take("")
    return out


#: The curve that stands in where no formula can be evaluated.
LOG_CURVE = "f(x) = 1 + 62 * ln(x + 1) / ln(63)"


def phred_to_probability(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / 10.0)


def probability_to_phred(p: Column) -> Column:
    """The nearest whole quality; null for probabilities that are not above 0."""
    return F.when(p > 0, F.floor(-10 * F.log10(p) + 0.5).cast("int"))


def with_length(header: Column, seq: Column) -> Column:
    return F.concat(header, F.lit(" length="), F.length(seq).cast("string"))


def pair_number(header: Column) -> Column:
    """A struct (header, pair): ``/1`` or ``/2`` at the end taken off; pair is null and the header whole without it."""
    found = F.regexp_extract(header, "^(?s)(.*)/([12])$", 2)
    return F.struct(F.when(found == "", header).otherwise(F.substring(header, F.lit(1), F.length(header) - 2)).alias("header"), F.when(found != "", found.cast("int")).alias("pair"))


def flagged(header: Column) -> Column:
    """Whether the filter flag of a header is set: ``:Y:`` beyond its first letter."""
    return F.instr(header, ":Y:") > 1


def colour_bases(colours: Column) -> Column:
    """Bases of a colour-space read: a first base, not part of the result, then a digit per base.

    With A, C, G, T as 0 to 3, a digit is the exclusive or of two neighbours; from a sign that is not 0 to 3 on, all is N.
    """
    signs = F.split(F.substring(colours, F.lit(2), F.length(colours)), "")
    start = F.struct((F.instr(F.lit("ACGT"), F.upper(F.substring(colours, 1, 1))) - 1).cast("int").alias("base"), F.lit("").alias("out"))

    def step(state: Column, sign: Column) -> Column:
        base = F.when((state["base"] >= 0) & sign.rlike("^[0-3]$"), state["base"].bitwiseXOR(sign.cast("int"))).otherwise(F.lit(-1))
        return F.struct(base.alias("base"), F.concat(state["out"], F.when(base >= 0, F.substring(F.lit("ACGT"), base + 1, F.lit(1))).otherwise("N")).alias("out"))

    return F.aggregate(F.filter(signs, lambda s: s != ""), start, step, lambda s: s["out"])
