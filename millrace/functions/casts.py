"""Typed parsing of one text column; each parser gives null where it fails."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import strip

# The words read as true and false.
TRUE_WORDS = ("true", "yes", "1", "y", "t")
FALSE_WORDS = ("false", "no", "0", "n", "f")

# Strptime directives as Spark patterns, (free width, adjacent digits).
DIRECTIVES = {
    "Y": ("yyyy", "yyyy"), "y": ("yy", "yy"), "m": ("M", "MM"), "d": ("d", "dd"),
    "H": ("H", "HH"), "I": ("h", "hh"), "M": ("m", "mm"), "S": ("s", "ss"),
    "f": ("SSSSSS", "SSSSSS"), "p": ("a", "a"), "b": ("MMM", "MMM"), "B": ("MMMM", "MMMM"),
    "a": ("E", "E"), "A": ("EEEE", "EEEE"), "j": ("D", "DDD"),
}
NAMED = frozenset("bBaAp")
TIME = frozenset("HIMSfp")


def date_pattern(fmt: str) -> tuple[str, set[str]]:
    """Translate a strptime format; also returns the directives it uses."""
    tokens = re.findall(r"%(.)|([^%]+)", fmt)
    out, used = [], set()
    for i, (directive, literal) in enumerate(tokens):
        if literal or directive == "%":
            text = literal or "%"
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", text.replace("'", "''")))
            continue
        if directive not in DIRECTIVES:
            raise ValueError(f"unsupported date directive '%{directive}' in '{fmt}'")
        used.add(directive)
        beside = [tokens[j][0] for j in (i - 1, i + 1) if 0 <= j < len(tokens)]
        out.append(DIRECTIVES[directive][any(d and d not in NAMED for d in beside)])
    return "".join(out), used


def date_form(fmt: str) -> str:
    """A pattern that every readable text meets: digits, words and literals in their order."""
    out = []
    for directive, literal in re.findall(r"%(.)|([^%]+)", fmt):
        if literal or directive == "%":
            out.append(re.sub(r"([^\w\s])", r"\\\1", literal or "%"))
        else:
            part = r"[^0-9]+" if directive in NAMED else r"[+-]?[0-9]+"
            out += [part] if out[-1:] != [part] else []       # neighbours read as one run
    return f"(?i)^{''.join(out)}$"


# Checking the form first is far cheaper than letting a conversion fail.
WHOLE = r"^[+-]?[0-9]+$"
WHOLE_FORM = r"^[+-]?[0-9]+([.]0*)?$"
EXPONENT_FORM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)[eE][+-]?[0-9]+$"
NUMBER = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def to_float(text: Column) -> Column:
    """Number or null, from stripped text; ``nan`` is null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_integer(text: Column) -> Column:
    """Whole number or null, from stripped text; 12.0 and 1e3 are whole, 12.5 is not."""
    number = text.try_cast("double")
    return (F.when(text.rlike(WHOLE_FORM), F.substring_index(text, ".", 1).try_cast("bigint"))
            .when(text.rlike(EXPONENT_FORM), F.when(number % 1 == 0, number.try_cast("bigint"))))


def to_date(text: Column, fmt: str | None = None) -> Column:
    """Timestamp without time zone, or null; without a format ISO forms are read."""
    if not fmt:
        return text.try_cast("timestamp_ntz")
    pattern, used = date_pattern(fmt)
    if used & NAMED:
        text = F.upper(text) if used & NAMED == {"p"} else F.initcap(F.lower(text))
    if used & {"p"} and used & {"b", "B", "a", "A"}:
        text = F.regexp_replace(F.regexp_replace(text, r"\b[Aa]m\b", "AM"), r"\b[Pp]m\b", "PM")
    read = F.try_to_timestamp(text, F.lit(pattern)) if used & TIME else F.try_to_date(text, pattern)
    return F.when(text.rlike(date_form(fmt)), read.cast("timestamp_ntz"))


def to_boolean(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_text(c: Column) -> Column:
    text = strip(c)
    return F.when(text != "nan", text)


def without_currency(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[£$€,\s]", "")
