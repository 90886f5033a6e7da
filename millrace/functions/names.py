"""Column references and column-name rules."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def col(name: str) -> Column:
    """Reference a column by its literal name, dots and spaces included."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_list(value: str | Sequence[str] | None) -> list[str]:
    if value is None or value == "":
        return []
    return [value] if isinstance(value, str) else list(value)


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def require(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"{what} {missing} not found; available columns: {df.columns}")


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in which no key is null; unlike ``dropna`` this reaches the scan."""
    for k in keys:
        df = df.filter(col(k).isNotNull())
    return df


def unused(df: DataFrame, stem: str) -> str:
    """A helper column name that does not collide with the frame's own."""
    name = f"__{stem}"
    while name in df.columns:
        name = "_" + name
    return name


def unique_names(names: Sequence[str]) -> list[str]:
    """Number repeated names: ``a, a, a`` becomes ``a, a.1, a.2``; numbers in use are passed over."""
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(i)
    out, taken = list(names), set(places)
    for name, (_, *repeats) in places.items():
        numbered = (f"{name}.{n}" for n in itertools.count(1))
        free = (candidate for candidate in numbered if candidate not in taken)
        for i, candidate in zip(repeats, free):
            out[i] = candidate
        taken.update(out[i] for i in repeats)
    return out


# A list of names: quoted as in JSON, or bare up to the next comma.
_NAME = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|([^,]*?))\s*(?:,|$)')
_BRACKETED = re.compile(r'\s*\[\s*(".*")?\s*\]\s*', re.DOTALL)


def parse_names(value: str | Sequence[str] | None) -> list[str] | None:
    """The names of a list, of ``"a,b"`` or of ``'["a","b"]'``; None if there is none."""
    if isinstance(value, str):
        inner = _BRACKETED.fullmatch(value)
        items = _NAME.findall((inner[1] or "") if inner else value)
        value = [json.loads(quoted) if quoted else bare for quoted, bare in items]
    if value is not None and not isinstance(value, (list, tuple)):
        raise TypeError(f"names are a list or a text, not {type(value).__name__}")
    stripped = (str(name).strip() for name in value or ())
    return list(filter(None, stripped)) or None
