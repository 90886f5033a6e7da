"""Column-level reshaping: rename, select, move, split, conform, flatten."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import as_list, col, existing, parse_names, unique_names


def rename(df: DataFrame, mapping: Mapping[str, str], drop_unmapped: bool = False) -> DataFrame:
    """Rename columns; with ``drop_unmapped`` keep only the targets, in mapping order."""
    renamed = df.withColumnsRenamed({s: t for s, t in mapping.items() if s in df.columns})
    return renamed.select(*existing_columns(renamed, mapping.values())) if drop_unmapped else renamed


def existing_columns(df: DataFrame, names) -> list[Column]:
    return [col(n) for n in existing(df, names)]


def keep_columns(df: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Project to the existing ``names``; an empty list keeps every column."""
    return df.select(*existing_columns(df, names)) if names else df


def drop_columns(df: DataFrame, names: Sequence[str] | None) -> DataFrame:
    return df.drop(*existing(df, names or []))


def move_after(df: DataFrame, name: str | None, anchor: str | None) -> DataFrame:
    """Place column ``name`` directly after ``anchor``; no change if either is absent."""
    if name == anchor or name not in df.columns or anchor not in df.columns:
        return df
    rest = [c for c in df.columns if c != name]
    at = rest.index(anchor) + 1
    return df.select(*[col(c) for c in rest[:at] + [name] + rest[at:]])


def finish(df: DataFrame, drop: Sequence[str] | None, move: tuple[str, str] | None) -> DataFrame:
    """The common tail of the multi-table operators: drop columns, then move one."""
    return move_after(drop_columns(df, drop), *(move or (None, None)))


def prefix_columns(df: DataFrame, prefix: str, keys: Sequence[str] = ()) -> DataFrame:
    """Prefix every column except the keys."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def split_columns(df: DataFrame, keys: Sequence[str],
                  groups: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Vertical split: one frame per group, each with the keys and the group's columns.

    Absent columns are skipped. A frame without the keys comes back whole.
    """
    keys = as_list(keys)
    if len(existing(df, keys)) < len(keys):
        return {"unchanged": df}
    out = {}
    for label, names in groups.items():
        wanted = list(dict.fromkeys(keys + existing(df, names)))
        out[label] = df.select(*[col(n) for n in wanted])
    return out


def with_unique_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def conform(df: DataFrame, columns, keep: Sequence[str] = (),
            missing_type: str = "string") -> DataFrame:
    """Fit a frame to a column list: match names ignoring case and blanks, add missing
    columns as null, drop the rest; if no name matches, map by position. Columns in
    ``keep`` take no part in the matching and stay at the end."""
    wanted = parse_names(columns)
    if not wanted:
        return df
    df = with_unique_names(df)
    own = [c for c in df.columns if c not in keep]
    loose: dict[str, str] = {}
    for name in own:
        loose.setdefault(name.strip().lower(), name)
    source = {w: w if w in own else loose.get(w.strip().lower()) for w in wanted}
    if not any(source.values()):
        source = dict(zip(wanted, own))
    return df.select(*[
        (col(source[w]) if source.get(w) else F.lit(None).cast(missing_type)).alias(w)
        for w in wanted], *existing_columns(df, keep))


def tag_source(df: DataFrame, name: str, column: str = "source_file") -> DataFrame:
    return df.withColumn(column, F.lit(name))


def flatten(df: DataFrame) -> DataFrame:
    """Replace struct columns by their leaves under dotted names; arrays stay as they are."""
    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for field in schema.fields:
            here = path + (field.name,)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    def reach(path):
        c = col(path[0])
        for part in path[1:]:
            c = c.getField(part)
        return c.alias(".".join(path))

    return df.select(*[reach(p) for p in leaves(df.schema)])
