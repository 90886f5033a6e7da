"""Small frames, random frames and comparable rows."""

import math
import random


def clean(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    return v


def key(row):
    return tuple((v is not None, str(type(v).__name__ != "str"), str(v)) for v in row)


def norm(rows):
    return sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
                         for x in map(clean, r)) for r in rows), key=key)


def rows(df, *columns):
    """Sorted plain tuples of a Spark frame."""
    columns = columns or df.columns
    return norm(tuple(r[c] for c in columns) for r in df.collect())


def pandas_rows(pdf, *columns):
    columns = list(columns) or list(pdf.columns)
    return norm(pdf[columns].astype(object).itertuples(index=False, name=None))


def frame(spark, schema, data):
    return spark.createDataFrame(data, schema)


def random_rows(seed, n=60, keys=5, nulls=0.2):
    """(id, g, v, s): unique id, few groups, few values, some nulls; one group is hot."""
    r = random.Random(seed)

    def maybe(v):
        return None if r.random() < nulls else v

    return [(i, maybe("hot" if r.random() < 0.4 else f"g{r.randrange(keys)}"),
             maybe(float(r.randrange(8))), maybe(r.choice("abc"))) for i in range(n)]


SCHEMA = "id long, g string, v double, s string"


def is_null(v):
    return v is None or (isinstance(v, float) and math.isnan(v))
