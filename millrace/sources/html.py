"""Tables in HTML documents."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import col, unique_names
from ..operators.union import union
from ..session import ship
from .files import listing, open_file, per_file
from .inference import blank_to_null, infer_types


class _Tables(HTMLParser):
    """Collects the cells of every table; a nested table is a table of its own.

    A cell is a list of text parts; one that spans columns or rows stands in each of them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list[str]]]] = []
        self._open: list[dict] = []

    def _carried(self, state: dict) -> None:
        """Put cells that reach down from rows above at the end of the current row."""
        row = state["rows"][-1]
        while len(row) in state["down"]:
            at = len(row)
            cell, left = state["down"].pop(at)
            row.append(cell)
            if left > 1:
                state["below"][at] = (cell, left - 1)

    def _end_row(self, state: dict) -> None:
        if state["rows"]:
            self._carried(state)
        state.update(cell=None, down=state["down"] | state["below"], below={})

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self._open.append({"rows": self.tables[-1], "cell": None, "down": {}, "below": {}})
        elif self._open and tag == "tr":
            self._end_row(self._open[-1])
            self._open[-1]["rows"].append([])
        elif self._open and tag in ("td", "th"):
            state = self._open[-1]
            if not state["rows"]:
                state["rows"].append([])
            self._carried(state)
            spans = dict(attrs)
            across, down = (int(v) if (v := spans.get(k) or "").isdigit() and int(v) > 0 else 1
                            for k in ("colspan", "rowspan"))
            cell: list[str] = []
            for _ in range(across):
                if down > 1:
                    state["below"][len(state["rows"][-1])] = (cell, down - 1)
                state["rows"][-1].append(cell)
            state["cell"] = cell

    def handle_endtag(self, tag):
        if self._open and tag == "table":
            self._end_row(self._open[-1])
            self._open.pop()
        elif self._open and tag in ("td", "th", "tr"):
            self._open[-1]["cell"] = None

    def handle_data(self, data):
        if self._open and self._open[-1]["cell"] is not None:
            self._open[-1]["cell"].append(data)


def parse_tables(html: str) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [[[" ".join("".join(cell).split()) for cell in row] for row in table if row]
            for table in parser.tables]


def html_rows(pages: DataFrame, html_column: str, id_column: str) -> DataFrame:
    """(id, table_no, row_no, cells) for every row of every table of every page."""
    import pandas as pd

    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [(doc, t, r, cells)
                    for doc, html in zip(batch["__id"], batch["__html"])
                    for t, table in enumerate(parse_tables(html))
                    for r, cells in enumerate(table)]
            if rows:
                yield pd.DataFrame(rows, columns=["__id", "table_no", "row_no", "cells"])

    dtype = dict(pages.dtypes)[id_column]
    out = pages.select(col(id_column).alias("__id"), col(html_column).alias("__html")).mapInPandas(
        run, f"__id {dtype}, table_no int, row_no int, cells array<string>")
    return out.withColumnRenamed("__id", id_column)


def html_cells(pages: DataFrame, html_column: str, id_column: str) -> DataFrame:
    """(id, table_no, row_no, col_no, text) for every cell."""
    return html_rows(pages, html_column, id_column).select(
        col(id_column), "table_no", "row_no", F.posexplode("cells").alias("col_no", "text"))


def _first_table(path: str):
    with open_file(path) as fh:
        raw = fh.read()
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("cp1252", "replace")
    tables = parse_tables(text)
    head, *body = tables[0] if tables and tables[0] else [[]]
    if head:
        width = max(map(len, [head, *body]))
        head = head + [""] * (width - len(head))
        yield head, []
    for cells in body:
        yield head, cells


def read_html(spark: SparkSession, path, infer: bool = True,
              source_column: str | None = None) -> DataFrame:
    """First table of each HTML file, stacked by column name.

    Each file's first row names its columns; a row that is longer gives unnamed columns.
    """
    rows = per_file(listing(spark, path), _first_table, "head array<string>, cells array<string>")
    heads = [r["head"] for r in rows.select("head").distinct().orderBy("head").collect()]
    if not heads:
        raise ValueError(f"no table found at {path}")
    file = F.element_at(F.split("path", "/"), -1)
    tag = [file.alias(source_column)] if source_column else []
    parts = []
    for head in heads:
        names = unique_names([h or f"Unnamed: {i}" for i, h in enumerate(head)])
        same = rows.filter((F.col("head") == F.array(*map(F.lit, head))) & (F.size("cells") > 0))
        parts.append(same.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)],
                                 *tag))
    body = blank_to_null(parts[0] if len(parts) == 1 else union(parts))
    return infer_types(body) if infer else body
