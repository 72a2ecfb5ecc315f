"""Facts from web pages ``(page_id, html)``."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def read_pages(spark, path: str) -> DataFrame:
    """Every ``.html`` file of a folder as one row."""
    return spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1).alias("page_id"), F.col("value").alias("html"))


def extract_motifs(pages: DataFrame, label: str = "Pattern:") -> DataFrame:
    """The cell after the label on each catalogue page: (name, regex)."""
    cell = F.regexp_extract("html", rf"(?s){label}.*?<td[^>]*>\s*(.*?)\s*</td>", 1)
    plain = F.regexp_replace(F.regexp_replace(cell, r"<[^>]*>", ""), "&nbsp;", "")
    return pages.select(F.col("page_id").alias("name"), F.trim(plain).alias("regex")).filter("regex <> ''")


def extract_hits(pages: DataFrame, name_pattern: str = r'<b>([A-Z]+_[A-Za-z0-9_]+)</b>', place_pattern: str = r"(\d+)-(\d+)") -> DataFrame:
    """Named hits on result pages: each name with the start-end pairs up to the next name. 0-based half-open."""
    blocks = F.regexp_extract_all("html", F.lit(rf"(?s)({name_pattern}(?:(?!{name_pattern}).)*)"), F.lit(1))
    rows = pages.select("page_id", F.explode(blocks).alias("block")).select(
        "page_id", F.regexp_extract("block", name_pattern, 1).alias("name"),
        F.explode(F.regexp_extract_all("block", F.lit(f"({place_pattern})"), F.lit(1))).alias("place"))
    return rows.select("page_id", "name", (F.regexp_extract("place", place_pattern, 1).cast("int") - 1).alias("start"),
                       F.regexp_extract("place", place_pattern, 2).cast("int").alias("end"))


class _Tables(HTMLParser):
    """Cells of all tables of a page; text of a cell that holds a table belongs to the inner one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells, self.open, self.count = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            if self.open:
                self.open[-1]["nested"] = True
            self.open.append({"id": self.count, "row": -1, "col": -1, "text": None, "nested": False})
            self.count += 1
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1].update(row=self.open[-1]["row"] + 1, col=-1)
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            t = self.open[-1]
            t.update(row=max(t["row"], 0), col=t["col"] + 1, text=[], nested=False)

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr"):
            self._close_cell()
        elif self.open and tag == "table":
            self._close_cell()
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["text"] is not None:
            self.open[-1]["text"].append(data)

    def _close_cell(self):
        t = self.open[-1]
        if t["text"] is not None:
            text = "" if t["nested"] else " ".join("".join(t["text"]).split())
            self.cells.append((t["id"], t["row"], t["col"], text))
            t["text"] = None


def extract_tables(pages: DataFrame) -> DataFrame:
    """Table cells of each page: (page_id, table, row, col, text)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                p = _Tables()
                p.feed(html or "")
                p.close()
                rows += [(page, *c) for c in p.cells]
            yield pd.DataFrame(rows, columns=["page_id", "table", "row", "col", "text"])

    return pages.select("page_id", "html").mapInPandas(parse, f"page_id {kind}, table int, row int, col int, text string")
