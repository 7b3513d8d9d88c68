"""Rows of a printed catalogue's pages as records: headers and blank rows go, fragments join the record that they go on."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.reconcile import FIELDS

#: Words that a title doesn't end with (fixed values).
CONNECTORS = ("a", "an", "and", "applied", "de", "des", "du", "et", "for", "in", "la", "le", "les", "of", "or", "the", "to", "un", "une")
_CONNECTOR = re.compile(rf"(?i)\b({'|'.join(CONNECTORS)})$")
_YEAR = re.compile(r"\b(18|19|20)\d{2}\b")
RECORD = "document long, " + ", ".join(f"{c} string" for c in FIELDS) + ", source_pages array<int>, page int, row int"


def header() -> Column:
    return (F.col("author") == "Author") & (F.col("title") == "Title")


def blank() -> Column:
    return F.concat_ws("", *FIELDS) == ""


def goes_on(row: dict, before: dict) -> bool:
    """Whether a page's first row is a fragment of the record before it: it has no number and no year, and one of the seven cues."""
    if row["isbn"] or row["publication_year"]:
        return False
    title = before["title"]
    cues = (row["author"] == "", row["title"] == "", row["author"].lstrip().startswith("|"), before["author"].rstrip().endswith("|"), not _YEAR.search(before["publication_date"]))
    return any(cues) or bool(_CONNECTOR.search(title.rstrip(" ,;:-"))) or title.count("(") > title.count(")")


def records(rows: DataFrame) -> DataFrame:
    """The records of documents' rows (document, page, row, the eight fields), with the pages that they stand on; the place is that of their first row.

    Cells are cleaned first. Only a page's raw first row can be a fragment, and it is held against the record as merged so far, so a document is passed in order: one document is one task.
    """
    fields = [text.clean_cell(F.col(c)).alias(c) if c in rows.columns else F.lit("").alias(c) for c in FIELDS]
    kept = rows.select("document", "page", "row", *fields).filter(~header() & ~blank())

    def stitch(p: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in p.sort_values(["page", "row"]).to_dict("records"):
            if r["row"] == 0 and out and goes_on(r, out[-1]):
                last = out[-1]
                last.update({c: f"{last[c].strip()} {r[c].strip()}".strip() for c in FIELDS if r[c].strip()})
                last["source_pages"] = sorted({*last["source_pages"], r["page"]})
            else:
                out.append(r | {"source_pages": [r["page"]]})
        return pd.DataFrame(out, columns=[x.split()[0] for x in RECORD.split(", ")])

    return kept.groupBy("document").applyInPandas(stitch, RECORD)
