"""Totals from decoded sheets and document text.

A sheet is ``sheet_id, row_idx, cells: array<string>``; a document page is
``doc_id, page, text`` with the whole page text. Many sheets or documents are read in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasyspark.functions.names import clean_ws
from dasyspark.functions.numbers import to_float_lenient
from dasyspark.operators.joins import last_by

HEADER_ROWS = 6
TABLE_HEADER_ROWS = 12
MIN_HEADER_LABELS = 5
LABEL_WINDOW = 600
# Fixed patterns.
YEAR_PATTERN = r"(\d{4}-\d{2})"
ROW_PATTERN = (
    r"^\s*(\d{1,3})?\s*([A-Za-z][A-Za-z.\s'()\-]*?)\s+([\d,]+(?:\.\d+)?(?:\s+[\d,]+(?:\.\d+)?)*)\s*$"
)
QUOTE_PATTERN = r"([\d,]{4,})\s*Crore in (\d{4}-\d{2})"


def _meet(rows: DataFrame, found: DataFrame, sheet: str, how: str = "inner") -> DataFrame:
    """Join of what was found of each sheet. Sizes are guessed from files whose cells are not written yet, so neither side is broadcast on a guess."""
    return rows.join(found.hint("merge"), sheet, how)


def _missed(marks: DataFrame, reasons: Sequence[str], sheet: str) -> DataFrame:
    """``sheet, reason`` of the sheets that miss a step; a mark ``_s`` is the number of steps that a row shows to be reached.

    One aggregate over all marks: nothing is joined, so nothing can be broadcast.
    """
    first = F.get(F.array(*[F.lit(r) for r in reasons]), F.max("_s"))
    return marks.groupBy(sheet).agg(first.alias("reason")).where("reason IS NOT NULL")


def _matrix_header(rows: DataFrame, sheet: str) -> DataFrame:
    """``sheet, _h`` (row_idx, cells): among the first rows the one with most short text labels from the third column on."""
    first_rows = F.col("row_idx") < HEADER_ROWS
    tail = F.slice("cells", F.lit(3), F.greatest(F.size("cells") - 2, F.lit(0)))
    # A cell with any non-digit is text; whitespace is only collapsed where that could matter.
    is_label = lambda c: c.rlike(r"[^\s\d.\-]") & (
        (F.length(c) <= 40) | (F.length(clean_ws(c)) <= 40)
    )
    labels = F.when(first_rows, F.size(F.filter(tail, is_label))).otherwise(0)
    early = rows.where(first_rows).withColumn("_n", labels).where(F.col("_n") >= MIN_HEADER_LABELS)
    return early.groupBy(sheet).agg(
        F.max_by(F.struct("row_idx", "cells"), F.struct(F.col("_n"), -F.col("row_idx"))).alias("_h")
    )


def _matrix_rows(rows: DataFrame, row_label: str, sheet: str) -> DataFrame:
    """``sheet, _label, _cells`` of all sheets with a header, which is looked for once.

    The row of values is the last one below the header whose second cell holds the label; without one
    both are null. ``_cells`` pairs header (n) and values (y) from the third column on.
    """
    header = _matrix_header(rows, sheet)
    labelled = rows.where(F.contains(F.lower(clean_ws(F.get("cells", F.lit(1)))), F.lit(row_label.lower())))
    met = _meet(labelled.select(sheet, "row_idx", "cells"), header, sheet, "right")
    below = F.when(F.col("row_idx") > F.col("_h.row_idx"), F.col("row_idx"))
    found = met.groupBy(sheet).agg(F.first("_h.cells").alias("_names"), F.max_by("cells", below).alias("_values"))
    tail = lambda c: F.slice(c, F.lit(3), F.greatest(F.size(c) - 2, F.lit(0)))
    label = F.when(F.col("_values").isNotNull(), clean_ws(F.get("_values", F.lit(1))))
    return found.select(sheet, label.alias("_label"), F.arrays_zip(tail("_names").alias("n"), tail("_values").alias("y")).alias("_cells"))


def _counts(pair: Column | dict[str, Column], drop_names: Sequence[str]) -> Column:
    """Whether a cleaned pair is a total of a unit."""
    low = F.lower(pair["n"])
    kept = (pair["n"] != "") & ~F.contains(low, F.lit("region")) & (pair["y"] > 0)
    return kept & ~low.isin(*[d.lower() for d in drop_names]) if drop_names else kept


def matrix_to_long(
    rows: DataFrame, row_label: str, drop_names: Sequence[str] = (), value_scale: float = 1.0, sheet: str = "sheet_id"
) -> DataFrame:
    """Totals of sheets with the units across.

    The header and the row of values are found by aggregates; only those two rows are
    widened. Sheets that yield nothing are told by ``unreadable_matrices``.
    """
    # Names and amounts are cleaned as arrays, once, and only then widened together.
    clean = F.transform("_cells", lambda p: F.struct(clean_ws(p["n"]).alias("n"), (to_float_lenient(p["y"]) * F.lit(value_scale)).alias("y")))
    # Outer, since a plain explode has all pairs made a first time to see whether there are any.
    wide = _matrix_rows(rows, row_label, sheet).select(sheet, "_label", F.explode_outer(clean).alias("_p"))
    return wide.where(_counts(F.col("_p"), drop_names)).select(
        sheet, F.col("_p.n").alias("district"), F.col("_p.y").alias("y_crore"),
        F.concat("_p.n", F.lit(" — "), F.col("_label")).alias("source_name"),
    )


def unreadable_matrices(rows: DataFrame, row_label: str, drop_names: Sequence[str] = (), sheet: str = "sheet_id") -> DataFrame:
    """``sheet, reason`` of sheets that ``matrix_to_long`` reads nothing from: no_header, no_value_row or no_values."""
    # The first pair that counts settles it.
    read = F.exists("_cells", lambda p: _counts({"n": clean_ws(p["n"]), "y": to_float_lenient(p["y"])}, drop_names))
    step = F.when(F.col("_label").isNull(), 1).when(read, 3).otherwise(2)
    marks = rows.select(sheet, F.lit(0).alias("_s")).unionByName(_matrix_rows(rows, row_label, sheet).select(sheet, step.alias("_s")))
    return _missed(marks, ["no_header", "no_value_row", "no_values"], sheet)


def _table_header(rows: DataFrame, name_label: str, value_label: str, sheet: str) -> DataFrame:
    """``sheet, _h`` (row_idx, places of both labels): the first row that holds both."""
    cleaned = F.transform("cells", lambda c: F.lower(clean_ws(c)))
    at_name = F.array_position(cleaned, clean_label(name_label))
    at_value = F.array_position(cleaned, clean_label(value_label))
    heads = rows.where(F.col("row_idx") < TABLE_HEADER_ROWS).select(
        sheet, "row_idx", at_name.alias("_name"), at_value.alias("_value")
    ).where((F.col("_name") > 0) & (F.col("_value") > 0))
    return heads.groupBy(sheet).agg(F.min(F.struct("row_idx", "_name", "_value")).alias("_h"))


def headed_table(
    rows: DataFrame, name_label: str, value_label: str, drop_names: Sequence[str] = (), value_scale: float = 1.0,
    sheet: str = "sheet_id",
) -> DataFrame:
    """Totals of sheets with the units down, below the first row that holds both labels.

    ``source_name`` is the label of the value column. Sheets that yield nothing are told by
    ``unreadable_tables``.
    """
    header = _table_header(rows, name_label, value_label, sheet)
    below = _meet(rows, header, sheet).where(F.col("row_idx") > F.col("_h.row_idx"))
    name = clean_ws(F.try_element_at("cells", F.col("_h._name").cast("int")))
    value = to_float_lenient(F.try_element_at("cells", F.col("_h._value").cast("int"))) * F.lit(value_scale)
    kept = below.select(sheet, "row_idx", name.alias("district"), value.alias("y_crore"), F.lit(value_label).alias("source_name")).where(
        (F.col("district") != "") & (F.col("y_crore") > 0)
    )
    return kept.where(~F.lower("district").isin(*[d.lower() for d in drop_names])) if drop_names else kept


def unreadable_tables(
    rows: DataFrame, name_label: str, value_label: str, drop_names: Sequence[str] = (), sheet: str = "sheet_id"
) -> DataFrame:
    """``sheet, reason`` of sheets that ``headed_table`` reads nothing from: no_header or no_values."""
    marks = rows.select(sheet, F.lit(0).alias("_s"))
    header = _table_header(rows, name_label, value_label, sheet)
    read = headed_table(rows, name_label, value_label, drop_names, 1.0, sheet)
    for step, reached in ((1, header), (2, read)):
        marks = marks.unionByName(reached.select(sheet, F.lit(step).alias("_s")))
    return _missed(marks, ["no_header", "no_values"], sheet)


def clean_label(text: str) -> str:
    return " ".join(text.split()).lower()


def text_line_table(
    pages: DataFrame, caption: str, year: str, drop_names: Sequence[str] = (), value_scale: float = 1.0
) -> DataFrame:
    """Rows ``[n] name value value ...`` of pages that hold the caption; the last of a name wins.

    ``pages``: doc_id, page, text (the whole page). The year columns of a page
    come from its first line with two or more years.
    """
    lines = F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")
    years = F.filter(
        F.transform(lines, lambda t: F.regexp_extract_all(t, F.lit(YEAR_PATTERN), F.lit(1))), lambda y: F.size(y) >= 2
    )
    captioned = pages.where(F.contains(F.lower(clean_ws(F.col("text"))), F.lit(clean_label(caption))))
    dated = (
        captioned.select("doc_id", "page", lines.alias("_lines"), F.try_element_at(years, F.lit(1)).alias("_years"))
        .withColumn("_col", F.array_position("_years", year).cast("int"))
        .where(F.col("_col") > 0)
    )
    rows = dated.select("doc_id", "page", "_years", "_col", F.posexplode("_lines").alias("line", "_text")).where(
        F.col("_text").rlike(ROW_PATTERN)
    )
    split = rows.select(
        "doc_id", "page", "line", "_years", "_col",
        clean_ws(F.regexp_extract("_text", ROW_PATTERN, 2)).alias("district"),
        F.split(F.trim(F.regexp_extract("_text", ROW_PATTERN, 3)), r"\s+").alias("_nums"),
    ).where(F.size("_nums") == F.size("_years"))
    value = to_float_lenient(F.try_element_at("_nums", F.col("_col"))) * F.lit(value_scale)
    kept = split.select("doc_id", "page", "line", "district", value.alias("y_crore")).where(
        (F.length("district") >= 3) & (F.col("y_crore") > 0)
    )
    if drop_names:
        kept = kept.where(~F.lower("district").isin(*[d.lower() for d in drop_names]))
    last = last_by(F.struct("district", "y_crore"), "page", "line").alias("_r")
    return kept.groupBy("doc_id", F.lower("district").alias("_key")).agg(last).select("doc_id", "_r.*")


def labelled_value(pages: DataFrame, label: str, basis: str, year: str, value_scale: float = 1.0) -> DataFrame:
    """The amount quoted for ``year`` within a window after the label; the first page with one wins.

    ``pages``: doc_id, page, text (the whole page). There is no fallback value.
    """
    flat = clean_ws(F.col("text"))
    low = F.lower(flat)
    at = F.instr(low, label.lower())
    hits = pages.select("doc_id", "page", flat.alias("_flat"), low.alias("_low"), at.alias("_at")).where(
        (F.col("_at") > 0) & F.contains("_low", F.lit(basis))
    )
    window = F.substr("_flat", F.col("_at"), F.lit(LABEL_WINDOW))
    amounts = F.regexp_extract_all(window, F.lit(QUOTE_PATTERN), F.lit(1))
    years = F.regexp_extract_all(window, F.lit(QUOTE_PATTERN), F.lit(2))
    amount = F.try_element_at(amounts, F.nullif(F.array_position(years, year), F.lit(0)).cast("int"))
    valued = hits.select("doc_id", "page", to_float_lenient(amount).alias("_y")).where(F.col("_y") != 0)
    first = F.min(F.struct("page", "_y")).alias("_f")
    return valued.groupBy("doc_id").agg(first).select(
        "doc_id", F.col("_f.page").alias("page"), (F.col("_f._y") * F.lit(value_scale)).alias("y_crore")
    )
