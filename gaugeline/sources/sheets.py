"""Harmonising ragged sheets: ``page_id, row_no, cells ARRAY<STRING>`` to one typed-name table.

Nothing here assumes that a page is small. Per-page facts (year, header row, column positions)
are grouped aggregates with map-side combine, and the downward fill works on row ranges with a
carry between them, so a page that holds a large share of all rows is still spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    ANNUAL,
    FEATURES,
    HEADER_SYNONYMS,
    MONTHS,
    STATISTIC_SPELLINGS,
)
from .tables import write_table

TITLE_ROWS = 3
CHUNK_ROWS = 4096


def extract_page_key(sheets: DataFrame, pattern: str = r"Ano:\s*(\d{4})") -> DataFrame:
    """Year of each page from its first three rows; pages without one are left out."""
    hit = F.filter("cells", lambda c: F.coalesce(c.rlike(pattern), F.lit(False)))
    return (
        sheets.filter(F.col("row_no") < TITLE_ROWS)
        .select("page_id", "row_no", F.regexp_extract(F.get(hit, 0), pattern, 1).alias("year"))
        .filter(F.col("year") != "")
        .groupBy("page_id")
        .agg(F.min_by("year", "row_no").cast("int").alias("year"))
    )


def locate_header(sheets: DataFrame, marker: str = "COR") -> DataFrame:
    """First row of each page with a cell that contains ``marker``, and its cells."""
    return (
        sheets.filter(F.exists("cells", lambda c: F.coalesce(c.contains(marker), F.lit(False))))
        .groupBy("page_id")
        .agg(
            F.min("row_no").alias("header_row"),
            F.min_by("cells", "row_no").alias("header_cells"),
        )
    )


def normalize_header(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def map_headers(headers: DataFrame, synonyms: dict[str, str] = HEADER_SYNONYMS) -> DataFrame:
    """Position of every known column per page; the first of duplicates wins."""
    lookup = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return (
        headers.select("page_id", F.posexplode("header_cells").alias("position", "cell"))
        .select("page_id", "position", F.try_element_at(lookup, normalize_header("cell")).alias("variable"))
        .filter(F.col("variable").isNotNull())
        .groupBy("page_id", "variable")
        .agg(F.min("position").alias("position"))
    )


def strip(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_stat(c: Column, spellings: dict[str, str] = STATISTIC_SPELLINGS) -> Column:
    """Canonical statistic label, tolerant to lost or broken accents."""
    lookup = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return F.try_element_at(lookup, F.regexp_replace(F.lower(strip(c)), "[^a-z.]", ""))


def fill_down_period(
    rows: DataFrame,
    periods: Sequence[str] = (*MONTHS, ANNUAL),
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``period``: the last period name seen in column 0 at or above each row of the page."""
    first = strip(F.get("cells", 0))
    tagged = rows.withColumns(
        {
            "_seen": F.when(first.isin(list(periods)), first),
            "_chunk": F.floor(F.col("row_no") / chunk_rows),
        }
    )
    chunk_last = tagged.groupBy("page_id", "_chunk").agg(
        F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("row_no"))).alias("_tail")
    )
    before = Window.partitionBy("page_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunk_last.withColumn("_carry", F.last("_tail", ignorenulls=True).over(before)).drop("_tail")
    within = Window.partitionBy("page_id", "_chunk").orderBy("row_no")
    return (
        tagged.withColumn("_own", F.last("_seen", ignorenulls=True).over(within))
        .join(carry, ["page_id", "_chunk"], "left")
        .withColumn("period", F.coalesce("_own", "_carry"))
        .drop("_seen", "_chunk", "_own", "_carry")
    )


def harmonise_sheets(
    sheets: DataFrame,
    *,
    features: Sequence[str] = FEATURES,
    synonyms: dict[str, str] = HEADER_SYNONYMS,
    spellings: dict[str, str] = STATISTIC_SPELLINGS,
    periods: Sequence[str] = (*MONTHS, ANNUAL),
    marker: str = "COR",
    key_pattern: str = r"Ano:\s*(\d{4})",
    seen: Observation | None = None,
) -> DataFrame:
    """All pages as one table ``page_id, row_no, year, period, stat`` plus text per feature.

    Pages without year or header are skipped, blank rows and rows without period or statistic
    are dropped, unknown headers are ignored, absent cells become empty text. ``seen`` gets the numbers
    of ``pages`` and of those skipped for their year or header, from the job that uses the table.
    """
    headers = locate_header(sheets, marker)
    # At most one entry per known column, so the collected map is bounded by ``synonyms``.
    positions = (
        map_headers(headers, synonyms)
        .groupBy("page_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("variable", "position"))).alias("at"))
    )
    years, rows = extract_page_key(sheets, key_pattern), headers.select("page_id", "header_row")
    if seen is None:
        pages = years.join(rows, "page_id")
    else:
        every = sheets.select("page_id").distinct().join(years, "page_id", "left").join(rows, "page_id", "left")
        lost, headless = F.col("year").isNull(), F.col("year").isNotNull() & F.col("header_row").isNull()
        every = every.observe(
            seen, F.count(F.lit(1)).alias("pages"), F.count_if(lost).alias("without_year"), F.count_if(headless).alias("without_header")
        )
        pages = every.filter(~lost & ~headless)
    pages = pages.join(positions, "page_id", "left")
    body = (
        sheets.join(pages, "page_id")
        .filter(F.col("row_no") > F.col("header_row"))
        .filter(F.exists("cells", lambda c: F.coalesce(strip(c) != "", F.lit(False))))
    )
    filled = fill_down_period(body, periods).withColumn(
        "stat", normalize_stat(F.get("cells", 1), spellings)
    )

    def cell(variable: str) -> Column:
        position = F.try_element_at("at", F.lit(variable))
        return F.coalesce(strip(F.get("cells", position)), F.lit("")).alias(variable)

    return filled.filter(F.col("stat").isNotNull() & F.col("period").isNotNull()).select(
        "page_id", "row_no", "year", "period", "stat", *[cell(v) for v in features]
    )


@dataclass(frozen=True)
class Union:
    """Where a union of pages was written, and what the write counted."""

    location: str
    rows: int
    pages: int
    without_year: int
    without_header: int


def union_sheets(sheets: DataFrame, name: str, directory: str, **how) -> Union:
    """Write all pages as one table; the row count and the skipped pages come out of the write itself, with no second job."""
    seen, written = Observation(), Observation()
    table = harmonise_sheets(sheets, seen=seen, **how).observe(written, F.count(F.lit(1)).alias("rows"))
    location = write_table(table, name, directory)
    pages = seen.get
    return Union(location, written.get["rows"], pages["pages"], pages["without_year"], pages["without_header"])
