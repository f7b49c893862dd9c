"""Scalar rules of the ledger, as SQL text that Spark and DuckDB both read, and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST_AMOUNT = 1e8
#: Pay periods a year; fixed values.
FREQUENCIES = {"weekly": 52, "biweekly": 26, "semimonthly": 24, "monthly": 12}
#: Pay periods in an ordinary month; fixed values.
REGULAR = {"weekly": 4, "biweekly": 2, "semimonthly": 2, "monthly": 1}
_MONTH = re.compile(r"\d{4}-(0[1-9]|1[0-2])")


def js_round(x: str) -> str:
    """Nearest integer, ties upwards, as a bigint; null stays null."""
    return f"(CAST(floor({x}) AS BIGINT) + CASE WHEN ({x}) - floor({x}) >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END)"


def cents(x: str) -> str:
    """Dollars to cents without the range check; the smallest step above 1 keeps halves up."""
    return js_round(f"((CAST({x} AS DOUBLE) + CAST(2.220446049250313E-16 AS DOUBLE)) * CAST(100 AS DOUBLE))")


def checked_cents(x: str) -> str:
    """Dollars to cents in Spark; an amount that isn't from 0 to 1e8 raises."""
    wrong = f"isnan(CAST({x} AS DOUBLE)) OR CAST({x} AS DOUBLE) < 0 OR CAST({x} AS DOUBLE) > 1e8"
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN {wrong} THEN raise_error('amounts are from 0 to 100 million dollars') ELSE {cents(x)} END"


def multiplier(frequency: str, basis: str) -> str:
    """Paychecks a month: averaged over a year, or those of an ordinary month; null if unknown."""
    average = " ".join(f"WHEN {frequency} = '{k}' THEN CAST({n} AS DOUBLE) / CAST(12 AS DOUBLE)" for k, n in FREQUENCIES.items())
    regular = " ".join(f"WHEN {frequency} = '{k}' THEN CAST({n} AS DOUBLE)" for k, n in REGULAR.items())
    return f"CASE WHEN {basis} = 'average' THEN CASE {average} END ELSE CASE {regular} END END"


def month_index(m: str) -> int | None:
    """YYYY-MM as months since year 0; None for anything else."""
    if not m or not _MONTH.fullmatch(m):
        return None
    year, month = m.split("-")
    return int(year) * 12 + int(month) - 1


def month_from_index(i: int) -> str:
    return f"{i // 12}-{i % 12 + 1:02}"


def month_index_sql(m: str) -> str:
    """The same of a text column, in Spark."""
    return f"CASE WHEN {m} RLIKE '\\\\A[0-9]{{4}}-(0[1-9]|1[0-2])\\\\z' THEN CAST(substring({m}, 1, 4) AS INT) * 12 + CAST(substring({m}, 6, 2) AS INT) - 1 END"


def month_text(i: str) -> str:
    """A month index as text, in both engines."""
    return f"concat(CAST(CAST(floor({i} / 12) AS INT) AS STRING), '-', lpad(CAST({i} % 12 + 1 AS STRING), 2, '0'))"


def first_day(i: int) -> str:
    """The first day of a month, as an ISO date."""
    return f"{i // 12:04}-{i % 12 + 1:02}-01"


def money(c: Column, digits: int = 2) -> Column:
    """Cents as $#,##0.00; 'Not set' for null."""
    text = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs(c) / 100, digits))
    return F.when(c.isNull(), F.lit("Not set")).otherwise(text)


def month_label(d: Column) -> Column:
    """A date's month as in Jun 1998."""
    return F.date_format(d, "MMM yyyy")


def escape_html(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def percent_text(x: Column, digits: int = 1) -> Column:
    """A percentage with its sign, as in +4.2%."""
    return F.concat(F.when(x > 0, F.lit("+")).otherwise(F.lit("")), F.format_number(x, digits), F.lit("%"))


def pretty(c: Column) -> Column:
    """Underscores as spaces."""
    return F.replace(c, F.lit("_"), F.lit(" "))


def split_health(total: str, dental: str) -> str:
    """The medical part of a combined health target, in dollars (Spark); raises where dental exceeds it or either is unknown."""
    t, d = checked_cents(total), checked_cents(dental)
    return f"CASE WHEN ({t}) IS NULL OR ({d}) IS NULL OR ({d}) > ({t}) THEN raise_error('dental must be from zero to the combined target') ELSE (({t}) - ({d})) / CAST(100 AS DOUBLE) END"
