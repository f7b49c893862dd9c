"""Named periods as raw date bounds, which reach the scan, and what an average divides by."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from ledgerloom.functions.scalars import first_day, month_index


@dataclass(frozen=True)
class Period:
    """From start up to but without end, so months of any length are whole."""

    start: str
    end: str
    months: int
    label: str


def period(name: str, first: int, latest: int, baseline: tuple[int, int], months: int | None = None) -> Period:
    """quarter (the baseline), ytd, previousYear, all, or a month as YYYY-MM.

    first and latest: month numbers of the ledger; baseline: its first and last month;
    months: how many months the calendar has, where it has gaps.
    """
    year = latest // 12
    if name == "quarter":
        return Period(first_day(baseline[0]), first_day(baseline[1] + 1), baseline[1] - baseline[0] + 1, "Baseline period")
    if name == "ytd":
        return Period(first_day(year * 12), first_day(baseline[1] + 1), baseline[1] % 12 + 1, "Year to date")
    if name == "previousYear":
        return Period(first_day(year * 12 - 12), first_day(year * 12), 12, str(year - 1))
    if name == "all":
        return Period(first_day(first), first_day(latest + 1), months or latest - first + 1, "All available history")
    at = month_index(name)
    if at is None:
        raise ValueError("a period is quarter, ytd, previousYear, all or a month")
    return Period(first_day(at), first_day(at + 1), 1, f"{date(at // 12, at % 12 + 1, 1):%b %Y}")
