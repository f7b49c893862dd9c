"""Row predicates and labels of the ledger, each one column expression."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flags that ask for a review where no needs-column is known; fixed values.
REVIEW_FLAGS = "mixed_retail|fuel_or_convenience|purpose_unconfirmed|needs_category_review|subscription_or_digital_purchase|unresolved"


@dataclass(frozen=True)
class LedgerQuery:
    """What to look at: dates from start to end, both included, and every other filter."""

    start: date | str | None = None
    end: date | str | None = None
    category: str = "all"
    basis: str = "category"
    query: str = ""
    review: str = "all"
    kind: str = "all"
    airfare: bool = False
    business: bool = False

    def __post_init__(self):
        if self.basis not in ("category", "source_category"):
            raise ValueError("basis is category or source_category")


def flag(name: str) -> Column:
    return F.coalesce(F.array_contains("flags", name), F.lit(False))


def _true(df: DataFrame, name: str) -> Column:
    """A boolean column; false where it is null or absent."""
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def matches_review(df: DataFrame, mode: str) -> Column:
    """Whether a row belongs to a review mode; an unknown mode takes every row."""
    if mode == "dental":
        return F.coalesce(F.col("category") == "Dental", F.lit(False))
    if mode == "episode":
        return flag("nonroutine_dental_episode")
    if mode == "business":
        return flag("business_candidate")
    if mode == "changed":
        return flag("source_category_revised") | flag("classification_audit_changed") | _true(df, "classification_changed")
    if mode == "refund":
        return (F.col("kind") == "spend") & (F.col("amount_cents") < 0)
    if mode == "unresolved":
        needs = [c for c in ("needs_category_review", "needs_item_review", "needs_scope_review") if c in df.columns]
        weak = F.coalesce(F.col("confidence") == "provisional", F.lit(False)) if "confidence" in df.columns else F.lit(False)
        other = _true(df, "needs_review") | weak | F.coalesce(F.exists("flags", lambda f: f.rlike(f"(?i){REVIEW_FLAGS}")), F.lit(False))
        if not needs:
            return other
        asked = F.lit(False)
        for c in needs:
            asked |= F.coalesce(F.col(c), F.lit(False))
        return F.when(F.coalesce(*[F.col(c) for c in needs]).isNotNull(), asked).otherwise(other)
    return F.lit(True)


def matches_kind(kind: str) -> Column:
    """All, an exact kind, or "excluded": neither spending nor income."""
    if kind == "all":
        return F.lit(True)
    return ~F.col("kind").isin("spend", "income") if kind == "excluded" else F.col("kind") == kind


def matches_text(text: str) -> Column:
    """A case-blind substring of merchant, note and categories; null counts as empty."""
    whole = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("merchant", "note", "category", "source_category")])
    return F.contains(F.lower(whole), F.lit(text.lower()))


def removed(q: LedgerQuery) -> Column:
    """Rows that the adjustments take out."""
    out = F.lit(False)
    if q.airfare:
        out |= flag("reimbursement_candidate")
    if q.business:
        out |= flag("business_candidate")
    return out


def named(basis: str) -> Column:
    """The category shown: null and empty are Uncategorized."""
    return F.coalesce(F.when(F.col(basis) != "", F.col(basis)), F.lit("Uncategorized"))


def filtered(df: DataFrame, q: LedgerQuery) -> DataFrame:
    """The rows of all kinds that a query takes (its kind filter aside)."""
    if q.start is not None:
        df = df.filter(F.col("date") >= F.lit(q.start).cast("date"))
    if q.end is not None:
        df = df.filter(F.col("date") <= F.lit(q.end).cast("date"))
    if q.category != "all":
        df = df.filter(F.col(q.basis) == q.category)
    if q.query:
        df = df.filter(matches_text(q.query))
    return df if q.review == "all" else df.filter(matches_review(df, q.review))


def status(df: DataFrame, q: LedgerQuery) -> Column:
    """A row's status: the first that holds. Adjustments exclude spending alone."""
    return (
        F.when((F.col("kind") == "spend") & removed(q), "Scenario exclusion")
        .when(_true(df, "needs_category_review"), "Category unresolved")
        .when(matches_review(df, "unresolved"), "Items / use to review")
        .otherwise("Category supported")
    )


def signed_amount() -> Column:
    """The amount as shown: what isn't spending and goes out is negative."""
    return F.when((F.col("kind") != "spend") & (F.col("direction") == "outbound"), -F.col("amount_cents")).otherwise(F.col("amount_cents"))


def evidence_text(fallback: str = "") -> Column:
    """The evidence's summary, else the note, else a fixed text."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(F.col("evidence_summary")), filled(F.col("note")), F.lit(fallback))
