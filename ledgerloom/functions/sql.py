"""The ledger's rules as functions of SQL, for sessions that query its tables in plain SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerloom.functions.scalars import checked_cents, js_round, month_index_sql, month_text, multiplier

#: Name, parameters, result and body of each function; bodies are the rules of `scalars`.
FUNCTIONS = {
    "round_half_up": ("x DOUBLE", "BIGINT", js_round("x")),
    "dollars_to_cents": ("x DOUBLE", "BIGINT", checked_cents("x")),
    "paychecks_a_month": ("frequency STRING, basis STRING", "DOUBLE", multiplier("frequency", "basis")),
    "month_number": ("m STRING", "INT", month_index_sql("m")),
    "month_name": ("i INT", "STRING", month_text("i")),
    "needs_review": (
        "category BOOLEAN, item BOOLEAN, scope BOOLEAN, review BOOLEAN, confidence STRING, flags ARRAY<STRING>", "BOOLEAN",
        "CASE WHEN coalesce(category, item, scope) IS NOT NULL THEN coalesce(category, false) OR coalesce(item, false) OR coalesce(scope, false) ELSE coalesce(review, false) OR coalesce(confidence = 'provisional', false) "
        "OR coalesce(exists(flags, f -> f RLIKE '(?i)mixed_retail|fuel_or_convenience|purpose_unconfirmed|needs_category_review|subscription_or_digital_purchase|unresolved'), false) END",
    ),
}
#: The months of a period, both ends included, as rows; months are named as in 1998-06.
_SPAN = f"sequence({month_index_sql('since')}, {month_index_sql('until')})"
MONTHS = f"CREATE OR REPLACE TEMPORARY FUNCTION months_between_names(since STRING, until STRING) RETURNS TABLE (month_idx INT, month STRING) RETURN SELECT i, {month_text('i')} FROM (SELECT explode({_SPAN}) AS i)"


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, and say their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.sql(MONTHS)
    return [*FUNCTIONS, "months_between_names"]
