"""DuckDB SQL of the ledger's queries, written apart from their DataFrame code.

Only the rounding and paycheck rules of `scalars` and the derived scenarios' fields, which
are SQL text for both engines, are shared.
"""

from __future__ import annotations

from ledgerloom.functions.scalars import cents, js_round, multiplier
from ledgerloom.scenarios import DEBT_END, EMBEDDED_SQL, FIELD_SQL, FORECAST_SQL, ONCE_AMOUNT, ONCE_MONTH, SAVED_SQL, TARGET_SQL

JUNE = 1998 * 12 + 5
QUARTER = f"month_idx BETWEEN {JUNE - 2} AND {JUNE}"
SUM = "CAST(coalesce(sum(amount_cents), 0) AS BIGINT)"

LEDGER = """ledger AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS id, CAST(l_shipdate AS DATE) AS date, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS month_idx,
         l_linestatus AS source, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
         l_discount >= CAST(0.1 AS DOUBLE) AS reimbursement, l_tax >= CAST(0.08 AS DOUBLE) AS business, l_quantity >= 49 AS episode, l_quantity <= 2 AS revised,
         CASE WHEN l_returnflag = 'R' THEN 'inbound' ELSE 'outbound' END AS direction,
         CASE WHEN l_tax < CAST(0.01 AS DOUBLE) THEN 'provisional' WHEN l_tax < CAST(0.04 AS DOUBLE) THEN 'medium' ELSE 'high' END AS confidence,
         l_tax < CAST(0.005 AS DOUBLE) AS open_category, l_discount < CAST(0.01 AS DOUBLE) AS open_item, l_quantity <= 1 AS reclassified,
         CASE WHEN l_quantity <= 3 THEN 'receipt' ELSE 'synthetic_fixture' END AS evidence_basis,
         s_name AS merchant, p_type AS category, p_brand AS source_category, c_mktsegment AS note,
         CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'card_payment' WHEN '5-LOW' THEN 'income' ELSE 'spend' END AS kind,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'observed_payroll_deposit' END AS income_type
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
       LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey
), own AS (SELECT * FROM ledger WHERE kind = 'spend'),
months AS (SELECT DISTINCT month_idx, month_idx % 7 <> 0 AS covered FROM ledger)"""

ORACLES: dict[str, str] = {}


def _add(name: str, body: str) -> None:
    ORACLES[name] = f"WITH {LEDGER}\n{body}"


def _name(basis: str) -> str:
    return f"coalesce(nullif({basis}, ''), 'Uncategorized')"


def _if(condition: str) -> str:
    return f"CAST(coalesce(sum(amount_cents) FILTER (WHERE {condition}), 0) AS BIGINT)"


def _money(c: str, digits: int = 2) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'Not set' ELSE concat(CASE WHEN {c} < 0 THEN '-' ELSE '' END, '$', format('{{:,.{digits}f}}', abs({c}) / CAST(100 AS DOUBLE))) END"


# ---- totals, searches and reviews


def _by(basis: str, where: str = "true") -> str:
    return f"SELECT {_name(basis)} AS category, {SUM} AS total_cents, count(*) AS rows FROM own WHERE {where} GROUP BY 1"


def _summary(gone: str, where: str = "true") -> str:
    return f"SELECT count(*) AS rows, {_if("kind = 'spend'")} AS spending_cents, {_if(f"kind = 'spend' AND NOT ({gone})")} AS adjusted_cents, {_if(f"kind = 'spend' AND ({gone})")} AS adjustment_cents FROM ledger WHERE {where}"


def _listed(where: str) -> str:
    return f"SELECT category, count(*) AS rows, {SUM} AS total_cents FROM ledger WHERE {where} GROUP BY category"


def _has(text: str) -> str:
    return f"contains(lower(concat_ws(' ', coalesce(merchant, ''), coalesce(note, ''), coalesce(category, ''), coalesce(source_category, ''))), '{text}')"


_add("totals_by_category", _by("category", f"month_idx = {JUNE}"))
_add("totals_by_source_category", _by("source_category"))
_add("totals_adjusted", _by("category", "NOT reimbursement AND NOT business"))
_add("totals_summary", _summary("reimbursement OR business"))
_add("totals_refunds", _by("category", "amount_cents < 0"))
_add("search_merchant", _summary("false", _has("machinery")))
_add("search_counters", f"SELECT count(*) AS rows, count(*) FILTER (WHERE open_category OR open_item) AS unresolved, count(*) FILTER (WHERE revised OR reclassified) AS changed FROM own WHERE {_has('brand#1')}")
_add("review_unresolved", _listed("open_category OR open_item"))
_add("review_unresolved_fallback", _listed("confidence = 'provisional'"))
_add("review_changed", _listed("revised OR reclassified"))
_add("review_episode", _listed("episode"))
_add("review_business", _listed("business"))
_add("kind_excluded", f"SELECT kind, count(*) AS rows, {SUM} AS total_cents FROM ledger WHERE kind NOT IN ('spend', 'income') GROUP BY kind")
_add(
    "review_modes",
    """SELECT count(*) FILTER (WHERE category = 'Dental') AS dental, count(*) FILTER (WHERE episode) AS episode, count(*) FILTER (WHERE open_category OR open_item) AS unresolved,
    count(*) FILTER (WHERE revised OR reclassified) AS changed, count(*) FILTER (WHERE business) AS business, count(*) FILTER (WHERE kind = 'spend' AND amount_cents < 0) AS refund, count(*) AS "all" FROM ledger""",
)
_add(
    "ledger_page",
    f"""SELECT id, date, merchant, category, kind, amount_cents FROM (
      SELECT *, row_number() OVER (ORDER BY date DESC, id, merchant, category, kind, amount_cents) - 1 AS place, greatest(1, (count(*) OVER () + 29) // 30) AS pages FROM ledger WHERE month_idx = {JUNE}
    ) WHERE place // 30 = least(3, pages) - 1""",
)
_add(
    "ledger_last_page",
    """SELECT id, date, merchant, category, kind, amount_cents FROM (
      SELECT *, row_number() OVER (ORDER BY date DESC, id, merchant, category, kind, amount_cents) - 1 AS place, count(*) OVER () AS n FROM ledger
    ) WHERE place >= ((n - 1) // 30) * 30""",
)
_add(
    "status_counts",
    """SELECT CASE WHEN kind = 'spend' AND reimbursement THEN 'Scenario exclusion' WHEN open_category THEN 'Category unresolved' WHEN open_item THEN 'Items / use to review' ELSE 'Category supported' END AS status, count(*) AS rows
    FROM ledger GROUP BY 1""",
)
_add(
    "display_rows",
    f"""SELECT *, {_money("shown_cents")} AS shown_text FROM (
      SELECT replace(kind, '_', ' ') AS kind, CASE source WHEN 'O' THEN 'Open lines' WHEN 'F' THEN 'Filled lines' ELSE source END AS source, coalesce(nullif(note, ''), 'No evidence') AS evidence,
             strftime(date, '%b %Y') AS month, count(*) AS rows, CAST(sum(CASE WHEN kind <> 'spend' AND direction = 'outbound' THEN -amount_cents ELSE amount_cents END) AS BIGINT) AS shown_cents
      FROM ledger WHERE month_idx = {JUNE} GROUP BY ALL)""",
)
_add("money_texts", f"SELECT category, {_money('total_cents')} AS total, {_money('average', 0)} AS average, '1998-06' AS month FROM (SELECT *, {js_round('(CAST(total_cents AS DOUBLE) / rows)')} AS average FROM ({_by('category', f'month_idx = {JUNE}')}))")

# ---- sums, groups and ranks

_add("kind_sums", "SELECT " + ", ".join(f"{_if(f"kind = '{k}'")} AS {k}_cents" for k in ("card_payment", "transfer", "investment", "debt_payment")) + f" FROM ledger WHERE {QUARTER}")
_FLAGS = {"reimbursement_candidate": "reimbursement", "business_candidate": "business", "nonroutine_dental_episode": "episode"}
_add("flag_sums", "SELECT " + ", ".join(f"{_if(c)} AS {f}_cents" for f, c in _FLAGS.items()) + f" FROM own WHERE {QUARTER}")
_add("adjustment_potentials", "SELECT " + ", ".join(f"{_if(c)} AS {f}_cents" for f, c in list(_FLAGS.items())[:2]) + f" FROM own WHERE month_idx = {JUNE}")
_add(
    "payroll_summary",
    f"SELECT *, {js_round('(CAST(spending_cents AS DOUBLE) / 3)')} AS average_cents FROM (SELECT {_if("kind = 'income' AND income_type = 'observed_payroll_deposit'")} AS payroll_cents, {_if("kind = 'spend'")} AS spending_cents FROM ledger WHERE {QUARTER})",
)
_add(
    "merchant_groups",
    f"""SELECT category, CAST(sum(total_cents) OVER c AS BIGINT) AS category_cents, CAST(sum(rows) OVER c AS BIGINT) AS category_rows, merchant, total_cents, rows, review_rows,
           CAST(row_number() OVER (PARTITION BY category ORDER BY total_cents DESC, merchant) AS INTEGER) AS place
    FROM (SELECT {_name("category")} AS category, merchant, {SUM} AS total_cents, count(*) AS rows, count(*) FILTER (WHERE open_category OR open_item) AS review_rows FROM own GROUP BY 1, 2)
    WINDOW c AS (PARTITION BY category)""",
)
_add(
    "category_grouping_sets",
    f"SELECT c AS category, merchant, CAST(grouping(merchant) AS INTEGER) AS is_total, {SUM} AS total_cents, count(*) AS rows FROM (SELECT *, {_name('category')} AS c FROM own) GROUP BY GROUPING SETS ((c), (c, merchant))",
)
_add("month_drill", f"SELECT month_idx, {SUM} AS total_cents, count(*) AS rows FROM own WHERE NOT business GROUP BY month_idx")
_add(
    "top_n_other",
    f"""SELECT CASE WHEN place <= 6 THEN category ELSE 'All other categories' END AS category, CAST(sum(total_cents) AS BIGINT) AS total_cents
    FROM (SELECT *, row_number() OVER (ORDER BY total_cents DESC, category) AS place FROM ({_by("source_category")}) WHERE total_cents <> 0) GROUP BY 1""",
)


def _share(rows: str) -> str:
    share = "greatest(CAST(0 AS DOUBLE), least(CAST(1000 AS DOUBLE), CAST(total_cents AS DOUBLE) * 1000 / largest))"
    return f"SELECT category, total_cents, {js_round(share)} AS share_permille FROM (SELECT category, total_cents, greatest(max(abs(total_cents)) OVER (), 1) AS largest FROM ({rows}))"


_add("share_of_max", _share(_by("source_category")))
_add("trend_heights", _share(f"SELECT CAST(month_idx AS VARCHAR) AS category, {SUM} AS total_cents FROM own GROUP BY 1"))
_add("unresolved_merchants", f"SELECT merchant, count(*) AS rows, {SUM} AS total_cents FROM own WHERE open_category GROUP BY merchant")
_add("category_list", "SELECT DISTINCT source_category AS category FROM own")
_add(
    "category_set_difference",
    """, a AS (SELECT DISTINCT merchant AS value FROM ledger WHERE date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30'),
    b AS (SELECT DISTINCT merchant AS value FROM own WHERE amount_cents < 0 AND date BETWEEN DATE '1998-05-01' AND DATE '1998-05-31')
    SELECT value, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT value, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)

# ---- rollups

_MEASURES = {
    "spending_cents": "kind = 'spend'",
    "payroll_cents": "kind = 'income'",
    "debt_payments_cents": "kind = 'debt_payment'",
    "investment_cents": "kind = 'investment'",
    "card_repayments_cents": "kind = 'card_payment'",
    "card_purchases_cents": "kind = 'spend' AND source = 'F' AND amount_cents > 0",
    "direct_spend_cents": "kind = 'spend' AND source = 'O'",
    "transfers_cents": "kind = 'transfer'",
}
_add("monthly_rollup", "SELECT month_idx, count(*) AS transaction_count, " + ", ".join(f"{_if(c)} AS {n}" for n, c in _MEASURES.items()) + f", -{_if("kind = 'spend' AND amount_cents < 0")} AS refunds_cents FROM ledger GROUP BY month_idx")
_add(
    "monthly_map_totals",
    f"""SELECT month_idx, {_if("kind = 'spend'")} AS spending_cents, CAST(sum(amount_cents) FILTER (WHERE kind = 'spend') AS BIGINT) AS categories_cents,
      CAST(nullif(count(DISTINCT {_name("category")}) FILTER (WHERE kind = 'spend'), 0) AS INTEGER) AS categories, CAST(sum(amount_cents) FILTER (WHERE kind = 'spend') AS BIGINT) AS source_categories_cents
    FROM ledger GROUP BY month_idx""",
)
_add(
    "quarter_rollup",
    f"""SELECT *, CAST(round_even(spending_cents / CAST(3 AS DOUBLE), 0) AS BIGINT) AS average_cents, spending_cents - reimbursement_cents AS less_reimbursement_cents FROM (
      SELECT {_if("kind = 'spend'")} AS spending_cents, {_if(_MEASURES["card_purchases_cents"])} AS card_purchases_cents, -{_if("kind = 'spend' AND amount_cents < 0")} AS refunds_cents,
             {_if(_MEASURES["direct_spend_cents"])} AS direct_spend_cents, {_if("kind = 'debt_payment'")} AS debt_excluded_cents, {_if("kind = 'spend' AND reimbursement")} AS reimbursement_cents,
             {_if("kind = 'spend' AND episode")} AS episode_cents, {_if(f"kind = 'spend' AND episode AND month_idx = {JUNE}")} AS last_month_episode_cents
      FROM ledger WHERE {QUARTER})""",
)
_add(
    "overview",
    f"""SELECT *, {js_round("(CAST(spending_cents AS DOUBLE) / 3)")} AS average_cents, {js_round("(CAST(spending_cents - episode_cents AS DOUBLE) / 3)")} AS average_without_cents FROM (
      SELECT {_if("category = 'ECONOMY'")} AS category_cents, count(*) FILTER (WHERE category = 'ECONOMY') AS category_rows, {_if("category = 'ECONOMY' AND episode")} AS episode_cents, {_if("true")} AS spending_cents FROM own WHERE {QUARTER})""",
)
_add("source_rollup", 'SELECT source, count(*) AS rows, (SELECT min(date) FROM ledger) AS start, (SELECT max(date) FROM ledger) AS "end" FROM ledger GROUP BY source')
_add(
    "audit_counts",
    """SELECT count(*) AS all_rows, count(*) FILTER (WHERE kind = 'spend') AS expense_rows, count(DISTINCT merchant) FILTER (WHERE kind = 'spend') AS expense_merchants, count(*) FILTER (WHERE kind <> 'spend') AS other_rows,
    min(date) AS earliest, max(date) AS latest, count(*) FILTER (WHERE kind = 'spend' AND reclassified) AS changed_rows, count(DISTINCT merchant) FILTER (WHERE kind = 'spend' AND reclassified) AS changed_merchants FROM ledger""",
)
_add(
    "merchants_by_year",
    "SELECT CAST(month_idx // 12 AS INTEGER) AS months, count(DISTINCT merchant) AS merchants, count(DISTINCT merchant) FILTER (WHERE reclassified) AS changed_merchants FROM own GROUP BY 1",
)
_add("confidence_counts", "SELECT confidence, count(*) AS rows FROM own GROUP BY confidence")
_add("changed_row_ids", "SELECT id FROM ledger WHERE reclassified")
_add(
    "ytd_vs_prior",
    f"""SELECT *, CASE WHEN prior_cents > 0 THEN {js_round("((CAST(now_cents AS DOUBLE) / CAST(prior_cents AS DOUBLE) - 1) * 10000)")} END AS change_bp FROM (
      SELECT {_if("month_idx BETWEEN 23976 AND 23981")} AS now_cents, {_if("month_idx BETWEEN 23964 AND 23969")} AS prior_cents FROM own)""",
)
_add(
    "target_join",
    f"""SELECT key, label, cat, CASE WHEN cat IS NOT NULL THEN {js_round("(CAST(coalesce(total, 0) AS DOUBLE) / 3)")} END AS observed_cents
    FROM (VALUES ('economy', 'Economy', 'ECONOMY'), ('standard', 'Standard', 'STANDARD'), ('promo', 'Promo', 'PROMO'), ('missing', 'Missing', 'MISSING'), ('none', 'None', NULL)) d(key, label, cat)
    LEFT JOIN (SELECT category, sum(amount_cents) AS total FROM own WHERE {QUARTER} GROUP BY category) t ON cat = category""",
)
_CHECKS = {
    "ids_with_repeats": "(SELECT count(*) FROM (SELECT id FROM ledger GROUP BY id HAVING count(*) > 1)), 0",
    "merchants_without_prefix": "(SELECT count(*) FROM ledger WHERE NOT starts_with(coalesce(merchant, ''), 'Supplier')), 0",
    "amounts_missing": "(SELECT count(*) FROM ledger WHERE amount_cents IS NULL), 0",
    "rows_of_known_sources": "(SELECT count(*) FROM ledger WHERE source IN ('O', 'F')), (SELECT count(*) FROM ledger)",
    "sources_seen": "(SELECT count(DISTINCT source) FROM ledger), 2",
    "months_that_differ": "0, 0",
    "kinds_of_ledger": "(SELECT count(DISTINCT kind) FROM ledger), 3",
    "has_refund": "(SELECT max(CAST(amount_cents < 0 AS INTEGER)) FROM own), 1",
    "has_review_row": "(SELECT max(CAST(open_category OR open_item AS INTEGER)) FROM ledger), 1",
    "has_reimbursement": "(SELECT max(CAST(reimbursement AS INTEGER)) FROM ledger), 1",
    "has_business": "(SELECT max(CAST(business AS INTEGER)) FROM ledger), 1",
    "evidence_of_other_basis": "(SELECT count(*) FROM ledger WHERE evidence_basis <> 'synthetic_fixture'), 0",
    "baseline_spending": f"(SELECT {SUM} FROM own WHERE {QUARTER}), (SELECT {SUM} FROM own WHERE {QUARTER})",
    "baseline_categories": f"(SELECT {SUM} FROM own WHERE {QUARTER}), (SELECT {SUM} FROM own WHERE {QUARTER})",
    "baseline_episode": f"(SELECT {SUM} FROM ledger WHERE episode AND {QUARTER}), (SELECT {SUM} FROM ledger WHERE episode AND {QUARTER})",
    "month_maps_that_differ": "0, 0",
    "has_incomplete_month": "(SELECT max(CAST(NOT covered AS INTEGER)) FROM months), 1",
}
_add(
    "dq_checks",
    'SELECT "check", observed = expected AS passed, CAST(observed AS BIGINT) AS observed, CAST(expected AS BIGINT) AS expected FROM (VALUES '
    + ", ".join(f"('{n}', {v})" for n, v in _CHECKS.items())
    + ') t("check", observed, expected)',
)

# ---- comparison with the usual

_BAND = "greatest(CAST(10000 AS DOUBLE), average_cents * CAST(0.25 AS DOUBLE))"


def _window(lookback: int, where: str = "true") -> str:
    """The spending of the month and of its covered months before, and how many these are."""
    return f""", base AS (SELECT month_idx FROM months WHERE covered AND month_idx BETWEEN {JUNE - lookback} AND {JUNE - 1}),
    n AS (SELECT count(*) AS n FROM base),
    used AS (SELECT * FROM own WHERE {where} AND (month_idx = {JUNE} OR month_idx IN (SELECT month_idx FROM base)))"""


def _compared(lookback: int) -> tuple[str, str]:
    """The CTEs of a comparison, and its rows."""
    return (
        f"""{_window(lookback)}, sums AS (SELECT {_name("category")} AS category, {_if(f"month_idx = {JUNE}")} AS actual_cents, {_if(f"month_idx < {JUNE}")} AS base_cents FROM used GROUP BY 1),
    usual AS (SELECT category, actual_cents, CASE WHEN n > 0 THEN {js_round("(CAST(base_cents AS DOUBLE) / CASE WHEN n > 0 THEN n END)")} END AS average_cents FROM sums, n),
    diff AS (SELECT *, actual_cents - average_cents AS difference_cents, category IN ('Electricity', 'Natural gas', 'Electric', 'Gas & Fuel') AS seasonal FROM usual)""",
        f"""SELECT category, actual_cents, average_cents, difference_cents, CASE WHEN average_cents > 0 THEN {js_round("(CAST(difference_cents AS DOUBLE) / average_cents * 10000)")} END AS percent_bp,
      CASE WHEN average_cents IS NULL THEN 'No baseline' WHEN average_cents = 0 AND actual_cents > 0 THEN 'New in this window' WHEN average_cents = 0 AND actual_cents < 0 THEN 'Refund / credit'
           WHEN average_cents = 0 THEN 'No spending' WHEN average_cents < 0 THEN 'Refund-heavy baseline' WHEN difference_cents > {_BAND} AND seasonal THEN 'Seasonal comparison'
           WHEN difference_cents > {_BAND} THEN 'Higher than usual' WHEN difference_cents < -{_BAND} THEN 'Lower than usual' ELSE 'Within comparison band' END AS signal, seasonal
    FROM diff""",
    )


for _n in (3, 6, 12):
    _add(f"compare_{_n}m", "\n".join(_compared(_n)))
ORACLES["kept_compare"] = ORACLES["compare_12m"]
_add(
    "document_round_trip",
    """SELECT l.month_idx, covered, category, kind, count(*) AS rows, CAST(sum(amount_cents) AS BIGINT) AS total_cents, count(DISTINCT merchant) AS merchants,
      CAST(sum(CAST(reimbursement AS INTEGER) + CAST(business AS INTEGER) + CAST(episode AS INTEGER) + CAST(revised AS INTEGER)) AS BIGINT) AS flags
    FROM ledger l JOIN months m ON l.month_idx = m.month_idx GROUP BY ALL""",
)
_add(
    "kept_monthly",
    "SELECT month_idx, count(*) AS transaction_count, " + ", ".join(f"{_if(c)} AS {n}" for n, c in _MEASURES.items()) + f""", -{_if("kind = 'spend' AND amount_cents < 0")} AS refunds_cents,
    CAST(sum(amount_cents) FILTER (WHERE kind = 'spend') AS BIGINT) AS categories_cents FROM ledger GROUP BY month_idx""",
)
_add(
    "compare_summary",
    f"""{_window(12, "NOT reimbursement")}
    SELECT CAST({JUNE} AS INTEGER) AS month_idx, CAST(n AS INTEGER) AS coverage_count, EXISTS (SELECT 1 FROM months WHERE month_idx = {JUNE} AND covered) AS selected_covered, actual_cents,
           CASE WHEN n > 0 THEN {js_round("(CAST(base_cents AS DOUBLE) / CASE WHEN n > 0 THEN n END)")} END AS average_cents
    FROM n, (SELECT {_if(f"month_idx = {JUNE}")} AS actual_cents, {_if(f"month_idx < {JUNE}")} AS base_cents FROM used)""",
)
_add(
    "usual_all_months",
    f""", by_month AS (SELECT {_name("category")} AS category, month_idx, sum(amount_cents) AS cents FROM own GROUP BY 1, 2),
    grid AS (SELECT category, month_idx FROM (SELECT DISTINCT category FROM by_month), months),
    past AS (SELECT g.category, g.month_idx, m.month_idx AS before FROM grid g LEFT JOIN months m ON m.covered AND m.month_idx BETWEEN g.month_idx - 12 AND g.month_idx - 1),
    sums AS (SELECT p.category, p.month_idx, count(p.before) AS months, coalesce(sum(b.cents), 0) AS base_cents FROM past p LEFT JOIN by_month b ON b.category = p.category AND b.month_idx = p.before GROUP BY 1, 2)
    SELECT s.category, s.month_idx, CAST(coalesce(b.cents, 0) AS BIGINT) AS actual_cents, months,
           CASE WHEN months > 0 THEN {js_round("(CAST(base_cents AS DOUBLE) / CASE WHEN months > 0 THEN months END)")} END AS average_cents
    FROM sums s LEFT JOIN by_month b ON b.category = s.category AND b.month_idx = s.month_idx""",
)
_add("incomplete_coverage_badge", f"SELECT count(*) FILTER (WHERE NOT covered) AS incomplete_months, coalesce(bool_or(NOT covered), false) AS incomplete FROM months WHERE month_idx BETWEEN {JUNE - 11} AND {JUNE}")
_add("coverage_calendar", "SELECT month_idx, covered, concat(month_idx // 12, '-', lpad(CAST(month_idx % 12 + 1 AS VARCHAR), 2, '0')) AS month FROM months")

# ---- drill-downs, reviews and texts

_add(
    "drill_rows",
    f"""SELECT {_name("category")} AS category, merchant, date, id, amount_cents, CASE WHEN amount_cents < 0 THEN 'Refund' ELSE '' END AS mark, episode AS nonroutine,
    coalesce(nullif(note, ''), 'Category follows the supplied source label. Item contents are not available.') AS evidence, coalesce(nullif(confidence, ''), 'Unreviewed') AS confidence
    FROM own WHERE {QUARTER} ORDER BY 1, 2, 3 DESC, 4""",
)
_add("baseline_categories", f"SELECT {_name('category')} AS category, {SUM} AS total_cents FROM own WHERE {QUARTER} GROUP BY 1 ORDER BY 1")
_add("category_in_month", f"SELECT {_if(f"category = 'ECONOMY' AND month_idx = {JUNE}")} AS category_month_cents FROM ledger")
ORACLES["recurring_candidates"] = f"""SELECT p_name AS label, p_brand AS basis, CASE WHEN p_size % 2 = 0 THEN 'recurring candidate' ELSE 'synthetic' END AS status, p_size % 2 = 0 AS to_review,
    {_money(js_round("(p_retailprice * 100)"))} AS monthly FROM part"""
_add(
    "coverage_notes",
    """SELECT CASE source WHEN 'O' THEN 'Open lines' WHEN 'F' THEN 'Filled lines' ELSE source END AS label,
    concat(CAST((SELECT min(date) FROM ledger) AS VARCHAR), ' to ', CAST((SELECT max(date) FROM ledger) AS VARCHAR), ' · ', format('{:,}', count(*)), ' records · Posted dates') AS note FROM ledger GROUP BY source""",
)


def _percent(c: str, digits: int) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN concat(CASE WHEN {c} > 0 THEN '+' ELSE '' END, format('{{:,.{digits}f}}', {c}), '%') END"


_add(
    "percent_texts",
    f"""SELECT category, {_percent("change", 0)} AS change, {_percent("change", 1)} AS change_exact FROM (
      SELECT category, CASE WHEN prior > 0 THEN (CAST(now AS DOUBLE) / prior - 1) * 100 END AS change FROM (
        SELECT category, {_if(f"month_idx = {JUNE}")} AS now, {_if(f"month_idx = {JUNE - 1}")} AS prior FROM own WHERE month_idx BETWEEN {JUNE - 1} AND {JUNE} GROUP BY category))""",
)
_add(
    "compare_targets",
    f"""{_compared(3)[0]} SELECT category, actual_cents, average_cents, signal,
      CASE WHEN category IN ('PROMO', 'SMALL') THEN 'Shared health target' WHEN t.cat IS NOT NULL THEN {_money("t.cents")} ELSE '—' END AS target,
      category = 'ECONOMY' AND (SELECT coalesce(bool_or(episode), false) FROM ledger WHERE month_idx = {JUNE}) AS episode
    FROM ({_compared(3)[1]}) c LEFT JOIN (VALUES ('ECONOMY', 250000), ('STANDARD', NULL), ('PROMO', 100)) t(cat, cents) ON t.cat = c.category""",
)

ORACLES["events_by_day"] = f"SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, CAST(sum({js_round('(value * 100)')}) AS BIGINT) AS value_cents FROM events GROUP BY 1, 2"
ORACLES["event_sessions"] = f"""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events, CAST(sum({js_round('(value * 100)')}) AS BIGINT) AS value_cents FROM (
  SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events)
) GROUP BY user_id, number"""

# ---- plans and projections

#: Labels of the scenarios' targets, in order.
_LABELS = {
    "mortgage": "Mortgage", "groceries": "Groceries & meal kits", "medical": "Medical & pharmacy", "dental": "Dental reserve", "storeCard": "Store-card debt payment",
    "vehicleA": "Person A vehicle payment", "student": "Education-loan payment", "vehicleB": "Person B vehicle payment",
}
_SCOPE = {"dental": "health_mode <> 'combined'", "vehicleA": "whole", "student": "whole", "vehicleB": "(whole OR vehicle_b_funding = 'joint')"}
_TEXTS = ("plan_mode", "health_mode", "income_basis", "vehicle_b_funding", "person_a_frequency", "person_b_frequency")
_MONEY = [f for f in FIELD_SQL if f not in _TEXTS and f != "scenario_id"]


def _month(c: str) -> str:
    return f"CASE WHEN length({c}) = 7 THEN CAST(substr({c}, 1, 4) AS INTEGER) * 12 + CAST(substr({c}, 6, 2) AS INTEGER) - 1 END"


def _known(c: str) -> str:
    return f"coalesce({c}, 0)"


_EXPENSE = " + ".join(f"CASE WHEN {_SCOPE.get(k, 'true')} THEN {_known(f't_{k}')} ELSE 0 END" for k in _LABELS)
_MISSING = [
    ("whole AND a_income IS NULL", "Person A pay frequency"),
    ("whole AND (person_b_pay IS NULL OR b_times IS NULL)", "Person B full take-home and frequency"),
    ("NOT whole AND (person_a_pay IS NULL OR person_a_allocation IS NULL OR person_b_contribution IS NULL)", "Joint contribution amounts"),
    ("NOT whole AND person_b_contribution IS NOT NULL AND person_a_allocation > person_a_pay", "Personal allocation exceeds take-home"),
    ("NOT whole AND vehicle_b_funding = 'unknown'", "Which account funds Person B’s vehicle payment"),
    ("whole AND allocation IS NULL", "Personal allocation monthly total"),
]
_BLANK = [(f"{_SCOPE.get(k, 'true')} AND t_{k} IS NULL", label) for k, label in _LABELS.items()]
_MORE = [
    ("other_expenses IS NULL", "Other missing household expenses"),
    ("childcare IS NULL", "Childcare"),
    ("baby_costs IS NULL", "Other baby costs"),
    ("home_fund IS NULL", "Home-repair savings"),
    ("emergency_fund IS NULL", "Cash-cushion savings"),
    ("anniversary_fund IS NULL", "Anniversary savings"),
]
_LATER = [
    ("current_cash IS NULL", "Starting available cash"),
    (f"{_known('baby_costs')} > 0 AND baby_idx IS NULL", "Baby-cost start month"),
    (f"{_known('childcare')} > 0 AND childcare_idx IS NULL", "Childcare start month"),
    ("NOT whole AND known_times IS NULL", "Person A’s actual pay frequency"),
    ("leave_months > 0 AND leave_reduction IS NULL", "Monthly leave-income reduction"),
    ("reduction > 0 AND leave_months > 0 AND leave_idx IS NULL", "Leave-income reduction start month"),
    ("once > 0 AND once_idx IS NULL", "Home repair month"),
    ("once_idx IS NOT NULL AND once IS NULL", "Home repair amount"),
]


def _labels(pairs: list) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{label}' END" for c, label in pairs) + ")"


def _count(pairs: list) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in pairs) + " AS INTEGER)"


PLANS = f"""given AS (SELECT c_custkey AS k, c_acctbal FROM customer),
inputs AS (
  SELECT {", ".join(f"{FIELD_SQL[f]} AS {f}" for f in ("scenario_id", *_TEXTS))}, {FIELD_SQL["plan_mode"]} <> 'joint' AS whole,
         {", ".join(f"{cents(FIELD_SQL[f])} AS {f}" for f in _MONEY)}, {", ".join(f"{cents(v)} AS t_{k}" for k, v in TARGET_SQL.items())},
         {", ".join(f"{_month(f'({FORECAST_SQL[f]})')} AS {f.replace('_start', '_idx')}" for f in ("baby_start", "childcare_start", "leave_start"))},
         {_month(f"({ONCE_MONTH})")} AS once_idx, {cents(ONCE_AMOUNT)} AS once, {_month(f"({DEBT_END})")} AS debt_idx,
         {", ".join(f"CAST({FORECAST_SQL[f]} AS DOUBLE) / CAST(100 AS DOUBLE) AS {f}" for f in ("income_growth", "expense_growth", "cash_yield"))},
         {FORECAST_SQL["months"]} AS horizon, {FORECAST_SQL["leave_months"]} AS leave_months, {2031 * 12 + 9} AS start_idx
  FROM given
), paid AS (
  SELECT *, {multiplier("person_a_frequency", "income_basis")} AS known_times, {multiplier("person_b_frequency", "income_basis")} AS b_times FROM inputs
), timed AS (
  SELECT *, CASE WHEN known_times IS NULL AND NOT whole THEN CAST(2 AS DOUBLE) ELSE known_times END AS a_times, {_known("t_vehicleA")} + {_known("t_student")} AS personal_debt FROM paid
), earned AS (
  SELECT *, {js_round("(person_a_pay * a_times)")} AS a_income, CASE WHEN whole THEN {js_round("(person_b_pay * b_times)")} END AS b_income, {js_round("(person_a_allocation * a_times)")} AS allocation,
         {js_round("((person_a_pay - person_a_allocation) * a_times)")} AS a_joint FROM timed
), shared AS (
  SELECT *, greatest(0, allocation - personal_debt) AS own_allowance, CASE WHEN allocation IS NOT NULL THEN greatest(0, personal_debt - allocation) ELSE 0 END AS allocation_deficit,
         CASE WHEN whole THEN a_income + b_income + {_known("other_income")} WHEN person_a_allocation <= person_a_pay THEN a_joint + person_b_contribution + {_known("other_income")} END AS income,
         {_known("childcare")} + {_known("baby_costs")} AS baby, {_known("home_fund")} + {_known("emergency_fund")} + {_known("anniversary_fund")} + {_known("other_savings")} AS savings,
         {_known("leave_reduction")} AS reduction FROM earned
), spent AS (
  SELECT *, CASE WHEN allocation IS NOT NULL THEN own_allowance END AS allowance FROM shared
), plans AS (
  SELECT *, {_EXPENSE} + CASE WHEN whole THEN {_known("allowance")} ELSE 0 END + {_known("other_expenses")} AS expense FROM spent
), rooms AS (
  SELECT *, income - expense - savings AS current_room, income - expense - savings - baby - reduction AS future_room FROM plans
)"""

for _mode in ("household", "joint"):
    ORACLES[f"plan_{_mode}"] = f"""WITH {PLANS}
    SELECT scenario_id, income, a_income AS person_a_income, b_income AS person_b_income, expense, personal_debt, allocation, allowance, allocation_deficit, baby, savings, reduction, current_room, future_room,
           {_count(_MISSING)} AS missing_count, {_labels([*_MISSING, *_BLANK, *_MORE])} AS incomplete
    FROM rooms WHERE plan_mode = '{_mode}'"""
ORACLES["months_to_goal"] = f"""WITH {PLANS}
    SELECT scenario_id, CASE WHEN current_cash >= cash_goal THEN 0 WHEN emergency_fund > 0 THEN CAST(ceil((cash_goal - current_cash) / CAST(emergency_fund AS DOUBLE)) AS BIGINT) END AS months_to_goal FROM rooms"""
_LINES = [
    ("CASE WHEN whole THEN 'Household take-home' ELSE 'Joint funding' END", "income"), ("'Spending + debt targets'", "expense"), ("'Savings allocations'", "savings"), ("'Current unassigned'", "current_room"),
    ("'Childcare + baby costs entered'", "baby"), ("'Leave income reduction entered'", "reduction"), ("'Baby + leave what-if, before timing'", "future_room"),
]
ORACLES["plan_breakdown"] = f"WITH {PLANS}\n" + " UNION ALL ".join(f"SELECT scenario_id, CAST({i} AS INTEGER) AS line, {label} AS label, {c} AS cents FROM rooms" for i, (label, c) in enumerate(_LINES))
ORACLES["goal_status"] = f"""WITH {PLANS}
    SELECT scenario_id, CASE WHEN months IS NOT NULL AND months = 0 THEN 'covered' WHEN months > 0 THEN 'reached' WHEN gap IS NULL THEN 'inputs_open' ELSE 'no_contribution' END AS status, months,
           CASE WHEN months > 0 THEN gap END AS remaining_cents, CASE WHEN months > 0 THEN emergency_fund END AS contribution_cents
    FROM (SELECT *, cash_goal - current_cash AS gap, CASE WHEN cash_goal - current_cash <= 0 THEN 0 WHEN emergency_fund > 0 THEN CAST(ceil((cash_goal - current_cash) / CAST(emergency_fund AS DOUBLE)) AS BIGINT) END AS months FROM rooms)"""

_AT = "(start_idx + i)"
_LEAVE = f"CASE WHEN {_AT} >= leave_idx AND {_AT} < leave_idx + leave_months THEN reduction ELSE 0 END"
_DEBT = f"CASE WHEN {_AT} > debt_idx THEN {_known('t_storeCard')} ELSE 0 END"
_BABIES = f"(CASE WHEN {_AT} >= baby_idx THEN {_known('baby_costs')} ELSE 0 END + CASE WHEN {_AT} >= childcare_idx THEN {_known('childcare')} ELSE 0 END)"
_FIXED = " + ".join(f"CASE WHEN {_SCOPE.get(k, 'true')} THEN {_known(f't_{k}')} ELSE 0 END" for k in ("mortgage", "vehicleA", "student", "vehicleB", "storeCard")) + f" + CASE WHEN whole THEN {_known('allowance')} ELSE 0 END"


def _grown(amount: str, rate: str) -> str:
    return js_round(f"({amount} * pow(1 + {rate}, i / CAST(12 AS DOUBLE)))")


def _interest(cash: str) -> str:
    return f"CASE WHEN {cash} IS NOT NULL THEN {js_round(f'(greatest(0, {cash}) * (pow(1 + cash_yield, CAST(1 AS DOUBLE) / CAST(12 AS DOUBLE)) - 1))')} END"


PROJECTION = f"""{PLANS}, dated AS (
  SELECT *, {_FIXED} AS fixed, unnest(generate_series(0, horizon - 1)) AS i FROM plans
), flows AS (
  SELECT *, {_grown("income", "income_growth")} - {_LEAVE} AS now_income, {_grown("(expense - fixed)", "expense_growth")} + fixed - {_DEBT} AS now_expense, {_grown(_BABIES, "expense_growth")} AS now_baby,
         CASE WHEN once_idx = {_AT} THEN {_known("once")} ELSE 0 END AS oneoff, {_DEBT} AS debt_reduction, {_LEAVE} AS leave_now,
         concat({_AT} // 12, '-', lpad(CAST({_AT} % 12 + 1 AS VARCHAR), 2, '0')) AS month FROM dated
), nets AS (SELECT *, now_income - now_expense - now_baby - oneoff AS net FROM flows),
run AS (
  SELECT scenario_id, i, {_interest("current_cash")} AS interest, current_cash + net + {_interest("current_cash")} AS cash FROM nets WHERE i = 0
  UNION ALL
  SELECT f.scenario_id, f.i, {_interest("r.cash")} AS interest, r.cash + f.net + {_interest("r.cash")} AS cash FROM run r JOIN nets f ON f.scenario_id = r.scenario_id AND f.i = r.i + 1
), steps AS (
  SELECT n.scenario_id, n.i, month, now_income AS income, now_expense AS expense, now_baby AS baby, oneoff, net, savings AS planned_savings, net - savings AS unassigned, r.interest, r.cash, debt_reduction, leave_now AS leave_reduction,
         current_cash, cash_goal, cash_yield FROM nets n JOIN run r ON r.scenario_id = n.scenario_id AND r.i = n.i
)"""
ORACLES["project_cash"] = f"WITH RECURSIVE {PROJECTION}\nSELECT * EXCLUDE (current_cash, cash_goal, cash_yield) REPLACE (CAST(i AS INTEGER) AS i) FROM steps"
ORACLES["project_no_yield_window"] = f"WITH RECURSIVE {PROJECTION}\nSELECT scenario_id, month, cash FROM steps WHERE cash_yield = 0"
_ALL = [*_MISSING, *_BLANK, *_MORE, *_LATER]
ORACLES["project_missing"] = f"WITH {PLANS}\nSELECT scenario_id, {_labels(_ALL)} AS missing FROM plans"
ORACLES["project_milestones"] = f"""WITH RECURSIVE {PROJECTION}, ends AS (
  SELECT scenario_id, max_by(coalesce(cash, -9999999999), i) AS last, min(month) FILTER (WHERE net < 0) AS first_deficit, min(month) FILTER (WHERE cash < 0) AS first_negative_cash,
         min(i) FILTER (WHERE cash >= cash_goal) AS reached, max(unassigned) FILTER (WHERE i = 0) AS first_unassigned FROM steps GROUP BY scenario_id)
SELECT scenario_id, nullif(last, -9999999999) AS end_cash, first_deficit, first_negative_cash, CAST(CASE WHEN current_cash >= cash_goal THEN 0 ELSE reached + 1 END AS INTEGER) AS goal_reached,
       first_unassigned, savings AS planned_savings, {_count(_ALL)} = 0 AS complete, {_count(_ALL)} AS missing_count
FROM ends JOIN plans USING (scenario_id)"""

_WARNINGS = [
    ("health_mode = 'combined'", "health_target_combined", "NULL", "NULL"),
    ("health_mode <> 'combined'", "dental_average_is_history", "NULL", "NULL"),
    ("NOT whole AND known_times IS NULL", "two_checks_assumed", "NULL", "NULL"),
    ("NOT whole", "contribution_entered", "person_b_contribution", "NULL"),
    (f"{_count([*_MISSING, *_BLANK, *_MORE])} > 0", "inputs_open", "NULL", f"replace({_labels([*_MISSING, *_BLANK, *_MORE])}, '|', '; ')"),
    ("allocation_deficit > 0", "allocation_short_of_debts", "allocation_deficit", "NULL"),
    (f"{_known('person_a_allocation')} > {_known('person_a_pay')}", "allocation_above_pay", "NULL", "NULL"),
    ("income_basis = 'average'", "average_has_extra_checks", "NULL", "NULL"),
    ("future_room < 0", "later_room_short", "-future_room", "NULL"),
]
ORACLES["plan_warnings"] = f"WITH {PLANS}\n" + " UNION ALL ".join(
    f"SELECT scenario_id, CAST({i} AS INTEGER) AS ord, '{code}' AS code, CAST({cents} AS BIGINT) AS cents, CAST({detail} AS VARCHAR) AS detail FROM rooms WHERE {c}" for i, (c, code, cents, detail) in enumerate(_WARNINGS)
)
ORACLES["visible_targets"] = f"WITH {PLANS}\n" + " UNION ALL ".join(f"SELECT scenario_id, CAST({i} AS INTEGER) AS ord, '{k}' AS key, '{label}' AS label, t_{k} AS cents FROM rooms WHERE {_SCOPE.get(k, 'true')}" for i, (k, label) in enumerate(_LABELS.items()))
ORACLES["flexible_total"] = f"WITH {PLANS}\nSELECT scenario_id, {_known('t_groceries')} AS flexible_cents, {js_round(f'({_known("t_groceries")} * CAST(0.1 AS DOUBLE))')} AS tenth_cents FROM rooms"
ORACLES["projected_bounds"] = f"""WITH RECURSIVE {PROJECTION}
SELECT scenario_id, least(0, min(cash), any_value(current_cash)) AS least_cents, greatest(0, max(cash), any_value(current_cash)) AS largest_cents FROM steps GROUP BY scenario_id"""


ORACLES["project_events"] = f"""WITH RECURSIVE {PROJECTION}
SELECT scenario_id, CAST(i AS INTEGER) AS i, CAST(start_idx + i AS INTEGER) AS month_idx, CAST(debt_reduction AS BIGINT) AS debt_reduction, CAST(oneoff AS BIGINT) AS oneoff, CAST(coalesce(leave_now, 0) AS BIGINT) AS leave_reduction FROM flows"""

# ---- layers of saved documents


def _merged(below: str, of: str) -> str:
    """The states of a CTE under the documents of another."""
    kind, text = lambda p: f"coalesce(json_type(j, '$.{p}'), '')", lambda p: f"json_extract_string(j, '$.{p}')"
    number = lambda p: f"{kind(p)} IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
    value = lambda p: f"try_cast({text(p)} AS DOUBLE)"
    amount = lambda p, c: f"CASE WHEN {kind(p)} = 'NULL' OR ({kind(p)} = 'VARCHAR' AND {text(p)} = '') THEN NULL WHEN {number(p)} AND {value(p)} BETWEEN 0 AND 100000000 THEN {value(p)} ELSE {c} END"
    target = lambda k, base: f"CASE WHEN {kind(f'targets.{k}')} = 'NULL' THEN NULL WHEN {number(f'targets.{k}')} AND {value(f'targets.{k}')} BETWEEN 0 AND 100000000 THEN {value(f'targets.{k}')} ELSE {base} END"
    boolean = lambda p, c: f"CASE WHEN {kind(p)} = 'BOOLEAN' THEN {text(p)} = 'true' ELSE {c} END"
    month = lambda p: f"({kind(p)} = 'VARCHAR' AND regexp_full_match({text(p)}, '|[0-9]{{4}}-(0[1-9]|1[0-2])'))"
    valid = f"({kind('healthMode')} = 'VARCHAR' AND {text('healthMode')} IN ('combined', 'separate'))"
    item = """list_transform(list_filter(CAST(json_extract(j, '$.forecast.oneoffs') AS JSON[]), lambda o: json_type(o) = 'OBJECT'), lambda o: concat_ws(':', coalesce(nullif(json_extract_string(o, '$.label'), ''), 'One-off cost'),
        CASE WHEN CAST(json_extract_string(o, '$.amount') AS BIGINT) >= 0 THEN json_extract_string(o, '$.amount') ELSE 'unknown' END, json_extract_string(o, '$.month')))"""
    return f"""
      SELECT k, {amount("personAPay", "person_a_pay")} AS person_a_pay, {amount("otherIncome", "other_income")} AS other_income,
        CASE WHEN j IS NULL THEN health_mode WHEN {valid} THEN {text("healthMode")} WHEN migrated THEN 'combined' ELSE 'separate' END AS health_mode,
        CASE WHEN {kind("tab")} = 'VARCHAR' AND {text("tab")} IN ('overview', 'spending', 'plan', 'future', 'review') THEN {text("tab")} ELSE tab END AS tab,
        migrated OR health_notice AS health_notice, CASE WHEN version < 4 THEN true ELSE {boolean("auditBudgetNotice", "audit_notice")} END AS audit_notice,
        {boolean("adjustments.airfare", "airfare")} AS airfare, {boolean("checks.income", "income_checked")} AS income_checked,
        {target("dining", "target_dining")} AS target_dining, {target("medical", "target_medical")} AS target_medical,
        CASE WHEN NOT migrated THEN {target("dental", "target_dental")} END AS target_dental, {target("student", "target_student")} AS target_student,
        has_vision OR coalesce(version < 3, false) AS has_vision,
        CASE WHEN {number("forecast.months")} AND {value("forecast.months")} BETWEEN 1 AND 120 AND {value("forecast.months")} = floor({value("forecast.months")}) THEN CAST({value("forecast.months")} AS INTEGER) ELSE months END AS months,
        CASE WHEN {number("forecast.cashYield")} AND {value("forecast.cashYield")} BETWEEN 0 AND 20 THEN {value("forecast.cashYield")} ELSE cash_yield END AS cash_yield,
        CASE WHEN {month("forecast.babyStart")} THEN {text("forecast.babyStart")} ELSE baby_start END AS baby_start,
        CASE WHEN {kind("forecast.oneoffs")} = 'ARRAY' THEN array_to_string({item}, '|') ELSE oneoffs END AS oneoffs,
        CASE WHEN {month("forecast.debtEnds.student")} THEN {text("forecast.debtEnds.student")} ELSE student_ends END AS student_ends
      FROM (
        SELECT *, coalesce(NOT {valid} AND version < 3 AND {kind("targets.medical")} <> '', false) AS migrated FROM (
          SELECT *, CASE {kind("version")} WHEN 'NULL' THEN 0 WHEN '' THEN NULL ELSE {value("version")} END AS version
          FROM {below} LEFT JOIN (SELECT k, j FROM {of} WHERE json_type(j) IN ('OBJECT', 'ARRAY')) USING (k))
      )"""


ORACLES["merged_states"] = f"""
    WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer),
    embedded AS (SELECT k, CAST(t AS JSON) AS j FROM (SELECT k, {EMBEDDED_SQL} AS t FROM c) WHERE json_valid(t)),
    saved AS (SELECT k, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM (SELECT k, {SAVED_SQL} AS t FROM c WHERE k % 3 <> 0)),
    s0 AS (SELECT k, CAST(3000 AS DOUBLE) AS person_a_pay, CAST(0 AS DOUBLE) AS other_income, 'separate' AS health_mode, 'overview' AS tab, false AS health_notice, false AS audit_notice, false AS airfare,
           CAST(NULL AS BOOLEAN) AS income_checked, CAST(NULL AS DOUBLE) AS target_dining, CAST(NULL AS DOUBLE) AS target_medical, CAST(NULL AS DOUBLE) AS target_dental, CAST(220 AS DOUBLE) AS target_student, false AS has_vision,
           36 AS months, CAST(0 AS DOUBLE) AS cash_yield, '' AS baby_start, 'Home repair:unknown:|Celebration:unknown:|Family setup:unknown:' AS oneoffs, '' AS student_ends FROM c),
    s1 AS ({_merged("s0", "embedded")}),
    s2 AS ({_merged("s1", "saved")})
    SELECT k AS scenario_id, * EXCLUDE (k), 4 AS debt_ends FROM s2"""
