"""Schemas of the tables; nothing is inferred."""

from __future__ import annotations

WORDS = "statement_id long, page int, page_width double, x0 double, y0 double, x1 double, y1 double, text string"
STATEMENTS = (
    "id long, bank string, file_name string, file_hash string, pages int, uploaded_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, status string, error string, progress_stage string, "
    "progress_percent int, holder string, account_number string, period_start string, period_end string, saldo_inicio decimal(18,2), saldo_final decimal(18,2), depositos decimal(18,2), "
    "otros_creditos decimal(18,2), cheques decimal(18,2), otros_debitos decimal(18,2), igtf decimal(18,2)"
)
OPERATIONS = (
    "statement_id long, seq int, page int, date string, number string, description string, cargo decimal(18,2), abono decimal(18,2), igtf decimal(18,2), balance_printed decimal(18,2)"
)
CHECKPOINTS = "statement_id long, ord int, page int, kind string, label string, printed_balance decimal(18,2), seq int, computed_balance decimal(18,2)"
ANNEX = "statement_id long, page int, ord int, date_tr string, date_op string, description string, amount decimal(18,2), timestamp string"
POS = "statement_id long, page int, ord int, date string, description string, amount decimal(18,2)"
ISSUES = "statement_id long, kind string, detail string, expected decimal(18,2), parsed decimal(18,2)"
ADJUSTMENTS = "id long, statement_id long, date string, description string, amount decimal(18,2), direction string, note string, created_at timestamp_ntz"
RULES = "id long, pattern string, category string, priority int"
SECTIONS = "statement_id long, section string, pages array<int>"
COVERS = (
    "statement_id long, holder string, account_number string, period_start string, period_end string, saldo_inicio decimal(18,2), depositos decimal(18,2), otros_creditos decimal(18,2), cheques decimal(18,2), "
    "otros_debitos decimal(18,2), igtf decimal(18,2), saldo_final decimal(18,2)"
)
#: Operations as they are stored, enriched; month (yyyymm, 0 for unknown days) is the folder.
STORED = (
    "statement_id long, seq int, page int, date string, number string, description string, cargo decimal(18,2), abono decimal(18,2), igtf decimal(18,2), amount decimal(18,2), direction string, "
    "balance_printed decimal(18,2), method string, counterpart string, counterpart_bank string, reference string, concept string, occurred_at string, phone string, counterpart_account string, "
    "balance_computed decimal(18,2), date_iso date, id long, search_key string, category string"
)
#: Why something was left out: a word, a row, or a whole statement.
QUARANTINE = "statement_id long, page int, text string, reason string, source_path string"
#: Statements: one row for each load that read it; the one in the last load that holds it counts.
LOG = (
    "statement_id long, file_hash string, bank string, pages long, source_path string, uploaded_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, status string, error string, progress_stage string, "
    "progress_percent int, holder string, account_number string, period_start string, period_end string, saldo_inicio decimal(18,2), depositos decimal(18,2), otros_creditos decimal(18,2), cheques decimal(18,2), "
    "otros_debitos decimal(18,2), igtf decimal(18,2), saldo_final decimal(18,2), total_cargo decimal(18,2), total_abono decimal(18,2), total_igtf decimal(18,2), transaction_count long, annex_count long, pos_count long, first_day date"
)
#: Partial sums of a load: by day, method and category, and by label.
DAYS = (
    "date_iso date, method string, category string, n long, cargo decimal(38,2), abono decimal(38,2), igtf decimal(38,2), amount decimal(38,2), n_amount long, n_igtf long, max_cargo decimal(18,2), max_abono decimal(18,2), "
    "last struct<statement_id: long, seq: int, balance: decimal(18,2)>"
)
LABELS = "kind string, label string, cargo decimal(38,2), n_cargo long, abono decimal(38,2), n_abono long"
#: Which operations (and months) hold three letters in a row in their search key; at its end, two and one.
GRAMS = "gram string, id long, month int"
TABLES = {
    "statements": LOG, "covers": COVERS, "operations": STORED, "checkpoints": CHECKPOINTS, "annex": ANNEX, "pos": POS, "issues": ISSUES, "sections": SECTIONS, "quarantine": QUARANTINE, "days": DAYS, "labels": LABELS,
    "grams": GRAMS,
}
