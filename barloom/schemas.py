"""Schemas of the tables that the operators take and give."""

BAR = "code string, dt date, open double, high double, low double, close double, volume double"
LISTING = "code string, name string, market string, open double, high double, low double, close double, volume double, amount double, marcap double, change double"
SECTOR = "code string, sector string, industry string"
THEME = "code string, category string, subthemes array<string>"
PICK = "scan_date date, strategy string, code string, name string, close bigint, rate double, match_type string, pattern string"
PICK_JSON = "code string, name string, close bigint, rate double, match_type string, pattern string"
NEAR_MA_PICK = "code string, name string, close bigint, low bigint, rate double, ma15 double, ma20 double, near15 boolean, near20 boolean, trend15_up boolean, trend20_up boolean, ref_date date"
WATCHLIST = "code string, name string, anchor_date date, anchor_close bigint, pattern string, status string, registered_at timestamp"
ISSUE = "issue_date date, code string, name string, rate double, summary string, headlines array<string>"
DASHBOARD = "code string, name string, close bigint, rate double, pattern string, comment string, chart string"
OVERVIEW = "market string, marcap bigint, sector string"
LATEST_PRICE = "name string, close bigint, rate double"
CANDLE_LOG = "date string, code string, name string, close double, volume double"
FILING = "code string, year int, fs_div string, pos int, account_nm string, thstrm_amount string"
TABLE_CELL = "code string, row int, col int, label string, header string, text string"
