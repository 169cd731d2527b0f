"""The same results in plain SQL, for comparison on another engine.

The statements are put together from common table expressions: the documents derived from the
order tables (FIXTURES.md, part B), their typed values, and the verdicts.
"""

import json

from docproof.functions.reference_data import CURRENCIES, IBAN_LENGTHS
from docproof.schema import FIELDS
from docproof.sources.files import extraction_prompt, response_schema

WS = (
    r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
NBSP = "chr(160)"
FIELD_LIST = ", ".join(FIELDS)


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _norm(expr):
    # Upper-casing the sharp s gives SS in Python and Spark, but one letter in this engine.
    return rf"upper(replace(regexp_replace({expr}, '[{WS},.\-/]', '', 'g'), 'ß', 'ss'))"


CLEAN = """
src AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS issued,
         CAST(14 + 15 * (o_custkey % 3) AS INTEGER) AS terms,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price,
         s_name, n_name, s_suppkey, n_regionkey,
         lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS k9,
         '37040044' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS de,
         '10901014' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS pl
  FROM orders
  JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier)
  JOIN nation ON n_nationkey = s_nationkey),
clean AS (
  SELECT k, issued, terms, price, '/inv/' || k9 || '.pdf' AS path,
         s_name AS company_name,
         n_name || ' ' || CAST(s_suppkey AS VARCHAR) AS company_address,
         'INV-' || CAST(year(issued) AS VARCHAR) || '-' || k9 AS invoice_number,
         CAST(issued AS VARCHAR) AS issue_date,
         CAST(CAST(issued + terms AS DATE) AS VARCHAR) AS payment_date,
         CAST(terms AS VARCHAR) AS payment_terms_days,
         CAST(price AS VARCHAR) AS amount,
         CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'PLN' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP'
              ELSE 'CNY' END AS currency,
         'TAX' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS tax_id,
         CASE k % 3
           WHEN 0 THEN 'DE' || lpad(CAST(98 - CAST(de || '131400' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || de
           WHEN 1 THEN 'PL' || lpad(CAST(98 - CAST(pl || '252100' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || pl
           ELSE lpad(CAST(k AS VARCHAR), 10, '0') END AS account
  FROM src)"""

_ABSENT = "CASE WHEN (k // 50) % 2 = 0 THEN '' END"
_CASES = {
    "company_name": f"WHEN 10 THEN {_ABSENT} WHEN 15 THEN 'Other Vendor' WHEN 26 THEN 'Other Vendor'",
    "company_address": f"WHEN 11 THEN {_ABSENT}",
    "invoice_number": f"WHEN 5 THEN {_ABSENT} WHEN 16 THEN 'X' || invoice_number",
    "issue_date": f"WHEN 1 THEN '31/02/2026' WHEN 6 THEN {_ABSENT} WHEN 23 THEN '2027-01-01' "
    "WHEN 27 THEN strftime(issued, '%Y%m%d') WHEN 28 THEN strftime(issued, '%G-W%V-%u') WHEN 29 THEN '2026-6-1'",
    "payment_date": f"WHEN 2 THEN '2026-13-01' WHEN 13 THEN {_ABSENT} WHEN 23 THEN '2027-01-15' "
    "WHEN 24 THEN CAST(CAST(issued - 1 AS DATE) AS VARCHAR) "
    "WHEN 25 THEN CAST(CAST(issued + terms + 1 AS DATE) AS VARCHAR) WHEN 26 THEN '1990-01-01' WHEN 39 THEN NULL",
    "payment_terms_days": f"WHEN 4 THEN 'Net 30' WHEN 13 THEN {_ABSENT} WHEN 23 THEN '14' WHEN 24 THEN NULL "
    "WHEN 32 THEN '  ' || payment_terms_days || ' ' WHEN 33 THEN payment_terms_days || '.0' "
    "WHEN 40 THEN NULL WHEN 42 THEN '999999999999'",
    "amount": f"WHEN 3 THEN 'not-a-number' WHEN 7 THEN {_ABSENT} "
    "WHEN 19 THEN CAST(CAST(price * 10 AS DECIMAL(18,2)) AS VARCHAR) WHEN 34 THEN '-' || amount "
    "WHEN 35 THEN '0.05' WHEN 36 THEN '1234.125' WHEN 37 THEN amount || '0' WHEN 41 THEN 'NaN'",
    "currency": f"WHEN 12 THEN {_ABSENT} WHEN 22 THEN lower(currency) WHEN 26 THEN 'zl' WHEN 31 THEN '   '",
    "tax_id": f"WHEN 9 THEN {_ABSENT} WHEN 18 THEN 'TAX9' WHEN 26 THEN NULL",
    "account": f"WHEN 8 THEN {_ABSENT} WHEN 17 THEN '9999999999' WHEN 20 THEN 'SV92CENR00000000123456789012' "
    "WHEN 21 THEN 'DE89370400440532013001' WHEN 38 THEN '-'",
}
FAULTY = (
    "faulty AS (SELECT k, path, "
    + ", ".join(f"CASE k % 50 {_CASES[f]} ELSE {f} END AS {f}" for f in FIELDS)
    + " FROM clean)"
)

TEXTS = f"""
printed AS (
  SELECT *, format('{{:,}}', CAST(trunc(price) AS BIGINT)) AS grouped,
         lpad(CAST(CAST(price * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS cents,
         CASE k % 50 WHEN 20 THEN 'SV92CENR00000000123456789012' WHEN 21 THEN 'DE89370400440532013001'
                     ELSE account END AS shown_account
  FROM clean),
lines AS (
  SELECT k, path,
         company_name || chr(10) || company_address || chr(10) || 'Invoice ' || invoice_number AS page_1,
         'Total ' || CASE WHEN k % 50 = 30
                          THEN '___' || array_to_string(string_split(CAST(CAST(trunc(price) AS BIGINT) AS VARCHAR), ''), '_')
                               || '_,_' || cents || '_'
                          WHEN k % 50 = 35 THEN '0.05'
                          WHEN k % 50 = 36 THEN '1234.12'
                          WHEN k % 4 = 0 THEN amount
                          WHEN k % 4 = 1 THEN grouped || '.' || cents
                          WHEN k % 4 = 2 THEN replace(grouped, ',', '.') || ',' || cents
                          ELSE replace(grouped, ',', {NBSP}) || ',' || cents END
                  || ' ' || currency || chr(10)
         || 'Account ' || CASE WHEN k % 2 = 1
                               THEN rtrim(regexp_replace(shown_account, '(.{{4}})', '\\1 ', 'g'))
                               ELSE shown_account END || chr(10)
         || 'Tax ' || tax_id AS page_3
  FROM printed),
texts AS (
  SELECT k, path,
         CASE WHEN k % 50 = 14 THEN ' ' || chr(10) || chr(9) || chr(10) || {NBSP}
              ELSE page_1 || chr(10) || page_3 END AS raw_text
  FROM lines WHERE k % 50 <> 47)"""

BASE = f"{CLEAN},\n{FAULTY},\n{TEXTS}"

LENGTHS = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in IBAN_LENGTHS.items()) + "}"


def _date(expr):
    year, week = f"CAST(substr({expr}, 1, 4) AS INTEGER)", f"CAST(substr({expr}, 7, 2) AS INTEGER)"
    return (
        rf"CASE WHEN regexp_full_match({expr}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({expr} AS DATE) "
        rf"WHEN regexp_full_match({expr}, '[0-9]{{8}}') "
        rf"THEN TRY_CAST(substr({expr}, 1, 4) || '-' || substr({expr}, 5, 2) || '-' || substr({expr}, 7, 2) AS DATE) "
        rf"WHEN regexp_full_match({expr}, '[0-9]{{4}}-W[0-9]{{2}}-[1-7]') "
        rf"THEN CAST(date_trunc('week', make_date({year}, 1, 4)) AS DATE) + ({week} - 1) * 7 "
        rf"+ CAST(right({expr}, 1) AS INTEGER) - 1 END"
    )


def typed(source, name="typed"):
    """Typed values of the records of a table (path, fields, raw_text, error, …)."""
    trimmed = rf"regexp_replace(amount, '^[{WS}]+|[{WS}]+$', '', 'g')"
    return rf"""
{name}_1 AS (
  SELECT *, {_date('issue_date')} AS issued_on, {_date('payment_date')} AS paid_on,
         CASE WHEN regexp_full_match(payment_terms_days, '[{WS}]*[+-]?[0-9]+[{WS}]*')
              THEN CAST(trim(payment_terms_days) AS BIGINT) END AS days,
         coalesce(regexp_full_match({trimmed}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)'), false) AS is_finite,
         coalesce(regexp_full_match(lower({trimmed}), '[+-]?(nan|inf|infinity)'), false) AS is_special,
         upper(replace(account, ' ', '')) AS acc
  FROM {source}),
{name}_2 AS (
  SELECT *, CASE WHEN is_finite THEN CAST(round_even(abs(CAST({trimmed} AS DOUBLE)), 2) AS DECIMAL(18,2)) END AS cents,
         coalesce(regexp_full_match(acc, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}'), false) AS iban_like,
         {LENGTHS}[left(acc, 2)] AS country_length,
         coalesce(regexp_matches(raw_text, '[^{WS}]'), false) AS has_text
  FROM {name}_1),
{name} AS (
  SELECT *, CAST(CAST(cents * 100 AS BIGINT) AS VARCHAR) AS digits,
         CASE WHEN iban_like AND coalesce(country_length, length(acc)) = length(acc)
              THEN CAST(array_to_string(list_transform(string_split(substr(acc, 5) || left(acc, 4), ''),
                lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '') AS HUGEINT) % 97 = 1
              ELSE false END AS iban_valid
  FROM {name}_2)"""


def amount_found(strict=False):
    digits = "lpad(digits, CAST(greatest(length(digits), 3) AS INTEGER), '0')" if strict else "digits"
    return rf"""regexp_matches(raw_text, '(^|[^0-9])'
      || array_to_string(string_split(CASE WHEN length({digits}) > 2 THEN left({digits}, length({digits}) - 2) ELSE '0' END, ''), '[{WS}.,_]*')
      || '[{WS}_]*[.,][{WS}_]*' || right({digits}, 2) || '($|[^0-9])')"""


def found(field):
    return f"contains({_norm('raw_text')}, {_norm(field)})"


def _present(f):
    return f"coalesce({f} <> '', false)"


CONSISTENT = "coalesce(paid_on - DATE '1970-01-01' = (issued_on - DATE '1970-01-01') + days, true)"

_FIRES = [
    ("issue_date", "error", f"{_present('issue_date')} AND issued_on IS NULL", "'issue_date ''' || issue_date || ''' is not a valid ISO date'"),
    ("payment_date", "error", f"{_present('payment_date')} AND paid_on IS NULL", "'payment_date ''' || payment_date || ''' is not a valid ISO date'"),
    ("amount", "error", f"{_present('amount')} AND NOT (is_finite OR is_special)", "'amount ''' || amount || ''' is not a valid number'"),
    ("payment_terms_days", "error", f"{_present('payment_terms_days')} AND days IS NULL", "'payment_terms_days ''' || payment_terms_days || ''' is not a whole number'"),
    *[(f, "error", f"NOT {_present(f)}", f"'{f} is missing'") for f in ("invoice_number", "issue_date", "amount", "account", "tax_id")],
    *[(f, "warning", f"NOT {_present(f)}", f"'{f} is missing'") for f in ("company_name", "company_address", "currency")],
    ("payment_date", "error", f"NOT {_present('payment_date')} AND NOT {_present('payment_terms_days')}", "'Either payment_date or payment_terms_days is needed'"),
    ("document", "warning", "NOT has_text", "'The document has no text layer; it may be a scan'"),
    *[(f, "warning" if f == "company_name" else "error", f"has_text AND {_present(f)} AND NOT {found(f)}", f"'{f} was not found verbatim in the source text'")
      for f in ("company_name", "invoice_number", "account", "tax_id")],
    ("amount", "error", f"has_text AND cents IS NOT NULL AND NOT {amount_found()}", "'amount was not found verbatim in the source text'"),
    ("account", "warning", "iban_valid AND country_length IS NULL", "'The IBAN''s country code is not in the list'"),
    ("account", "error", "iban_like AND NOT iban_valid", "'''' || account || ''' looks like an IBAN but fails its checks'"),
    ("currency", "warning", f"{_present('currency')} AND currency NOT IN {_in(sorted(CURRENCIES))}", "'''' || currency || ''' is not an ISO 4217 currency code'"),
    ("issue_date", "error", "issued_on > DATE '2026-07-04'", "'The issue date is after the reference date'"),
    ("payment_date", "error", "paid_on < issued_on", "'The payment date is before the issue date'"),
    ("payment_date", "error", f"issued_on IS NOT NULL AND NOT {CONSISTENT}", "'The payment date is not the issue date plus the payment terms'"),
]
_ERRORS = [n for n, r in enumerate(_FIRES, 1) if r[1] == "error"]


def judged(source, name="judged"):
    """Verdicts of the records of a table: r1…r25, m1…m25, error, rules, flagged, status."""
    t = f"{name}_typed"
    fires = ", ".join(f"coalesce({r[2]}, false) AS r{n}, {r[3]} AS m{n}" for n, r in enumerate(_FIRES, 1))
    rules = ", ".join(f"CASE WHEN r{n} THEN 'R{n:02d}' END" for n in range(1, 26))
    any_error = " OR ".join(f"r{n}" for n in _ERRORS)
    return f"""{typed(source, t)},
{name}_fired AS (
  SELECT * EXCLUDE (error), {fires},
         coalesce(error,
           CASE WHEN has_text AND is_special THEN 'ValueError: the amount cannot be rounded to cents'
                WHEN issued_on IS NOT NULL AND paid_on IS NOT NULL AND abs(days) > 999999999
                THEN 'OverflowError: issue date plus payment terms is no date' END) AS error
  FROM {t}),
{name} AS (
  SELECT *, CASE WHEN error IS NULL THEN concat_ws(' ', {rules}) END AS rules,
         CASE WHEN error IS NULL THEN ({any_error}) END AS flagged,
         CASE WHEN error IS NOT NULL THEN 'error' WHEN {any_error} THEN 'flagged' ELSE 'ok' END AS status
  FROM {name}_fired)"""


INGESTED = (
    "ingested AS (SELECT k, path, CASE k % 50 WHEN 43 THEN 'ResponseError: not a JSON object' "
    "WHEN 44 THEN 'ResponseError: unknown field vat_rate' WHEN 45 THEN 'ResponseError: a field is not text' "
    "END AS error, " + ", ".join(f"CASE WHEN k % 50 NOT IN (43, 44, 45) THEN {f} END AS {f}" for f in FIELDS)
    + " FROM faulty WHERE k % 50 <> 46)"
)
CAPTURED = f"""
{INGESTED},
captured AS (
  SELECT f.k, f.path, {', '.join(f'i.{x}' for x in FIELDS)}, t.raw_text,
         CASE WHEN i.path IS NULL THEN 'MissingResponse: no extraction response'
              WHEN i.error IS NOT NULL THEN i.error
              WHEN t.path IS NULL THEN 'MissingText: no pages for this document' END AS error
  FROM clean f LEFT JOIN ingested i ON i.path = f.path LEFT JOIN texts t ON t.path = f.path)"""

WITH_TEXT = "faulty_text AS (SELECT f.*, t.raw_text, CAST(NULL AS VARCHAR) AS error FROM faulty f LEFT JOIN texts t USING (path))"

EDITS = """
edits AS (
  SELECT path, 'invoice_number' AS field, 1 AS seq, 'edit' AS op, 'WRONG-' || CAST(k AS VARCHAR) AS text FROM clean WHERE k % 7 = 0
  UNION ALL SELECT path, 'currency', 2, 'edit', '   ' FROM clean WHERE k % 7 = 0
  UNION ALL SELECT path, CASE WHEN k % 2 = 0 THEN 'invoice_number' ELSE 'amount' END, 3,
                   CASE WHEN k % 2 = 0 THEN 'revert' ELSE 'edit' END,
                   CASE WHEN k % 2 = 1 THEN ' 5.00 ' END FROM clean WHERE k % 7 = 0),
folded AS (
  SELECT path, field, CAST(seq AS BIGINT) AS seq, op, CASE WHEN op = 'edit' THEN nullif(trim(text), '') END AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY path, field ORDER BY seq DESC) AS rn FROM edits) WHERE rn = 1)"""


def overlay(source, name="edited"):
    joins = ", ".join(
        f"CASE WHEN max(CASE WHEN e.field = '{f}' THEN e.op END) = 'edit' "
        f"THEN max(CASE WHEN e.field = '{f}' THEN e.value END) ELSE any_value(s.{f}) END AS {f}"
        for f in FIELDS
    )
    return f"{name} AS (SELECT s.path, {joins}, max(e.seq) AS seq FROM {source} s LEFT JOIN folded e ON e.path = s.path GROUP BY s.path)"


def _with(*parts):
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


JUDGED = _with(BASE, CAPTURED, judged("captured"))
VERDICT = "SELECT path, status, flagged, error, rules FROM judged"
TYPED = _with(BASE, WITH_TEXT, typed("faulty_text"))
FAULTS = _with(CLEAN, FAULTY)


def _unpivoted(fields):
    return "(" + " UNION ALL ".join(f"SELECT path, '{f}' AS field, {f} AS input FROM faulty" for f in fields) + ")"


def _issues(columns):
    return " UNION ALL ".join(
        f"SELECT path, {n} AS rule_no, '{r[1]}' AS severity, '{r[0]}' AS field, m{n} AS message FROM judged WHERE error IS NULL AND r{n}"
        for n, r in enumerate(_FIRES, 1)
    )


def _worst(f):
    by = {s: " OR ".join(f"r{n}" for n, r in enumerate(_FIRES, 1) if r[0] == f and r[1] == s) or "false" for s in ("error", "warning")}
    return f"CASE WHEN {by['error']} THEN 'error' WHEN {by['warning']} THEN 'warning' END"


_RUN = "CASE WHEN k % 2 = 1 THEN 'second' ELSE 'first' END"
_JSON_ISSUES = "CASE WHEN rules = '' THEN ['No issues found.'] ELSE list_filter([" + ", ".join(
    f"CASE WHEN r{n} THEN '[{r[1]}] {r[0]}: ' || m{n} END" for n, r in enumerate(_FIRES, 1)
) + "], lambda x: x IS NOT NULL) END"

_REVALIDATED = _with(
    BASE, CAPTURED, judged("captured"), EDITS,
    "snapshots AS (SELECT * FROM judged WHERE error IS NULL AND path IN (SELECT path FROM edits))",
    overlay("snapshots"),
    "edited_text AS (SELECT e.*, t.raw_text, CAST(NULL AS VARCHAR) AS error FROM edited e JOIN texts t USING (path))",
    judged("edited_text", "again"),
)


def _passage():
    last = "greatest(length(text) - 59, 1)"
    start = f"CASE WHEN doc_id % 5 = 4 THEN {last} ELSE doc_id * 7919 % {last} + 1 END"
    passage = f"substr(text, {start}, 60)"
    return (
        f"CASE doc_id % 3 WHEN 0 THEN replace(replace({passage}, ' ', '-'), ',', '/') "
        f"WHEN 1 THEN upper(replace(replace({passage}, ' ', ''), 'ß', 'ss')) ELSE replace({passage}, 'e', 'q') END"
    )


ORACLE = {
    "verify_documents_end_to_end": JUDGED + VERDICT,
    "verify_long_documents": JUDGED + VERDICT,
    "scan_files": "SELECT count(*) AS n_files, count(*) AS n_names, 'txt' AS suffix FROM benchmark",
    "build_extraction_requests": "SELECT '/docs/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, "
    "CAST(doc_id AS VARCHAR) || '.pdf' AS filename, "
    "'data:application/pdf;base64,' || to_base64(encode(text)) AS file_data, "
    f"'{extraction_prompt(None)}' AS prompt, '{json.dumps(response_schema())}' AS schema_json FROM documents",
    "ingest_responses": _with(CLEAN, FAULTY, INGESTED) + f"SELECT path, {FIELD_LIST}, error FROM ingested",
    "assemble_text": "SELECT CAST(conv_id AS VARCHAR) AS path, CAST(0 AS BIGINT) AS part_no, "
    "coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') AS raw_text "
    "FROM conversations GROUP BY conv_id",
    "page_count": _with(CLEAN) + "SELECT path, CAST(CASE WHEN k % 50 = 47 THEN 0 ELSE 3 END AS BIGINT) AS n_pages FROM clean",
    "write_results": JUDGED + f"SELECT {_RUN} AS run_id, status, count(*) AS n_documents FROM judged GROUP BY ALL",
    "export_json": JUDGED + "SELECT path, CAST(CASE WHEN error IS NULL THEN json_object('data', json_object("
    + ", ".join(f"'{f}', {f}" for f in FIELDS)
    + f"), 'flagged_for_review', flagged, 'issues', {_JSON_ISSUES}, 'error', error) "
    "ELSE json_object('data', NULL, 'flagged_for_review', NULL, 'issues', NULL, 'error', error) END AS VARCHAR) AS json FROM judged",
    "pair_with_text": _with(BASE, INGESTED)
    + "SELECT i.path, i.invoice_number, t.raw_text FROM ingested i LEFT JOIN texts t USING (path)",
    "capture_errors": _with(BASE, CAPTURED)
    + "SELECT path, CASE WHEN error IS NULL THEN invoice_number END AS invoice_number, "
    "CASE WHEN error IS NULL THEN raw_text END AS raw_text, error FROM captured",
    "lookup_country_length": FAULTS
    + f"SELECT path, CAST({LENGTHS}[left(upper(replace(account, ' ', '')), 2)] AS INTEGER) AS country_length FROM faulty",
    "overlay_edits": _with(CLEAN, FAULTY, EDITS, overlay("faulty")) + f"SELECT path, {FIELD_LIST} FROM edited",
    "changed_only": JUDGED + "SELECT path, status FROM judged WHERE k % 7 = 0",
    "rejected_edits": _with(
        BASE, CAPTURED, judged("captured"), EDITS,
        """strays AS (SELECT CASE WHEN k % 2 = 0 THEN path ELSE '/old' || path END AS path,
             CASE WHEN k % 2 = 0 THEN 'vat_rate' ELSE 'amount' END AS field, 9 AS seq,
             CASE WHEN k % 3 = 0 THEN 'drop' ELSE 'edit' END AS op FROM clean WHERE k % 5 = 0)""",
    ) + """SELECT * FROM (
      SELECT l.path, l.field, CAST(l.seq AS BIGINT) AS seq, l.op,
             CASE WHEN field = 'vat_rate' THEN 'unknown field' WHEN op = 'drop' THEN 'unknown operation'
                  WHEN j.path IS NULL THEN 'unknown document'
                  WHEN j.error IS NOT NULL THEN 'document has no extracted data' END AS reason
      FROM (SELECT path, field, seq, op FROM edits UNION ALL SELECT * FROM strays) l LEFT JOIN judged j USING (path))
    WHERE reason IS NOT NULL""",
    "parse_iso_date": FAULTS + f"SELECT path, field, input, CAST({_date('input')} AS VARCHAR) AS result FROM {_unpivoted(['issue_date', 'payment_date'])}",
    "parse_amount": TYPED + "SELECT path, amount AS input, is_finite OR is_special AS readable, "
    "CAST(CASE WHEN amount LIKE '-%' THEN -cents ELSE cents END AS VARCHAR) AS result FROM typed",
    "parse_days": TYPED + "SELECT path, payment_terms_days AS input, days AS result FROM typed",
    "normalize_text": f"SELECT doc_id, CAST(length(n) AS INTEGER) AS n_chars, md5(n) AS digest FROM (SELECT doc_id, {_norm('text')} AS n FROM documents)",
    "clean_account": FAULTS + "SELECT path, account AS input, upper(replace(account, ' ', '')) AS result FROM faulty",
    "has_text_layer": TYPED + "SELECT path, has_text AS result FROM typed",
    "is_grounded": TYPED + "SELECT path, " + ", ".join(
        f"coalesce(raw_text <> '' AND {f} <> '' AND {found(f)}, false) AS {f}" for f in ("company_name", "invoice_number", "account", "tax_id")
    ) + " FROM typed",
    "is_grounded_in_prose": f"SELECT doc_id, coalesce(v <> '' AND contains({_norm('text')}, {_norm('v')}), false) AS result "
    f"FROM (SELECT doc_id, text, {_passage()} AS v FROM documents)",
    "is_amount_grounded": TYPED + f"SELECT path, coalesce({amount_found()}, false) AS result FROM typed",
    "is_amount_grounded_strict": TYPED + f"SELECT path, coalesce({amount_found(True)}, false) AS result FROM typed",
    "is_iban_like": TYPED + "SELECT path, iban_like AS result FROM typed",
    "is_valid_iban": TYPED + "SELECT path, iban_valid AS result FROM typed",
    "is_known_iban_country": TYPED + "SELECT path, country_length IS NOT NULL AS result FROM typed",
    "is_valid_currency_code": FAULTS + f"SELECT path, coalesce(currency IN {_in(sorted(CURRENCIES))}, false) AS result FROM faulty",
    "is_issue_date_plausible": TYPED + "SELECT path, coalesce(issued_on <= DATE '2026-07-04', false) AS result FROM typed",
    "is_payment_after_issue": TYPED + "SELECT path, coalesce(paid_on >= issued_on, true) AS result FROM typed",
    "is_payment_consistent": TYPED + f"SELECT path, {CONSISTENT} AS result FROM typed",
    "is_absent": FAULTS + "SELECT path, " + ", ".join(f"coalesce({f}, '') = '' AS {f}" for f in FIELDS) + " FROM faulty",
    "validate_records": _with(BASE, WITH_TEXT, "given AS (SELECT * FROM faulty_text WHERE raw_text IS NOT NULL)", judged("given"))
    + "SELECT path, error, rules FROM judged",
    "flag_for_review": JUDGED + "SELECT path, flagged FROM judged",
    "status": JUDGED + "SELECT path, status FROM judged",
    "issue_rows": JUDGED + f"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY rule_no) - 1 AS INTEGER) AS pos,
      CAST(rule_no AS INTEGER) AS rule_no, severity, field, message FROM (
      {_issues(None)}
      UNION ALL SELECT path, NULL, 'error', '—', error FROM judged WHERE error IS NOT NULL
      UNION ALL SELECT path, NULL, '', '', 'No issues found.' FROM judged WHERE rules = '')""",
    "field_severity": JUDGED + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT path, '{f}' AS field, {_worst(f)} AS severity FROM judged WHERE error IS NULL" for f in FIELDS
    ) + ") WHERE severity IS NOT NULL",
    "field_review": JUDGED + " UNION ALL ".join(
        f"SELECT path, {n} AS field_no, '{f}' AS field, coalesce({f}, '—') AS value, {_worst(f)} AS severity, false AS edited "
        "FROM judged WHERE error IS NULL" for n, f in enumerate(FIELDS, 1)
    ) + " UNION ALL SELECT path, 0, '(error)', error, 'error', false FROM judged WHERE error IS NOT NULL",
    "field_review_of_edited": _REVALIDATED + " UNION ALL ".join(
        f"SELECT path, {n} AS field_no, '{f}' AS field, coalesce({f}, '—') AS value, {_worst(f)} AS severity, {f} IS DISTINCT FROM was AS edited "
        f"FROM again JOIN (SELECT path, {f} AS was FROM snapshots) USING (path) WHERE error IS NULL" for n, f in enumerate(FIELDS, 1)
    ) + " UNION ALL SELECT path, 0, '(error)', error, 'error', false FROM again WHERE error IS NOT NULL",
    "run_summary": JUDGED + "SELECT count(*) FILTER (WHERE k % 2 = 1) AS processed, count(*) AS loaded, "
    "count(*) FILTER (WHERE status = 'flagged') AS flagged, count(*) FILTER (WHERE status = 'error') AS errors FROM judged",
    "review_list": JUDGED + f"SELECT {_RUN} AS run_id, path, CASE status WHEN 'ok' THEN '✓' WHEN 'flagged' THEN '⚠' ELSE '✗' END AS glyph, "
    "string_split(path, '/')[-1] AS name FROM judged",
    "fold_edits": _with(CLEAN, EDITS) + "SELECT path, field, seq, op, value FROM folded",
    "revert_field": FAULTS + "SELECT path, invoice_number FROM faulty WHERE k % 14 = 0",
    "field_is_edited": _with(CLEAN, FAULTY, EDITS, overlay("faulty")) + " UNION ALL ".join(
        f"SELECT path, '{f}' AS field FROM edited e JOIN faulty f USING (path) WHERE e.{f} IS DISTINCT FROM f.{f}" for f in FIELDS
    ),
    "revalidate": _REVALIDATED + "SELECT path, seq AS version, status, error, rules FROM again",
    "stream_validate": _with(BASE, CAPTURED, judged("captured"))
    + "SELECT path, status, error, rules FROM judged",
    "stream_summary": JUDGED + "SELECT status, count(*) AS n_documents FROM judged GROUP BY status",
    "stream_edits": _REVALIDATED + "SELECT path, seq AS version, status, error, rules FROM again",
    "stream_verify": _with(BASE, CAPTURED, judged("captured")) + "SELECT path, status, error, rules FROM judged",
    "assemble_text_in_parts": """
SELECT path, part_no, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') AS raw_text FROM (
  SELECT CAST(conv_id AS VARCHAR) AS path, turn, text,
    CAST(coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 200 AS BIGINT) AS part_no
  FROM conversations
) GROUP BY path, part_no""",
    "unanswered_files": _with(CLEAN) + "SELECT path FROM clean WHERE k % 50 = 46",
}
ORACLE["summary_of_runs"] = ORACLE["run_summary"]
