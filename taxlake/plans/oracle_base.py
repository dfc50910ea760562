"""DuckDB text of the derived tables; every oracle query starts from these."""

from __future__ import annotations

NATION_COUNTRY = (
    "CASE {c} % 5 WHEN 0 THEN 'DE' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'US' ELSE 'GB' END"
)

DOCS = f"""
raw_docs AS (
  SELECT 'O' || o_orderkey AS id, o_orderkey AS k, 'income' AS direction, o_custkey AS party_key,
         CAST(o_totalprice AS DECIMAL(18,2)) AS base_net,
         CAST(CAST(o_orderdate AS DATE) + INTERVAL '312' MONTH AS DATE) AS document_date,
         o_orderstatus AS state, c_name AS party, {NATION_COUNTRY.format(c='c_nationkey')} AS party_country
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 'L' || l_orderkey || '-' || l_suppkey, l_orderkey, 'expense', l_suppkey, base_net, document_date,
         CASE flag WHEN 'R' THEN 'F' WHEN 'A' THEN 'P' ELSE 'O' END, s_name,
         {NATION_COUNTRY.format(c='s_nationkey')}
  FROM (
    SELECT l_orderkey, l_suppkey,
           CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(6,2)) - CAST(l_discount AS DECIMAL(6,2)))), 2) AS DECIMAL(18,2)) AS base_net,
           CAST(CAST(MIN(l_shipdate) AS DATE) + INTERVAL '312' MONTH AS DATE) AS document_date,
           MAX(l_returnflag) AS flag
    FROM lineitem GROUP BY l_orderkey, l_suppkey
  ) JOIN supplier ON l_suppkey = s_suppkey
),
docs1 AS (
  SELECT *, CAST(k % 8 AS INTEGER) AS tenant_id,
    CASE WHEN k % 97 <> 0 THEN document_date END AS invoice_date,
    CASE state WHEN 'F' THEN 'paid' WHEN 'O' THEN 'unpaid' ELSE 'unknown' END AS payment_status,
    CASE WHEN state = 'F' AND k % 11 <> 0 THEN CAST(document_date + CAST(k % 45 AS INTEGER) AS DATE) END AS payment_date,
    CASE WHEN k % 59 <> 0 THEN party_country END AS country,
    CASE WHEN k % 83 = 0 THEN NULL WHEN k % 71 = 0 AND party_country = 'US' THEN 'USDT'
         WHEN party_country = 'US' THEN 'USD' WHEN party_country = 'GB' THEN 'GBP' ELSE 'EUR' END AS original_currency,
    CASE WHEN party_country = 'DE' AND k % 4 = 0 THEN 7 WHEN party_country = 'DE' THEN 19 ELSE 0 END AS vat_rate,
    party || CASE party_key % 5 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' AG' WHEN 2 THEN ' Ltd' WHEN 3 THEN '' ELSE ' e.K.' END AS party_name
  FROM raw_docs
),
docs2 AS (
  SELECT *, CAST(ROUND(base_net * vat_rate * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS base_vat
  FROM docs1
),
docs3 AS (
  SELECT *,
    CASE WHEN k % 109 <> 0 THEN base_net END AS net_amount_original,
    CASE WHEN k % 101 <> 0 THEN base_vat END AS vat_amount_original,
    CASE WHEN k % 103 <> 0 THEN CAST(base_net + base_vat + CASE WHEN k % 107 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) END AS gross_amount_original,
    CASE WHEN k % 43 = 0 THEN NULL WHEN original_currency = 'USD' THEN CAST(0.9 AS DECIMAL(18,10))
         WHEN original_currency = 'GBP' THEN CAST(1.15 AS DECIMAL(18,10)) END AS exchange_rate_to_eur,
    CASE WHEN k % 23 = 0 THEN 'EU' || lpad(CAST(party_key AS VARCHAR), 9, '0')
         WHEN party_country = 'DE' AND k % 2 = 0 THEN 'DE' || lpad(CAST(party_key AS VARCHAR), 9, '0')
         WHEN party_country = 'FR' AND k % 3 <> 0 THEN 'FR' || lpad(CAST(party_key AS VARCHAR), 11, '0') END AS vat_id,
    CAST(document_date AS TIMESTAMP) + to_seconds(k % 1000) AS created_at
  FROM docs2
),
docs AS (
  SELECT id, k, tenant_id, direction, party_key, base_net, vat_rate, document_date,
    sha256(direction || '|' || k || '|' || party_key) AS sha256,
    'scan_' || k || '.pdf' AS original_filename,
    CASE WHEN k % 67 <> 0 THEN 'RE-' || k END AS invoice_number,
    invoice_date, payment_date, payment_status,
    CASE WHEN direction = 'income' THEN 'Studio Nord' ELSE party_name END AS issuer_name,
    CASE WHEN direction = 'income' THEN 'DE' ELSE country END AS issuer_country_code,
    CASE WHEN direction = 'expense' THEN vat_id END AS issuer_vat_id,
    CASE WHEN direction = 'income' THEN party_name ELSE 'Studio Nord' END AS recipient_name,
    CASE WHEN direction = 'income' THEN country ELSE 'DE' END AS recipient_country_code,
    CASE WHEN direction = 'income' THEN vat_id END AS recipient_vat_id,
    CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 <> 1 END AS recipient_is_business,
    CASE WHEN k % 61 <> 0 THEN CASE k % 7 WHEN 0 THEN 'Konferenz und Seminar' WHEN 1 THEN 'Software development'
      WHEN 2 THEN 'Transport und Versand' WHEN 3 THEN 'Catering 50%_Buffet' WHEN 4 THEN 'Beratung'
      WHEN 5 THEN 'Streaming Abo' ELSE 'Hosting' END || ' ' || k END AS description,
    original_currency, net_amount_original, vat_amount_original, gross_amount_original, exchange_rate_to_eur,
    CASE WHEN original_currency = 'EUR' THEN net_amount_original ELSE CAST(ROUND(CAST(net_amount_original AS DECIMAL(28,2)) * exchange_rate_to_eur, 2) AS DECIMAL(18,2)) END AS net_amount_eur,
    CASE WHEN original_currency = 'EUR' THEN vat_amount_original ELSE CAST(ROUND(CAST(vat_amount_original AS DECIMAL(28,2)) * exchange_rate_to_eur, 2) AS DECIMAL(18,2)) END AS vat_amount_eur,
    CASE WHEN original_currency = 'EUR' THEN gross_amount_original ELSE CAST(ROUND(CAST(gross_amount_original AS DECIMAL(28,2)) * exchange_rate_to_eur, 2) AS DECIMAL(18,2)) END AS gross_amount_eur,
    CASE WHEN k % 53 = 0 THEN 'UNKNOWN_REVIEW'
      WHEN direction = 'income' AND k % 47 = 0 THEN 'DE_DOMESTIC_0_EXEMPT'
      WHEN direction = 'income' AND k % 8 = 2 AND vat_rate > 0 THEN 'KLEINUNTERNEHMER'
      WHEN direction = 'income' AND vat_rate = 19 THEN 'DE_DOMESTIC_19'
      WHEN direction = 'income' AND vat_rate = 7 THEN 'DE_DOMESTIC_7'
      WHEN direction = 'income' AND party_country = 'FR' THEN 'EU_B2B_REVERSE_CHARGE_REVENUE'
      WHEN direction = 'income' THEN 'THIRD_COUNTRY_B2B_SERVICE'
      WHEN vat_rate > 0 THEN 'DE_EXPENSE_INPUT_VAT'
      WHEN k % 3 <> 0 THEN 'EXPENSE_REVERSE_CHARGE_13B'
      ELSE 'DE_EXPENSE_NO_INPUT_VAT' END AS vat_treatment_code,
    CASE WHEN vat_rate = 0 AND k % 26 = 5 THEN [{{rate: 20, net: base_net, vat: CAST(ROUND(base_net * 0.20, 2) AS DECIMAL(18,2))}}]
      WHEN vat_rate = 0 OR k % 10 = 0 THEN []
      WHEN k % 9 = 0 THEN [{{rate: 7, net: base_net, vat: CAST(ROUND(base_net * 0.07, 2) AS DECIMAL(18,2))}}, {{rate: 19, net: base_net, vat: CAST(ROUND(base_net * 0.19, 2) AS DECIMAL(18,2))}}]
      WHEN k % 33 = 0 THEN [{{rate: 19, net: base_net, vat: CAST(ROUND(base_net * 0.19, 2) + 5 AS DECIMAL(18,2))}}]
      WHEN vat_rate = 7 THEN [{{rate: 7, net: base_net, vat: CAST(ROUND(base_net * 0.07, 2) AS DECIMAL(18,2))}}]
      ELSE [{{rate: 19, net: base_net, vat: CAST(ROUND(base_net * 0.19, 2) AS DECIMAL(18,2))}}] END AS vat_rates,
    (party_country <> 'DE' AND k % 3 = 0) AS reverse_charge, k % 17 = 0 AS vat_exempt, k % 19 = 0 AS small_business,
    k % 23 = 0 AS oss, k % 5 <> 0 AS service_likely,
    CASE WHEN k % 13 = 0 THEN 'needs_review' WHEN k % 29 = 0 THEN 'failed' WHEN k % 31 = 0 THEN 'processing' ELSE 'confirmed' END AS review_status,
    k % 37 = 0 AS has_conflicting_totals,
    (k % 43 = 0 AND original_currency IS NOT NULL AND original_currency <> 'EUR') AS has_missing_rate,
    k % 41 = 0 AS is_deleted, created_at
  FROM docs3
),
bucketed AS (
  SELECT *, CASE
      WHEN has_conflicting_totals OR has_missing_rate
        OR (original_currency <> 'EUR' AND exchange_rate_to_eur IS NULL)
        OR review_status = 'failed' THEN 'excluded'
      WHEN review_status = 'confirmed' THEN 'confirmed'
      WHEN review_status = 'needs_review' THEN 'provisional'
      ELSE 'excluded' END AS base_bucket,
    COALESCE(net_amount_eur, gross_amount_eur, 0) AS net_value,
    COALESCE(gross_amount_eur, net_amount_eur + vat_amount_eur, net_amount_eur, 0) AS gross_value
  FROM docs WHERE NOT is_deleted
)"""

SETTINGS = """
stored_settings AS (
  SELECT t AS tenant_id,
    ['ist','soll','kleinunternehmer','unsure'][t % 4 + 1] AS vat_method,
    ['euer','accrual','unsure'][t % 3 + 1] AS income_tax_method,
    ['monthly','quarterly','yearly'][t % 3 + 1] AS vat_filing_frequency,
    ['single','joint'][t % 2 + 1] AS assessment_type,
    ['none','rate8','rate9'][t % 3 + 1] AS church_tax,
    CAST(t * 1000 AS DECIMAL(18,2)) AS other_taxable_income,
    CAST(CASE WHEN t % 2 = 0 THEN 0 ELSE t * 500 END AS DECIMAL(18,2)) AS deductible_contributions,
    CAST(t * 250 AS DECIMAL(18,2)) AS income_tax_prepayments,
    CASE WHEN t = 3 THEN FALSE WHEN t <> 5 THEN TRUE END AS include_soli
  FROM (SELECT DISTINCT CAST(o_orderkey % 8 AS INTEGER) AS t FROM orders) WHERE t <> 7
),
tenants AS (SELECT DISTINCT CAST(o_orderkey % 8 AS INTEGER) AS tenant_id FROM orders),
settings AS (
  SELECT tenants.tenant_id, COALESCE(vat_method, 'unsure') AS vat_method,
    COALESCE(income_tax_method, 'unsure') AS income_tax_method,
    COALESCE(vat_filing_frequency, 'quarterly') AS vat_filing_frequency,
    COALESCE(assessment_type, 'single') AS assessment_type, COALESCE(church_tax, 'none') AS church_tax,
    COALESCE(other_taxable_income, 0) AS other_taxable_income,
    COALESCE(deductible_contributions, 0) AS deductible_contributions,
    COALESCE(income_tax_prepayments, 0) AS income_tax_prepayments,
    COALESCE(include_soli, TRUE) AS include_soli
  FROM tenants LEFT JOIN stored_settings USING (tenant_id)
)"""

RATES = """
rate_days AS (
  SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) + INTERVAL '312' MONTH AS DATE) AS rate_date FROM orders
),
quotes AS (SELECT 'USD' AS currency, CAST(0.90 AS DECIMAL(18,10)) AS level UNION ALL SELECT 'GBP', CAST(1.15 AS DECIMAL(18,10))),
daily_rates AS (
  SELECT currency, rate_date,
    CAST(level + day(rate_date) * CAST(0.0010 AS DECIMAL(8,4)) + month(rate_date) * CAST(0.0001 AS DECIMAL(8,4)) AS DECIMAL(18,10)) AS rate,
    'ECB' AS source
  FROM rate_days CROSS JOIN quotes WHERE day(rate_date) <= 15
),
monthly_rates AS (
  SELECT DISTINCT currency, CAST(date_trunc('month', rate_date) AS DATE) AS rate_date,
    CAST(level + CAST(0.05 AS DECIMAL(8,4)) + month(rate_date) * CAST(0.001 AS DECIMAL(8,4)) AS DECIMAL(18,10)) AS rate,
    'BMF USt-Umrechnungskurs ' || strftime(rate_date, '%Y-%m') AS source
  FROM rate_days CROSS JOIN quotes WHERE month(rate_date) % 2 = 0
)"""

GRAINS = """
grains AS (SELECT 'year' AS grain UNION ALL SELECT 'quarter' UNION ALL SELECT 'month')"""


def period_sql(day: str) -> str:
    return (
        f"CASE grain WHEN 'year' THEN strftime({day}, '%Y') "
        f"WHEN 'quarter' THEN strftime({day}, '%Y') || '-Q' || quarter({day}) "
        f"ELSE strftime({day}, '%Y-%m') END"
    )


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
