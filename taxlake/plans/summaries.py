"""VAT summary, income-tax estimate, overview, monthly series, report metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxlake.operators import income_tax, ledger, reports
from taxlake.plans import books
from taxlake.plans.catalog import cut_lineage, flat, query
from taxlake.plans.oracle_base import DOCS, GRAINS, SETTINGS, period_sql, with_ctes

AS_OF = "2024-08-15"

# --- oracle pieces ---------------------------------------------------------------------------

_VAT_ROWS = """
vat_rows AS (
  SELECT b.*, vat_method,
    CASE WHEN vat_method = 'soll' THEN COALESCE(invoice_date, payment_date) ELSE COALESCE(payment_date, invoice_date) END AS vat_date,
    CASE WHEN base_bucket = 'confirmed' AND (CASE WHEN vat_method = 'soll' THEN invoice_date ELSE payment_date END) IS NULL
         THEN 'provisional' ELSE base_bucket END AS bucket,
    vat_method <> 'kleinunternehmer' AS taxed
  FROM bucketed b JOIN settings USING (tenant_id)
)"""

_OWED = "CAST(ROUND(CAST(COALESCE(net_amount_eur, 0) AS DECIMAL(28,2)) * CAST(0.19 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))"
_LINE_SQL = {
    "output_vat": ("direction = 'income' AND vat_treatment_code IN ('DE_DOMESTIC_19','DE_DOMESTIC_7') AND taxed", "COALESCE(vat_amount_eur, 0)"),
    "input_vat": ("direction = 'expense' AND vat_treatment_code = 'DE_EXPENSE_INPUT_VAT' AND taxed", "COALESCE(vat_amount_eur, 0)"),
    "reverse_charge_vat": ("direction = 'expense' AND vat_treatment_code = 'EXPENSE_REVERSE_CHARGE_13B'", _OWED),
    "reverse_charge_input_vat": ("direction = 'expense' AND vat_treatment_code = 'EXPENSE_REVERSE_CHARGE_13B' AND taxed", _OWED),
    "domestic_taxable_revenue": ("direction = 'income' AND vat_treatment_code IN ('DE_DOMESTIC_19','DE_DOMESTIC_7','KLEINUNTERNEHMER')", "net_value"),
    "eu_reverse_charge_revenue": ("direction = 'income' AND vat_treatment_code = 'EU_B2B_REVERSE_CHARGE_REVENUE'", "net_value"),
    "third_country_non_taxable_revenue": ("direction = 'income' AND vat_treatment_code = 'THIRD_COUNTRY_B2B_SERVICE'", "net_value"),
    "tax_exempt_revenue": ("direction = 'income' AND vat_treatment_code = 'DE_DOMESTIC_0_EXEMPT'", "net_value"),
}


def _vat_summary_cte() -> str:
    sums = ",\n".join(
        f"CAST(COALESCE(SUM(CASE WHEN {cond} AND bucket = '{b}' THEN {amount} END), 0) AS DOUBLE) AS {line}_{b}"
        for line, (cond, amount) in _LINE_SQL.items()
        for b in ledger.BUCKETS
    )
    payable = " + ".join(
        f"COALESCE(SUM(CASE WHEN {cond} AND bucket <> 'excluded' THEN {sign}{amount} END), 0)"
        for line, sign in (("output_vat", ""), ("reverse_charge_vat", ""), ("input_vat", "-"), ("reverse_charge_input_vat", "-"))
        for cond, amount in [_LINE_SQL[line]]
    )
    return f"""
vat_summary AS (
  SELECT tenant_id, grain, {period_sql('vat_date')} AS period, {sums},
    COUNT(CASE WHEN base_bucket = 'provisional' THEN 1 END) AS documents_needing_review,
    CAST(COALESCE(SUM(CASE WHEN base_bucket = 'provisional' AND direction = 'income' THEN gross_value END), 0) AS DOUBLE) AS revenue_needing_review,
    CAST(COALESCE(SUM(CASE WHEN base_bucket = 'provisional' AND direction = 'expense' THEN gross_value END), 0) AS DOUBLE) AS expenses_needing_review,
    CAST({payable} AS DOUBLE) AS estimated_payable
  FROM vat_rows CROSS JOIN grains WHERE vat_date IS NOT NULL GROUP BY ALL
)"""


_RECOGNIZED = """
recognized AS (
  SELECT b.*, vat_method, income_tax_method,
    CASE WHEN income_tax_method = 'euer' THEN
           CASE WHEN payment_status = 'paid' AND payment_date IS NOT NULL THEN payment_date
                WHEN payment_status = 'unpaid' THEN NULL ELSE invoice_date END
         ELSE invoice_date END AS rec_date,
    CASE WHEN income_tax_method = 'euer' THEN payment_status = 'paid' AND payment_date IS NOT NULL
         ELSE income_tax_method = 'accrual' END AS definitive,
    (income_tax_method = 'euer' AND NOT (payment_status = 'paid' AND payment_date IS NOT NULL)
      AND payment_status <> 'unpaid' AND invoice_date IS NOT NULL) AS pay_missing,
    CASE WHEN vat_method = 'kleinunternehmer' THEN gross_value ELSE net_value END AS value,
    (original_currency <> 'EUR' AND exchange_rate_to_eur IS NULL) IS TRUE AS rate_missing
  FROM bucketed b JOIN settings USING (tenant_id)
),
recognized2 AS (
  SELECT *, CASE WHEN base_bucket = 'confirmed' AND NOT definitive THEN 'provisional' ELSE base_bucket END AS bucket
  FROM recognized
)"""


def _side_sums(where: str = "TRUE") -> str:
    return ",\n".join(
        f"COALESCE(SUM(CASE WHEN direction = '{d}' AND bucket = '{b}' AND {where} THEN value END), 0) AS {name}_{b}"
        for d, name in (("income", "income"), ("expense", "expenses"))
        for b in ledger.BUCKETS
    )


def tariff_rows_sql() -> str:
    from taxlake.functions.tariff import TARIFFS

    names = "year, version, allowance, zone2_end, zone3_end, zone4_end, a2, b2, a3, b3, c3, rate4, sub4, rate5, sub5, threshold"
    rows = ", ".join(
        "(" + ", ".join(
            str(v) if i == 0 else f"'{v}'" if i == 1
            else f"CAST({v} AS DECIMAL(8,0))" if i in (2, 3, 4, 5, 15)
            else f"CAST({v} AS DECIMAL(10,4))"
            for i, v in enumerate(row)
        ) + ")"
        for row in TARIFFS
    )
    return f"tariff({names}) AS (VALUES {rows})"


def tax_cte(source: str, income: str) -> str:
    """Tax of ``source`` rows (columns year, assessment_type, church_tax, include_soli)."""
    return f"""
engine AS (
  SELECT y.year AS asked, t.*, t.year = y.year AS exact_year_match
  FROM (SELECT DISTINCT year FROM {source}) y
  JOIN tariff t ON t.year = COALESCE((SELECT MAX(year) FROM tariff WHERE year <= y.year), (SELECT MIN(year) FROM tariff))
),
zve AS (
  SELECT s.*, e.* EXCLUDE (asked, year), e.year AS tariff_year,
    CAST(GREATEST(FLOOR({income}), 0) AS BIGINT) AS z,
    CASE WHEN assessment_type = 'joint' THEN CAST(GREATEST(FLOOR({income}), 0) AS BIGINT) // 2 ELSE CAST(GREATEST(FLOOR({income}), 0) AS BIGINT) END AS x
  FROM {source} s JOIN engine e ON e.asked = s.year
),
zve2 AS (
  SELECT *, CAST((LEAST(GREATEST(x, allowance), zone2_end) - allowance) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(9,4)) AS yy,
    CAST((LEAST(GREATEST(x, zone2_end), zone3_end) - zone2_end) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(9,4)) AS zz
  FROM zve
),
zve3 AS (
  SELECT *,
    CAST(FLOOR(CASE WHEN x <= allowance THEN 0
      WHEN x <= zone2_end THEN CAST((a2 * yy + b2) * yy AS DECIMAL(30,12))
      WHEN x <= zone3_end THEN CAST((a3 * zz + b3) * zz + c3 AS DECIMAL(30,12))
      WHEN x <= zone4_end THEN CAST(CAST(x AS DECIMAL(14,0)) * rate4 - sub4 AS DECIMAL(30,12))
      ELSE CAST(CAST(x AS DECIMAL(14,0)) * rate5 - sub5 AS DECIMAL(30,12)) END) AS BIGINT)
      * CASE WHEN assessment_type = 'joint' THEN 2 ELSE 1 END AS tax,
    CASE WHEN x <= allowance THEN 0
      WHEN x <= zone2_end THEN CAST((a2 * yy * 2 + b2) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(24,12))
      WHEN x <= zone3_end THEN CAST((a3 * zz * 2 + b3) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(24,12))
      WHEN x <= zone4_end THEN rate4 ELSE rate5 END AS marginal,
    threshold * CASE WHEN assessment_type = 'joint' THEN 2 ELSE 1 END AS limit_
  FROM zve2
),
taxed AS (
  SELECT *,
    CAST(CASE WHEN include_soli AND tax > limit_ THEN
      FLOOR(LEAST(CAST(tax AS DECIMAL(14,0)) * CAST(0.055 AS DECIMAL(4,3)), (CAST(tax AS DECIMAL(14,0)) - limit_) * CAST(0.119 AS DECIMAL(4,3))) * 100) * CAST(0.01 AS DECIMAL(4,2))
      ELSE 0 END AS DECIMAL(18,2)) AS soli,
    CAST(ROUND(CAST(tax AS DECIMAL(14,0)) * CASE church_tax WHEN 'rate8' THEN CAST(0.08 AS DECIMAL(4,2)) WHEN 'rate9' THEN CAST(0.09 AS DECIMAL(4,2)) ELSE CAST(0 AS DECIMAL(4,2)) END, 2) AS DECIMAL(18,2)) AS church
  FROM zve3
)"""


def _estimate_ctes(as_of: str | None) -> list[str]:
    late = f"AND NOT (year(rec_date) = {as_of[:4]} AND rec_date > DATE '{as_of}')" if as_of else ""
    months = f"CASE WHEN y.year = {as_of[:4]} THEN {int(as_of[5:7])} ELSE 12 END" if as_of else "12"
    annual = f"y.year = {as_of[:4]}" if as_of else "FALSE"
    return [
        f"""
years AS (
  SELECT DISTINCT tenant_id, year(d) AS year FROM (
    SELECT tenant_id, invoice_date AS d FROM bucketed UNION ALL SELECT tenant_id, payment_date FROM bucketed) WHERE d IS NOT NULL
),
undated AS (SELECT tenant_id, COUNT(CASE WHEN base_bucket = 'excluded' THEN 1 END) AS undated_excluded FROM recognized2 WHERE rec_date IS NULL GROUP BY 1),
yearly AS (
  SELECT tenant_id, year(rec_date) AS year, {_side_sums()},
    COUNT(CASE WHEN bucket = 'excluded' THEN 1 END) AS excluded_count,
    COUNT(CASE WHEN bucket = 'provisional' THEN 1 END) AS provisional_count,
    COUNT(CASE WHEN pay_missing THEN 1 END) AS payment_dates_missing
  FROM recognized2 WHERE rec_date IS NOT NULL {late} GROUP BY 1, 2
),
figures AS (
  SELECT y.tenant_id, y.year,
    {", ".join(f"COALESCE({s}_{b}, 0) AS {s}_{b}" for s in ("income", "expenses") for b in ledger.BUCKETS)},
    COALESCE(excluded_count, 0) + COALESCE(undated_excluded, 0) AS excluded_count,
    COALESCE(provisional_count, 0) AS provisional_count, COALESCE(payment_dates_missing, 0) AS payment_dates_missing,
    CAST(COALESCE(income_confirmed, 0) + COALESCE(income_provisional, 0) - COALESCE(expenses_confirmed, 0) - COALESCE(expenses_provisional, 0) AS DECIMAL(18,2)) AS recorded_profit,
    {months} AS projection_months, {annual} AS is_annualized
  FROM years y LEFT JOIN yearly USING (tenant_id, year) LEFT JOIN undated u ON u.tenant_id = y.tenant_id
),
projected AS (
  SELECT f.*, settings.* EXCLUDE (tenant_id),
    CASE WHEN recorded_profit < 0 THEN -1 ELSE 1 END
      * CAST((CAST(abs(recorded_profit) * 1200 AS HUGEINT) * 2 + projection_months) // (2 * projection_months) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(4,2)) AS estimated_profit
  FROM figures f JOIN settings USING (tenant_id)
),
payers AS (
  SELECT *, CAST(GREATEST(0, estimated_profit + other_taxable_income - deductible_contributions) AS DECIMAL(18,2)) AS estimated_taxable_income FROM projected
)""",
        tariff_rows_sql(),
        tax_cte("payers", "estimated_taxable_income"),
        """
estimate AS (
  SELECT tenant_id, CAST(year AS BIGINT) AS year,
    CAST(income_confirmed AS DOUBLE) AS income_confirmed, CAST(income_provisional AS DOUBLE) AS income_provisional, CAST(income_excluded AS DOUBLE) AS income_excluded,
    CAST(expenses_confirmed AS DOUBLE) AS expenses_confirmed, CAST(expenses_provisional AS DOUBLE) AS expenses_provisional, CAST(expenses_excluded AS DOUBLE) AS expenses_excluded,
    CAST(recorded_profit AS DOUBLE) AS recorded_profit, CAST(estimated_profit AS DOUBLE) AS estimated_profit,
    CAST(other_taxable_income AS DOUBLE) AS other_taxable_income, CAST(deductible_contributions AS DOUBLE) AS deductible_contributions,
    CAST(estimated_taxable_income AS DOUBLE) AS estimated_taxable_income,
    CAST(tax AS DOUBLE) AS estimated_income_tax, CAST(soli AS DOUBLE) AS solidarity_surcharge, CAST(church AS DOUBLE) AS church_tax_amount,
    church_tax, include_soli AS include_solidarity_surcharge, CAST(income_tax_prepayments AS DOUBLE) AS prepayments,
    CAST(GREATEST(0, tax + soli + church - income_tax_prepayments) AS DOUBLE) AS suggested_reserve,
    version AS engine_version, exact_year_match,
    concat_ws('|', CASE income_tax_method WHEN 'euer' THEN 'cash_basis' WHEN 'accrual' THEN 'accrual_basis' ELSE 'method_not_set' END,
      CASE WHEN vat_method = 'kleinunternehmer' THEN 'gross_amounts' ELSE 'net_amounts' END,
      CASE WHEN NOT exact_year_match THEN 'tariff_year_fallback' END,
      CASE WHEN church_tax <> 'none' THEN 'church_tax_simplified' END,
      CASE WHEN include_soli THEN 'surcharge_simplified' END) AS assumptions,
    concat_ws('|', CASE WHEN payment_dates_missing > 0 THEN 'payment_dates_missing' END,
      CASE WHEN excluded_count > 0 THEN 'documents_excluded' END,
      CASE WHEN deductible_contributions = 0 THEN 'no_deductible_contributions' END) AS incomplete_items,
    payment_dates_missing, excluded_count, provisional_count, is_annualized, CAST(projection_months AS BIGINT) AS projection_months,
    CAST(12 AS DOUBLE) / projection_months AS projection_factor,
    is_annualized OR NOT (income_tax_method <> 'unsure' AND provisional_count = 0 AND payment_dates_missing = 0
      AND excluded_count = 0 AND deductible_contributions <> 0) AS is_estimate_only
  FROM taxed
)""",
    ]


_OVERVIEW = f"""
months AS (
  SELECT DISTINCT tenant_id, CAST(date_trunc('month', d) AS DATE) AS d FROM (
    SELECT tenant_id, invoice_date AS d FROM bucketed UNION ALL SELECT tenant_id, payment_date FROM bucketed) WHERE d IS NOT NULL
),
spine AS (SELECT DISTINCT tenant_id, grain, {period_sql('d')} AS period FROM months CROSS JOIN grains),
no_date AS (
  SELECT tenant_id, COUNT(CASE WHEN review_status = 'needs_review' THEN 1 END) AS r, COUNT(CASE WHEN pay_missing THEN 1 END) AS p,
    COUNT(CASE WHEN rate_missing THEN 1 END) AS x FROM recognized2 WHERE rec_date IS NULL GROUP BY 1
),
dated AS (
  SELECT tenant_id, grain, {period_sql('rec_date')} AS period, {_side_sums()},
    COUNT(CASE WHEN review_status = 'needs_review' THEN 1 END) AS r, COUNT(CASE WHEN pay_missing THEN 1 END) AS p,
    COUNT(CASE WHEN rate_missing THEN 1 END) AS x
  FROM recognized2 CROSS JOIN grains WHERE rec_date IS NOT NULL GROUP BY ALL
),
overview AS (
  SELECT s.tenant_id, s.grain, s.period,
    {", ".join(f"CAST(COALESCE({src}_{b}, 0) AS DOUBLE) AS {dst}_{b}" for src, dst in (("income", "revenue"), ("expenses", "expenses")) for b in ledger.BUCKETS)},
    COALESCE(d.r, 0) + COALESCE(n.r, 0) AS documents_needing_review,
    COALESCE(d.p, 0) + COALESCE(n.p, 0) AS payment_dates_missing,
    COALESCE(d.x, 0) + COALESCE(n.x, 0) AS exchange_rates_missing,
    CAST(COALESCE(income_confirmed, 0) + COALESCE(income_provisional, 0) - COALESCE(d.expenses_confirmed, 0) - COALESCE(d.expenses_provisional, 0) AS DOUBLE) AS profit
  FROM spine s LEFT JOIN dated d USING (tenant_id, grain, period) LEFT JOIN no_date n ON n.tenant_id = s.tenant_id
)"""

_VAT_BASE = [DOCS, SETTINGS, GRAINS, _VAT_ROWS]
_REC_BASE = [DOCS, SETTINGS, GRAINS, _RECOGNIZED]


# --- queries ---------------------------------------------------------------------------------

@query(
    "vat_summary_quarterly",
    with_ctes(*_VAT_BASE, _vat_summary_cte()) + "SELECT * FROM vat_summary WHERE grain = 'quarter'",
)
def vat_summary_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = ledger.ledger_cube(books.documents(spark, sf_dir))
    return flat(ledger.vat_summary(cube, books.settings(spark, sf_dir), ("quarter",)))


@query("vat_summary_all_periods", with_ctes(*_VAT_BASE, _vat_summary_cte()) + "SELECT * FROM vat_summary")
def vat_summary_all_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = ledger.ledger_cube(books.documents(spark, sf_dir))
    return flat(ledger.vat_summary(cube, books.settings(spark, sf_dir)))


_CONTRIBUTIONS = " UNION ALL ".join(
    f"SELECT tenant_id, CAST(vat_date AS VARCHAR) AS assigned_date, bucket, id, '{line}' AS line, CAST({amount} AS DOUBLE) AS amount "
    f"FROM vat_rows WHERE vat_date IS NOT NULL AND {cond}"
    for line, (cond, amount) in _LINE_SQL.items()
)


@query("vat_contributions", with_ctes(*_VAT_BASE) + _CONTRIBUTIONS)
def vat_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(ledger.vat_contributions(books.documents(spark, sf_dir), books.stored_settings(spark, sf_dir)))


@query("income_tax_estimate", with_ctes(*_REC_BASE, *_estimate_ctes(None)) + "SELECT * FROM estimate")
def income_tax_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = ledger.ledger_cube(books.documents(spark, sf_dir))
    tariffs = income_tax.resolve_tariffs(income_tax.tariff_table(spark))
    return flat(income_tax.income_tax_estimate(cube, books.settings(spark, sf_dir), tariffs))


@query("income_tax_projection", with_ctes(*_REC_BASE, *_estimate_ctes(AS_OF)) + "SELECT * FROM estimate")
def income_tax_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = ledger.ledger_cube(books.documents(spark, sf_dir), AS_OF)
    tariffs = income_tax.resolve_tariffs(income_tax.tariff_table(spark))
    return flat(income_tax.income_tax_estimate(cube, books.settings(spark, sf_dir), tariffs, AS_OF))


@query(
    "recognized_contributions",
    with_ctes(*_REC_BASE)
    + """SELECT tenant_id, id, direction, CAST(rec_date AS VARCHAR) AS recognition_date,
  CASE WHEN income_tax_method = 'euer' THEN CASE WHEN pay_missing THEN 'payment_date_missing' ELSE 'recognized_payment_date' END
       WHEN income_tax_method = 'accrual' THEN 'recognized_invoice_date' ELSE 'method_unsure' END AS reason,
  bucket, CAST(value AS DOUBLE) AS amount FROM recognized2 WHERE rec_date IS NOT NULL""",
)
def recognized_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(ledger.recognized_contributions(books.documents(spark, sf_dir), books.stored_settings(spark, sf_dir)))


def _overview(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overview, VAT summary and tax estimate over one materialized cube."""
    cube = cut_lineage(ledger.ledger_cube(books.documents(spark, sf_dir)))
    settings = books.settings(spark, sf_dir)
    vat = ledger.vat_summary(cube, settings)
    tax = income_tax.income_tax_estimate(
        cube, settings, income_tax.resolve_tariffs(income_tax.tariff_table(spark))
    )
    return ledger.overview(cube, settings, vat, tax), vat, tax


@query(
    "overview",
    with_ctes(*_REC_BASE, _VAT_ROWS, _vat_summary_cte(), _OVERVIEW, *_estimate_ctes(None))
    + """SELECT o.*, COALESCE(v.estimated_payable, 0) AS vat_payable, e.suggested_reserve
FROM overview o LEFT JOIN vat_summary v USING (tenant_id, grain, period)
LEFT JOIN estimate e ON e.tenant_id = o.tenant_id AND e.year = CAST(substr(o.period, 1, 4) AS BIGINT)""",
)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_overview(spark, sf_dir)[0])


@query(
    "monthly_series",
    with_ctes(*_REC_BASE)
    + """SELECT y.tenant_id, y.year, CAST(m.month AS BIGINT) AS month,
  CAST(COALESCE(SUM(CASE WHEN direction = 'income' AND bucket <> 'excluded' THEN value END), 0) AS DOUBLE) AS revenue,
  CAST(COALESCE(SUM(CASE WHEN direction = 'expense' AND bucket <> 'excluded' THEN value END), 0) AS DOUBLE) AS expenses
FROM (SELECT DISTINCT tenant_id, year(rec_date) AS year FROM recognized2 WHERE rec_date IS NOT NULL) y
CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m
LEFT JOIN recognized2 r ON r.tenant_id = y.tenant_id AND year(rec_date) = y.year AND month(rec_date) = m.month
GROUP BY ALL""",
)
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = ledger.ledger_cube(books.documents(spark, sf_dir))
    return flat(ledger.monthly_series(cube, books.settings(spark, sf_dir)))


_METRICS_SQL = ", ".join(
    f"('{line}', '{b}', v.{line}_{b})"
    for line in ("output_vat", "input_vat", "reverse_charge_vat")
    for b in ("confirmed", "provisional")
)


@query(
    "period_metrics",
    with_ctes(*_REC_BASE, _VAT_ROWS, _vat_summary_cte(), *_estimate_ctes(None))
    + f"""SELECT tenant_id, period, metric, bucket, value FROM (
  SELECT v.tenant_id, v.period, m.metric, m.bucket, m.value FROM vat_summary v,
    LATERAL (VALUES {_METRICS_SQL}, ('estimated_payable', 'total', v.estimated_payable),
      ('documents_needing_review', 'total', CAST(v.documents_needing_review AS DOUBLE)),
      ('amount_needing_review', 'total', CAST(CAST(v.revenue_needing_review AS DECIMAL(18,2)) + CAST(v.expenses_needing_review AS DECIMAL(18,2)) AS DOUBLE))) m(metric, bucket, value)
  UNION ALL
  SELECT e.tenant_id, CAST(e.year AS VARCHAR), m.metric, m.bucket, m.value FROM estimate e,
    LATERAL (VALUES ('income', 'confirmed', e.income_confirmed), ('income', 'provisional', e.income_provisional),
      ('expenses', 'confirmed', e.expenses_confirmed), ('expenses', 'provisional', e.expenses_provisional),
      ('estimated_profit', 'total', e.estimated_profit), ('estimated_taxable_income', 'total', e.estimated_taxable_income),
      ('estimated_income_tax', 'total', e.estimated_income_tax),
      ('recorded_profit_to_date', 'total', CASE WHEN e.is_annualized THEN e.recorded_profit END),
      ('solidarity_surcharge', 'total', CASE WHEN e.include_solidarity_surcharge THEN e.solidarity_surcharge END),
      ('church_tax', 'total', CASE WHEN e.church_tax <> 'none' THEN e.church_tax_amount END),
      ('prepayments', 'total', CASE WHEN e.prepayments <> 0 THEN e.prepayments END),
      ('suggested_reserve', 'total', e.suggested_reserve)) m(metric, bucket, value)
  UNION ALL
  SELECT tenant_id, {period_sql('invoice_date')}, 'documents_in_period', 'total', CAST(COUNT(*) AS DOUBLE)
  FROM bucketed CROSS JOIN grains WHERE invoice_date IS NOT NULL GROUP BY ALL
) WHERE value IS NOT NULL""",
)
def period_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = books.documents(spark, sf_dir)
    cube = cut_lineage(ledger.ledger_cube(docs))
    settings = books.settings(spark, sf_dir)
    tariffs = income_tax.resolve_tariffs(income_tax.tariff_table(spark))
    return flat(
        reports.period_metrics(
            ledger.vat_summary(cube, settings),
            income_tax.income_tax_estimate(cube, settings, tariffs),
            cube,
        )
    )


@query(
    "tariff_table",
    with_ctes(
        tariff_rows_sql(),
        """asked AS (
  SELECT DISTINCT CAST(year(CAST(CAST(o_orderdate AS DATE) + INTERVAL '312' MONTH AS DATE)) AS INTEGER) AS year FROM orders)""",
    )
    + """SELECT CAST(a.year AS BIGINT) AS year, CAST(t.year AS BIGINT) AS tariff_year, version, a.year = t.year AS exact_year_match,
  CAST(allowance AS DOUBLE) AS allowance, CAST(zone4_end AS DOUBLE) AS zone4_end, CAST(a2 AS DOUBLE) AS a2, CAST(sub5 AS DOUBLE) AS sub5,
  CAST(threshold AS DOUBLE) AS threshold_single, CAST(threshold * 2 AS DOUBLE) AS threshold_joint
FROM asked a JOIN tariff t ON t.year = COALESCE((SELECT MAX(year) FROM tariff WHERE year <= a.year), (SELECT MIN(year) FROM tariff))""",
)
def tariff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = (
        books.table(spark, sf_dir, "orders")
        .select(F.year(F.add_months(F.col("o_orderdate").cast("date"), books.SHIFT_MONTHS)).alias("year"))
        .distinct()
    )
    tariffs = income_tax.resolve_tariffs(income_tax.tariff_table(spark))
    return flat(
        years.join(tariffs, "year").select(
            "year", "tariff_year", "version", "exact_year_match", "allowance", "zone4_end", "a2", "sub5",
            "threshold_single", "threshold_joint",
        )
    )


_PAYERS = """payers AS (
  SELECT o_orderkey AS payer_id, CAST(2019 + o_orderkey % 10 AS INTEGER) AS year, CAST(o_totalprice AS DECIMAL(18,2)) AS income,
    CASE WHEN o_orderkey % 2 = 0 THEN 'single' ELSE 'joint' END AS assessment_type,
    CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'rate8' ELSE 'rate9' END AS church_tax,
    o_orderkey % 7 <> 0 AS include_soli
  FROM orders)"""


@query(
    "taxpayer_tax",
    with_ctes(_PAYERS, tariff_rows_sql(), tax_cte("payers", "income"))
    + """SELECT payer_id, CAST(year AS BIGINT) AS year, CAST(income AS DOUBLE) AS taxable_income, assessment_type, church_tax AS church_tax_setting,
  version, exact_year_match, CAST(tax AS DOUBLE) AS income_tax, CAST(soli AS DOUBLE) AS solidarity_surcharge,
  CAST(church AS DOUBLE) AS church_tax, CAST(tax + soli + church AS DOUBLE) AS total,
  CAST(CAST(ROUND(marginal * 100, 2) AS DECIMAL(9,2)) AS DOUBLE) AS marginal_rate_percent,
  CASE WHEN z > 0 THEN CAST(CAST((CAST(tax AS HUGEINT) * 20000 + z) // (2 * z) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(4,2)) AS DOUBLE) ELSE 0 END AS average_rate_percent
FROM taxed""",
)
def taxpayer_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    payers = books.table(spark, sf_dir, "orders").select(
        key.alias("payer_id"),
        (key % 10 + 2019).cast("int").alias("year"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("taxable_income"),
        F.when(key % 2 == 0, "single").otherwise("joint").alias("assessment_type"),
        F.when(key % 3 == 0, "none").when(key % 3 == 1, "rate8").otherwise("rate9").alias("church_tax_setting"),
        (key % 7 != 0).alias("include_soli"),
    )
    tariffs = income_tax.resolve_tariffs(income_tax.tariff_table(spark))
    taxed = income_tax.taxpayer_tax(
        payers.withColumnsRenamed(
            {"church_tax_setting": "church_setting", "include_soli": "include_solidarity_surcharge"}
        ).withColumn("church_tax", F.col("church_setting")),
        tariffs,
        keep=["payer_id", "year", "taxable_income", "assessment_type", F.col("church_setting").alias("church_tax_setting")],
    )
    return flat(taxed.drop("tariff_year"))
