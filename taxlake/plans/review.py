"""Attention levels, issue rules, lists, exports, names and quality checks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxlake.functions import names, review
from taxlake.operators import exports, intake, listing, quality
from taxlake.plans import books
from taxlake.plans.catalog import flat, query
from taxlake.plans.oracle_base import DOCS, with_ctes

# --- oracle pieces ---------------------------------------------------------------------------

_ISSUES = """
issue_docs AS (
  SELECT *, list_filter([
    CASE WHEN has_conflicting_totals THEN {code: 'conflicting_totals', sev: 'critical', field: 'grossAmountOriginal'} END,
    CASE WHEN has_missing_rate THEN {code: 'missing_exchange_rate', sev: 'critical', field: 'exchangeRateToEur'} END,
    CASE WHEN k % 14 = 0 THEN {code: 'unclear_business_status', sev: 'warning', field: 'recipientIsBusiness'} END,
    CASE WHEN k % 15 = 0 THEN {code: 'ambiguous_date_format', sev: 'warning', field: 'invoiceDate'} END,
    CASE WHEN k % 16 = 0 THEN {code: 'missing_description', sev: 'warning', field: 'description'} END,
    CASE WHEN k % 18 = 0 THEN {code: 'unclear_recipient_country', sev: 'info', field: 'recipientCountryCode'} END,
    CASE WHEN k % 61 = 0 THEN {code: 'llm_disagreement', sev: 'warning', field: 'originalCurrency'} END
  ], lambda x: x IS NOT NULL) AS issues,
  original_currency IS NOT NULL AND original_currency <> 'EUR' AND exchange_rate_to_eur IS NULL AS no_rate,
  abs(net_amount_original + vat_amount_original - gross_amount_original) AS gap,
  list_transform(range(17), lambda i: CASE WHEN (k + i) % 12 = 0 THEN 0 ELSE 55 + (k * 3 + i * 7) % 45 END) AS conf
  FROM docs
)"""

_NAMES = (
    "['invoiceNumber','invoiceDate','serviceDateFrom','serviceDateTo','dueDate','paymentDate','issuerName','issuerCountryCode',"
    "'issuerVatId','recipientName','recipientCountryCode','recipientVatId','description','originalCurrency','netAmountOriginal',"
    "'vatAmountOriginal','grossAmountOriginal']"
)

_FINDINGS = f"""
findings AS (
  SELECT id, f.issue.code AS code, f.issue.field AS field,
    CASE WHEN f.issue.code = 'missing_exchange_rate' THEN CASE WHEN exchange_rate_to_eur IS NOT NULL THEN 0 ELSE 3 END
      WHEN f.issue.sev = 'critical' THEN 3 WHEN f.issue.sev = 'info' THEN 0
      WHEN f.issue.code = 'ambiguous_date_format' AND conf[2] >= 85 THEN 0
      WHEN f.issue.code = 'llm_disagreement' THEN 2
      WHEN f.issue.code IN ('unclear_business_status', 'unclear_recipient_country') THEN 2 ELSE 1 END AS r
  FROM issue_docs, LATERAL (SELECT unnest(issues) AS issue) f
  UNION ALL SELECT id, '', 'invoiceDate', 3 FROM issue_docs WHERE invoice_date IS NULL
  UNION ALL SELECT id, '', 'originalCurrency', 3 FROM issue_docs WHERE original_currency IS NULL
  UNION ALL SELECT id, '', 'grossAmountOriginal', 3 FROM issue_docs WHERE gross_amount_original IS NULL AND net_amount_original IS NULL
  UNION ALL SELECT id, '', 'exchangeRateToEur', 3 FROM issue_docs WHERE no_rate
  UNION ALL SELECT id, '', 'vatTreatmentCode', CASE WHEN k % 3 = 0 OR vat_treatment_code = 'UNKNOWN_REVIEW' THEN 2 ELSE 1 END FROM issue_docs WHERE k % 12 = 0
  UNION ALL SELECT id, '', field, CASE WHEN v <= 0 THEN 0
      WHEN core AND v < 85 AND NOT (v >= 65 AND COALESCE(gap <= 0.02, FALSE) AND
        CASE WHEN field IN ('netAmountOriginal', 'vatAmountOriginal') THEN conf[17] >= 85
             WHEN field = 'grossAmountOriginal' THEN conf[15] >= 85 AND conf[16] >= 85 ELSE FALSE END) THEN 2
      WHEN NOT core AND v < 65 THEN 1 ELSE 0 END
  FROM (SELECT id, conf, gap, conf[i] AS v, {_NAMES}[i] AS field, i IN (2, 14, 15, 16, 17) AS core
        FROM issue_docs, LATERAL (SELECT unnest(range(1, 18)) AS i))
),
levels AS (
  SELECT d.id, d.tenant_id, d.is_deleted, d.review_status = 'confirmed' AND NOT no_rate AND NOT (exchange_rate_to_eur IS NULL AND has_missing_rate) AS done,
    GREATEST(COALESCE(m.r, 0), CASE review_status WHEN 'failed' THEN 3 WHEN 'processing' THEN 1 ELSE 0 END) AS top
  FROM issue_docs d LEFT JOIN (SELECT id, MAX(r) AS r FROM findings GROUP BY 1) m USING (id)
),
leveled AS (
  SELECT *, CASE WHEN done THEN 'confirmed' ELSE ['ok','minor','warning','critical'][top + 1] END AS level FROM levels
)"""


def _attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    docs = books.documents(spark, sf_dir).withColumn(
        "vat_classification",
        F.struct(
            (k % 12 == 0).alias("requires_confirmation"),
            F.when(k % 3 == 0, "low").otherwise("high").alias("confidence"),
            F.col("vat_treatment_code").alias("code"),
        ),
    )
    return review.with_attention(docs)


@query("attention_levels", with_ctes(DOCS, _ISSUES, _FINDINGS) + "SELECT id, level FROM leveled")
def attention_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attention(spark, sf_dir).select("id", "attention.level")


@query(
    "attention_fields",
    with_ctes(DOCS, _ISSUES, _FINDINGS)
    + """SELECT f.id, field, ['minor','warning','critical'][MAX(r)] AS tier FROM findings f JOIN leveled l USING (id)
WHERE r > 0 AND NOT done GROUP BY f.id, field""",
)
def attention_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the outer form keeps the planner from repeating the whole analysis in an inferred filter
    fields = _attention(spark, sf_dir).select("id", F.explode_outer("attention.fields").alias("field", "tier"))
    return fields.filter(F.col("field").isNotNull())


@query(
    "attention_counts",
    with_ctes(DOCS, _ISSUES, _FINDINGS)
    + """SELECT t.tenant_id, v.level, COUNT(l.id) AS documents
FROM (SELECT DISTINCT tenant_id FROM leveled WHERE NOT is_deleted) t
CROSS JOIN (VALUES ('confirmed'), ('ok'), ('minor'), ('warning'), ('critical')) v(level)
LEFT JOIN leveled l ON l.tenant_id = t.tenant_id AND l.level = v.level AND NOT l.is_deleted GROUP BY 1, 2""",
)
def attention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(listing.attention_counts(listing.active(_attention(spark, sf_dir))))


@query(
    "attention_filtered",
    with_ctes(DOCS, _ISSUES, _FINDINGS) + "SELECT id, level FROM leveled WHERE level IN ('warning', 'critical') AND NOT is_deleted",
)
def attention_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.by_attention(listing.active(_attention(spark, sf_dir)), ["warning", "critical"])
    return rows.select("id", "attention.level")


@query(
    "missing_values",
    with_ctes(DOCS, _ISSUES)
    + """SELECT id, concat_ws('|', CASE WHEN invoice_date IS NULL THEN 'invoiceDate' END, CASE WHEN original_currency IS NULL THEN 'originalCurrency' END,
  CASE WHEN gross_amount_original IS NULL AND net_amount_original IS NULL THEN 'grossAmountOriginal' END, CASE WHEN no_rate THEN 'exchangeRateToEur' END) AS missing,
  payment_date IS NULL AND payment_status <> 'unpaid' AS payment_date_missing, no_rate AS exchange_rate_missing FROM issue_docs""",
)
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(
        books.documents(spark, sf_dir).select(
            "id",
            review.missing_required().alias("missing"),
            listing.payment_date_missing().alias("payment_date_missing"),
            listing.exchange_rate_missing().alias("exchange_rate_missing"),
        )
    )


@query(
    "issues_resolved",
    with_ctes(DOCS, _ISSUES)
    + """SELECT id, COALESCE(list_aggregate(list_transform(list_filter(issues, lambda x: NOT CASE x.code
    WHEN 'conflicting_totals' THEN COALESCE(gap <= 0.02, TRUE)
    WHEN 'missing_exchange_rate' THEN exchange_rate_to_eur IS NOT NULL
    WHEN 'unclear_business_status' THEN recipient_is_business IS NOT NULL
    WHEN 'ambiguous_date_format' THEN invoice_date IS NOT NULL
    WHEN 'missing_description' THEN description IS NOT NULL
    WHEN 'unclear_recipient_country' THEN recipient_country_code IS NOT NULL
    ELSE FALSE END), lambda x: x.code), 'string_agg', '|'), '') AS open_codes FROM issue_docs""",
)
def issues_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_issues = review.drop_resolved(books.documents(spark, sf_dir))
    return flat(open_issues.select("id", F.col("review_reasons").alias("open_codes")))


_CORE = """
core AS (
  SELECT *, list_filter(issues, lambda x: NOT (x.code = 'missing_exchange_rate' AND (COALESCE(original_currency = 'EUR', FALSE) OR exchange_rate_to_eur IS NOT NULL))) AS kept FROM issue_docs
),
core2 AS (
  SELECT *, list_concat(list_transform(kept, lambda x: x.code || ':' || x.sev), list_filter([
      CASE WHEN invoice_date IS NULL THEN 'missing_invoice_date:critical' END,
      CASE WHEN original_currency IS NULL THEN 'unknown_currency:critical' END,
      CASE WHEN gross_amount_original IS NULL AND net_amount_original IS NULL THEN 'missing_amount:critical' END,
      CASE WHEN no_rate AND NOT has_missing_rate THEN 'missing_exchange_rate:critical' END,
      CASE WHEN gap > 0.02 AND NOT has_conflicting_totals THEN 'conflicting_totals:critical' END
    ], lambda x: x IS NOT NULL)) AS all_codes
  FROM core
)"""


@query(
    "core_issues",
    with_ctes(DOCS, _ISSUES, _CORE)
    + "SELECT id, COALESCE(list_aggregate(all_codes, 'string_agg', '|'), '') AS issues FROM core2",
)
def core_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.core_issues(books.documents(spark, sf_dir))
    codes = F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["severity"]))
    return flat(rows.select("id", codes.alias("issues")))


@query(
    "confirmable",
    with_ctes(DOCS, _ISSUES, _CORE)
    + "SELECT id, len(list_filter(all_codes, lambda x: x LIKE '%:critical')) = 0 AS confirmable FROM core2 WHERE NOT is_deleted",
)
def confirmable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.core_issues(listing.active(books.documents(spark, sf_dir)))
    return rows.select("id", (~review.has_critical()).alias("confirmable"))


@query(
    "document_confidence",
    with_ctes(DOCS, _ISSUES)
    + """SELECT id, CAST(CAST((CAST(list_sum(conf) AS BIGINT) * 20 + 17) // 34 AS DECIMAL(18,0)) * CAST(0.001 AS DECIMAL(4,3)) AS DOUBLE) AS confidence,
  concat_ws('|', COALESCE(list_aggregate(list_transform(issues, lambda x: x.code), 'string_agg', '|'), NULL), CASE WHEN k % 12 = 0 THEN 'vat_classification_unconfirmed' END) AS review_reasons
FROM issue_docs""",
)
def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(
        books.documents(spark, sf_dir).select(
            "id",
            review.document_confidence(F.col("field_confidence")).alias("confidence"),
            review.intake_reasons(F.col("k") % 12 == 0).alias("review_reasons"),
        )
    )


@query(
    "field_evidence_dropped",
    with_ctes(DOCS, _ISSUES)
    + f"""SELECT id, list_aggregate(list_sort(list_filter({_NAMES}, lambda n: NOT (n = 'originalCurrency' OR (k % 2 = 0 AND n = 'invoiceDate')))), 'string_agg', '|') AS kept_fields,
  COALESCE(list_aggregate(list_transform(list_filter(issues, lambda x: x.code <> 'llm_disagreement'), lambda x: x.code), 'string_agg', '|'), '') AS issue_codes
FROM issue_docs""",
)
def field_evidence_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("k") % 2 == 0, F.array(F.lit("originalCurrency"), F.lit("invoiceDate"))).otherwise(
        F.array(F.lit("originalCurrency"))
    )
    rows = review.drop_field_evidence(books.documents(spark, sf_dir), changed)
    kept = F.array_sort(F.transform(F.map_keys("field_confidence"), review.canonical_field))
    codes = F.transform("issues", lambda i: i["code"])
    return flat(rows.select("id", kept.alias("kept_fields"), codes.alias("issue_codes")))


# --- lists -----------------------------------------------------------------------------------

_LIST_COLUMNS = "id, direction, CAST(invoice_date AS VARCHAR) AS invoice_date, review_status, vat_treatment_code"


def _list_columns(rows: DataFrame) -> DataFrame:
    return flat(rows.select("id", "direction", "invoice_date", "review_status", "vat_treatment_code"))


@query(
    "document_list_newest",
    with_ctes(DOCS)
    + f"SELECT {_LIST_COLUMNS} FROM docs WHERE NOT is_deleted AND direction = 'income' AND review_status = 'confirmed' AND vat_treatment_code = 'DE_DOMESTIC_19' ORDER BY docs.invoice_date DESC NULLS LAST, created_at DESC, id LIMIT 100",
)
def document_list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.list_filter(books.documents(spark, sf_dir), "income", "confirmed", "DE_DOMESTIC_19")
    return _list_columns(listing.page(rows))


@query(
    "document_list_oldest",
    with_ctes(DOCS)
    + f"SELECT {_LIST_COLUMNS} FROM docs WHERE ((tax_year = 2024 AND tax_quarter = 2) OR tax_year IS NULL) ORDER BY docs.invoice_date ASC NULLS LAST, created_at, id LIMIT 100 OFFSET 50".replace(
        "tax_year", "year(docs.invoice_date)"
    ).replace("tax_quarter", "quarter(docs.invoice_date)"),
)
def document_list_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.list_filter(
        books.documents(spark, sf_dir), year=2024, quarter=2, include_unassigned=True, include_deleted=True
    )
    return _list_columns(listing.page(rows, "oldest", 100, 50))


@query(
    "list_recent",
    with_ctes(DOCS) + f"SELECT {_LIST_COLUMNS} FROM docs WHERE NOT is_deleted ORDER BY created_at DESC, id LIMIT 4",
)
def list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list_columns(listing.page(listing.active(books.documents(spark, sf_dir)), "recent", 4))


@query(
    "list_search",
    with_ctes(DOCS)
    + "SELECT id, description FROM docs WHERE NOT is_deleted AND (issuer_name ILIKE '%50!%!_b%' ESCAPE '!' OR recipient_name ILIKE '%50!%!_b%' ESCAPE '!' OR description ILIKE '%50!%!_b%' ESCAPE '!' OR invoice_number ILIKE '%50!%!_b%' ESCAPE '!' OR original_filename ILIKE '%50!%!_b%' ESCAPE '!')",
)
def list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_filter(books.documents(spark, sf_dir), term=" 50%_b ").select("id", "description")


@query(
    "list_counts",
    with_ctes(DOCS)
    + "SELECT tenant_id, COUNT(CASE WHEN NOT is_deleted AND direction = 'expense' THEN 1 END) AS matching, COUNT(CASE WHEN is_deleted THEN 1 END) AS trashed, COUNT(*) AS total FROM docs GROUP BY 1",
)
def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(listing.list_counts(books.documents(spark, sf_dir), F.col("direction") == "expense"))


@query("trash_list", with_ctes(DOCS) + "SELECT id, original_filename FROM docs WHERE is_deleted")
def trash_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.trashed(books.documents(spark, sf_dir)).select("id", "original_filename")


@query(
    "period_membership",
    with_ctes(DOCS)
    + """SELECT id, COALESCE(year(invoice_date) = 2024 AND quarter(invoice_date) = 3, FALSE) AS stored_quarter,
  COALESCE(year(payment_date) = 2024 AND month(payment_date) = 7, FALSE) AS paid_in_month,
  COALESCE(year(invoice_date) = 2024, FALSE) AS in_year FROM docs""",
)
def period_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.documents(spark, sf_dir).select(
        "id",
        exports.in_stored_period(2024, 3).alias("stored_quarter"),
        exports.in_period("payment_date", 2024, 3, 7).alias("paid_in_month"),
        exports.in_period("invoice_date", 2024).alias("in_year"),
    )


@query(
    "verification_eligible",
    "SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE COALESCE(quality, 0) = 0 AND length(trim(text)) > 0",
)
def verification_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = books.table(spark, sf_dir, "documents").withColumnRenamed("text", "extracted_text")
    labels = books.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = texts.join(labels, "doc_id", "left").withColumns(
        {
            "deleted_at": F.lit(None).cast("timestamp"),
            "review_status": F.when(F.col("quality") == 1, "confirmed").otherwise("needs_review"),
        }
    )
    return rows.filter(listing.verification_eligible()).select("doc_id", "source")


# --- exports, names, intake ------------------------------------------------------------------

@query(
    "export_rows",
    with_ctes(DOCS, _ISSUES)
    + """SELECT id, direction, CAST(invoice_date AS VARCHAR) AS invoice_date, invoice_number, issuer_name, recipient_name, description,
  CAST(payment_date AS VARCHAR) AS payment_date, payment_status, original_currency AS currency,
  CAST(net_amount_original AS DOUBLE) AS net_original, CAST(vat_amount_original AS DOUBLE) AS vat_original, CAST(gross_amount_original AS DOUBLE) AS gross_original,
  CAST(exchange_rate_to_eur AS DOUBLE) AS exchange_rate_to_eur, CAST(net_amount_eur AS DOUBLE) AS net_eur, CAST(vat_amount_eur AS DOUBLE) AS vat_eur, CAST(gross_amount_eur AS DOUBLE) AS gross_eur,
  vat_treatment_code AS vat_treatment, CAST(year(invoice_date) AS BIGINT) AS tax_year, CAST(quarter(invoice_date) AS BIGINT) AS tax_quarter, review_status,
  COALESCE(list_aggregate(list_transform(issues, lambda x: x.code), 'string_agg', '|'), '') AS issues, original_filename,
  'documents/' || year(invoice_date) || '/Q' || quarter(invoice_date) || '/' || direction || '/' || original_filename AS stored_path
FROM issue_docs WHERE NOT is_deleted AND year(invoice_date) = 2024""",
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = listing.active(books.documents(spark, sf_dir)).filter(exports.in_stored_period(2024))
    stored = names.storage_folder(F.col("tax_period_year"), F.col("tax_period_quarter"), F.col("direction"))
    rows = docs.withColumn("stored_relative_path", F.concat_ws("/", stored, "original_filename"))
    return flat(exports.export_rows(rows))


def _clean_sql(value: str, limit: int) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({value}), '\\s+', '-', 'g'), '([-_.])[-_.]+', '\\1', 'g'), "
        f"'^[-_.,;!]+', ''), '[-_.,;!]+$', '')"
    )


@query(
    "name_keys",
    with_ctes(
        DOCS,
        f"""named AS (
  SELECT id, tenant_id, created_at,
    CASE WHEN invoice_date IS NULL THEN 'documents/unassigned/' || direction ELSE 'documents/' || year(invoice_date) || '/Q' || quarter(invoice_date) || '/' || direction END AS folder,
    COALESCE(strftime(invoice_date, '%Y_%m_%d'), 'Unknown-Date') || '-' ||
    {_clean_sql("replace(CASE WHEN direction = 'income' THEN recipient_name ELSE issuer_name END, '#', '#')", 60)} || '_' ||
    COALESCE({_clean_sql("regexp_replace(description, ' [0-9]+$', '')", 60)}, 'Unknown-Service') || '-' ||
    COALESCE(CASE WHEN k % 5 <> 0 THEN invoice_number END, 'Unknown-Invoice') AS stem
  FROM docs
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, folder, stem ORDER BY created_at, id) AS n FROM named)""",
    )
    + "SELECT id, folder, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.pdf' AS stored_filename FROM ranked",
)
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = books.documents(spark, sf_dir)
    company = F.when(F.col("direction") == "income", F.col("recipient_name")).otherwise(F.col("issuer_name"))
    rows = names.with_storage_name(
        docs,
        "name",
        F.col("invoice_date"),
        company,
        F.regexp_replace("description", " [0-9]+$", ""),
        F.when(F.col("k") % 5 != 0, F.col("invoice_number")),
    ).select(
        "id",
        "tenant_id",
        "created_at",
        names.storage_folder(F.col("tax_period_year"), F.col("tax_period_quarter"), F.col("direction")).alias("folder"),
        "name",
    )
    return names.with_unique_names(rows, "folder", "name").select("id", "folder", "stored_filename")


@query(
    "intake_outcomes",
    """SELECT 'import-' || (user_id) AS import_id, COUNT(*) AS total,
  COUNT(CASE WHEN event_type = 'click' THEN 1 END) AS ok, COUNT(CASE WHEN event_type IN ('view', 'purchase') THEN 1 END) AS review,
  COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events GROUP BY 1""",
)
def intake_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.intake_outcomes(intake.jobs_from_events(books.table(spark, sf_dir, "events")))


@query(
    "filing_periods",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' ELSE 'yearly' END AS frequency,
  strftime(o_orderdate, '%Y') || CASE WHEN o_orderkey % 3 < 2 THEN '-Q' || quarter(o_orderdate) ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '-M' || month(o_orderdate) ELSE '' END AS period
FROM orders""",
)
def filing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taxlake.functions.periods import filing_period

    key = F.col("o_orderkey")
    frequency = F.when(key % 3 == 0, "monthly").when(key % 3 == 1, "quarterly").otherwise("yearly")
    rows = books.table(spark, sf_dir, "orders").select(
        "o_orderkey", frequency.alias("frequency"), F.col("o_orderdate").cast("date").alias("today")
    ).withColumn("p", filing_period(F.col("today"), F.col("frequency")))
    return rows.select(
        "o_orderkey",
        "frequency",
        F.concat_ws(
            "-",
            F.col("p.year").cast("string"),
            F.concat(F.lit("Q"), F.col("p.quarter").cast("string")),
            F.concat(F.lit("M"), F.col("p.month").cast("string")),
        ).alias("period"),
    )


# --- quality ---------------------------------------------------------------------------------

_PARAMS = """
params AS (
  SELECT p_partkey AS row_id, 2024 + CAST(p_partkey % 3 AS INTEGER) AS year,
    CASE WHEN p_partkey % 7 = 1 THEN 9000 ELSE 12096 END AS allowance, 17443 AS zone2_end,
    CASE WHEN p_partkey % 11 = 1 THEN 17000 ELSE 68480 END AS zone3_end, 277825 AS zone4_end,
    CASE WHEN p_partkey % 13 = 1 THEN -1 ELSE 932.3 END AS a2, CASE WHEN p_partkey % 17 = 1 THEN 1100 ELSE 1400 END AS b2,
    176.64 AS a3, 2397 AS b3, CASE WHEN p_partkey % 5 = 1 THEN 1100.5 ELSE 1015.13 END AS c3,
    CASE WHEN p_partkey % 19 = 1 THEN 0.39 ELSE 0.42 END AS rate4, 10911.92 AS sub4,
    CASE WHEN p_partkey % 23 = 1 THEN 0.42 ELSE 0.45 END AS rate5, CASE WHEN p_partkey % 29 = 1 THEN NULL ELSE 19246.67 END AS sub5
  FROM part
)"""


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")

    def pick(n: int, odd: str, usual: str):
        return F.when(k % n == 1, F.lit(Decimal(odd))).otherwise(F.lit(Decimal(usual)))

    return books.table(spark, sf_dir, "part").select(
        k.alias("row_id"),
        (k % 3 + 2024).cast("int").alias("year"),
        pick(7, "9000", "12096").alias("allowance"),
        F.lit(Decimal(17443)).alias("zone2_end"),
        pick(11, "17000", "68480").alias("zone3_end"),
        F.lit(Decimal(277825)).alias("zone4_end"),
        pick(13, "-1", "932.3").alias("a2"),
        pick(17, "1100", "1400").alias("b2"),
        F.lit(Decimal("176.64")).alias("a3"),
        F.lit(Decimal(2397)).alias("b3"),
        pick(5, "1100.5", "1015.13").alias("c3"),
        pick(19, "0.39", "0.42").alias("rate4"),
        F.lit(Decimal("10911.92")).alias("sub4"),
        pick(23, "0.42", "0.45").alias("rate5"),
        F.when(k % 29 != 1, F.lit(Decimal("19246.67"))).alias("sub5"),
        F.when(k % 31 == 1, "bad label!").otherwise("gii-20260715").alias("label"),
    )


@query(
    "tariff_quality",
    with_ctes(
        _PARAMS,
        """basic AS (
  SELECT *, concat_ws('|', CASE WHEN allowance < 10000 OR allowance > 25000 THEN 'basic_allowance_out_of_range' END,
    CASE WHEN NOT (allowance < zone2_end AND zone2_end < zone3_end AND zone3_end < zone4_end) THEN 'boundaries_not_ascending' END,
    CASE WHEN a2 <= 0 OR a3 <= 0 OR c3 <= 0 OR sub4 <= 0 OR sub5 <= 0 THEN 'non_positive_parameter' END,
    CASE WHEN b2 < 1200 OR b2 > 1600 THEN 'entry_rate_not_near_14_percent' END,
    CASE WHEN rate4 < 0.4 OR rate4 > 0.44 THEN 'zone4_rate_not_near_42_percent' END,
    CASE WHEN rate5 < 0.43 OR rate5 > 0.48 THEN 'zone5_rate_not_near_45_percent' END,
    CASE WHEN rate5 <= rate4 THEN 'top_rate_not_above_zone4_rate' END) AS early,
    (zone2_end - allowance) / 10000.0 AS y, (zone3_end - zone2_end) / 10000.0 AS z
  FROM params
)""",
    )
    + """SELECT row_id, CASE WHEN sub5 IS NULL THEN 'non_finite_parameter' WHEN early <> '' THEN early ELSE
  concat_ws('|', CASE WHEN abs((a2 * y + b2) * y - c3) > 2 THEN 'discontinuous_at_zone2_end' END,
    CASE WHEN abs((a3 * z + b3) * z + c3 - (rate4 * zone3_end - sub4)) > 2 THEN 'discontinuous_at_zone3_end' END,
    CASE WHEN abs(rate4 * zone4_end - sub4 - (rate5 * zone4_end - sub5)) > 2 THEN 'discontinuous_at_zone4_end' END,
    CASE WHEN abs((2 * a3 * z + b3) / 10000 - rate4) > 0.02 THEN 'zone3_exit_rate_mismatch' END) END AS errors,
  row_id % 31 <> 1 AS label_ok FROM basic""",
)
def tariff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _params(spark, sf_dir)
    return flat(
        rows.select("row_id", quality.tariff_errors().alias("errors"), quality.label_ok(F.col("label")).alias("label_ok"))
    )


@query(
    "soli_quality",
    """WITH s AS (
  SELECT p_partkey AS row_id, CASE WHEN p_partkey % 7 = 1 THEN 9999 WHEN p_partkey % 41 = 1 THEN NULL ELSE 19950 END AS ts,
    CASE WHEN p_partkey % 11 = 1 THEN 39901 ELSE 39900 END AS tj, CASE WHEN p_partkey % 13 = 1 THEN 0.2 ELSE 0.055 END AS r,
    CASE WHEN p_partkey % 17 = 1 THEN 0.05 ELSE 0.119 END AS m FROM part)
SELECT row_id, CASE WHEN ts IS NULL THEN 'non_finite_parameter' ELSE concat_ws('|',
  CASE WHEN ts < 10000 OR ts > 100000 THEN 'single_threshold_out_of_range' END, CASE WHEN tj < 20000 OR tj > 200000 THEN 'joint_threshold_out_of_range' END,
  CASE WHEN tj <> 2 * ts THEN 'joint_threshold_not_double' END, CASE WHEN r < 0.04 OR r > 0.07 THEN 'rate_out_of_range' END,
  CASE WHEN m < 0.08 OR m > 0.18 THEN 'mitigation_rate_out_of_range' END, CASE WHEN m <= r THEN 'mitigation_rate_not_above_rate' END) END AS errors FROM s""",
)
def soli_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = books.table(spark, sf_dir, "part").select(
        k.alias("row_id"),
        F.when(k % 7 == 1, F.lit(Decimal("9999"))).when(k % 41 == 1, F.lit(None)).otherwise(F.lit(Decimal("19950"))).alias("threshold_single"),
        F.when(k % 11 == 1, F.lit(Decimal("39901"))).otherwise(F.lit(Decimal("39900"))).alias("threshold_joint"),
        F.when(k % 13 == 1, F.lit(Decimal("0.2"))).otherwise(F.lit(Decimal("0.055"))).alias("soli_rate"),
        F.when(k % 17 == 1, F.lit(Decimal("0.05"))).otherwise(F.lit(Decimal("0.119"))).alias("mitigation_rate"),
    )
    return flat(rows.select("row_id", quality.soli_errors().alias("errors")))


@query(
    "row_quality",
    with_ctes(DOCS)
    + """SELECT id, concat_ws('|', CASE WHEN invoice_date IS NULL THEN 'invoice_date' END,
  CASE WHEN review_status = 'processing' THEN 'review_status' END,
  CASE WHEN length(CASE WHEN k % 3 = 0 THEN repeat('x', 301) ELSE issuer_name END) > 300 THEN 'issuer_name' END,
  CASE WHEN k % 43 = 1 THEN 'exchange_rate_to_eur' END) AS violations FROM docs""",
)
def row_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = books.documents(spark, sf_dir).select(
        "id",
        F.coalesce(F.col("invoice_date").cast("string"), F.lit("2024-02-30")).alias("invoice_date"),
        "review_status",
        F.when(k % 3 == 0, F.repeat(F.lit("x"), 301)).otherwise(F.col("issuer_name")).alias("issuer_name"),
        F.when(k % 43 == 1, F.lit(Decimal("-1"))).otherwise(F.lit(Decimal("1"))).alias("exchange_rate_to_eur"),
    )
    checks = quality.RowContract(
        lengths={"issuer_name": 300},
        dates=["invoice_date"],
        enums={"review_status": ("needs_review", "confirmed", "failed")},
        positive=["exchange_rate_to_eur"],
    )
    return flat(rows.select("id", quality.row_violations(checks).alias("violations")))
