"""State changes, re-extraction, settings changes, audit trail and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxlake.functions import verdicts
from taxlake.operators import changes, ledger
from taxlake.plans import books
from taxlake.plans.catalog import cut_lineage, flat, query
from taxlake.plans.oracle_base import DOCS, RATES, SETTINGS, with_ctes


def change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as changes: eight events per document, some of documents that don't exist."""
    return books.table(spark, sf_dir, "events").selectExpr(
        "IF(event_id % 97 = 0, concat('X', event_id), concat('O', event_id DIV 8)) AS id",
        "CAST(event_id AS BIGINT) AS change_id",
        "CAST(ts AS TIMESTAMP) AS at",
        """CASE event_type WHEN 'click' THEN 'payment' WHEN 'view' THEN 'patch' WHEN 'signup' THEN 'confirm'
             WHEN 'purchase' THEN IF(event_id % 3 = 0, 'direction', 'treatment')
             ELSE CASE event_id % 5 WHEN 3 THEN 'restore' WHEN 4 THEN 'purge' ELSE 'delete' END END AS kind""",
        "IF(event_id % 2 = 0, 'description', 'grossAmountOriginal') AS field",
        """CASE event_type WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'invoice_date' WHEN 1 THEN 'not_paid' WHEN 2 THEN 'unknown' ELSE '2024-05-05' END
             WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN concat('note ', event_id % 6) WHEN event_id % 11 = 5 THEN 'n/a'
                 ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END
             WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN IF(event_id % 2 = 0, 'income', 'expense')
                 ELSE IF(event_id % 5 = 0, 'DE_EXPENSE_INPUT_VAT', 'DE_DOMESTIC_0_EXEMPT') END END AS value""",
    )


def resolved_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.resolve(books.documents(spark, sf_dir), change_table(spark, sf_dir))


def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ledger.with_settings(
        books.documents(spark, sf_dir), books.stored_settings(spark, sf_dir).select("tenant_id", "vat_method")
    ).withColumn("manual_override", F.lit(False))
    return changes.apply_changes(docs, change_table(spark, sf_dir))


# The counterpart replays the changes one by one, each on the state that the one before it left.
_REPLAY = """
chg AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY moment, change_id) AS place FROM (
    SELECT CASE WHEN event_id % 97 = 0 THEN 'X' || event_id ELSE 'O' || (event_id // 8) END AS id, CAST(event_id AS BIGINT) AS change_id, ts AS moment,
      CASE event_type WHEN 'click' THEN 'payment' WHEN 'view' THEN 'patch' WHEN 'signup' THEN 'confirm'
        WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'direction' ELSE 'treatment' END
        ELSE CASE event_id % 5 WHEN 3 THEN 'restore' WHEN 4 THEN 'purge' ELSE 'delete' END END AS kind,
      CASE WHEN event_id % 2 = 0 THEN 'description' ELSE 'grossAmountOriginal' END AS field,
      CASE event_type WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'invoice_date' WHEN 1 THEN 'not_paid' WHEN 2 THEN 'unknown' ELSE '2024-05-05' END
        WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'note ' || (event_id % 6) WHEN event_id % 11 = 5 THEN 'n/a'
          ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END
        WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'income' ELSE 'expense' END
          ELSE CASE WHEN event_id % 5 = 0 THEN 'DE_EXPENSE_INPUT_VAT' ELSE 'DE_DOMESTIC_0_EXEMPT' END END END AS value
    FROM events)
),
replay AS (
  SELECT id, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS change_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS TIMESTAMP) AS moment,
    CAST('start' AS VARCHAR) AS fate, is_deleted AS trashed, FALSE AS gone, CAST('kept' AS VARCHAR) AS lifecycle,
    direction, vat_treatment_code AS code, FALSE AS by_hand, description, CAST(gross_amount_original AS VARCHAR) AS gross,
    CAST(payment_date AS VARCHAR) AS paid_on, payment_status, CAST(invoice_date AS VARCHAR) AS invoice_date,
    CAST(NULL AS VARCHAR) AS was, CAST(NULL AS VARCHAR) AS was_status, CAST(NULL AS VARCHAR) AS wanted, CAST(NULL AS VARCHAR) AS wanted_status
  FROM docs WHERE id IN (SELECT id FROM chg)
  UNION ALL
  SELECT id, place, change_id, kind, field, moment, fate,
    CASE WHEN fate = 'live' AND kind IN ('delete', 'restore') THEN kind = 'delete' ELSE trashed END,
    gone OR (fate = 'live' AND kind = 'purge'),
    CASE WHEN fate = 'live' THEN CASE kind WHEN 'delete' THEN 'deleted' WHEN 'restore' THEN 'restored' WHEN 'purge' THEN 'purged' ELSE lifecycle END ELSE lifecycle END,
    CASE WHEN fate = 'live' AND kind = 'direction' THEN wanted ELSE direction END,
    CASE WHEN fate = 'live' AND kind = 'treatment' THEN wanted ELSE code END,
    CASE WHEN fate = 'live' AND kind IN ('treatment', 'direction') THEN kind = 'treatment' ELSE by_hand END,
    CASE WHEN fate = 'live' AND kind = 'patch' AND field = 'description' THEN wanted ELSE description END,
    CASE WHEN fate = 'live' AND kind = 'patch' AND field = 'grossAmountOriginal' THEN wanted ELSE gross END,
    CASE WHEN fate = 'live' AND kind = 'payment' THEN wanted ELSE paid_on END,
    CASE WHEN fate = 'live' AND kind = 'payment' THEN wanted_status ELSE payment_status END,
    invoice_date, was, was_status, wanted, wanted_status
  FROM (
    SELECT *,
      CASE WHEN gone THEN 'purged'
        WHEN kind IN ('restore', 'purge') THEN CASE WHEN trashed THEN 'live' ELSE 'not_in_trash' END
        WHEN trashed THEN 'in_trash'
        WHEN kind IN ('delete', 'confirm') THEN 'live'
        WHEN kind = 'patch' AND field = 'grossAmountOriginal' AND TRY_CAST(wanted AS DECIMAL(18,2)) IS NULL THEN 'invalid'
        WHEN kind = 'treatment' THEN CASE WHEN (direction = 'income') = (wanted = 'DE_DOMESTIC_0_EXEMPT') THEN 'live' ELSE 'invalid' END
        WHEN kind = 'payment' AND wanted_status IS NULL THEN 'invalid'
        WHEN was IS NOT DISTINCT FROM wanted AND was_status IS NOT DISTINCT FROM wanted_status THEN 'same'
        ELSE 'live' END AS fate
    FROM (
      SELECT r.id, c.place, c.change_id, c.kind, c.field, c.moment, r.trashed, r.gone, r.lifecycle, r.direction, r.code, r.by_hand, r.description, r.gross, r.paid_on, r.payment_status, r.invoice_date,
        CASE c.kind WHEN 'patch' THEN CASE c.field WHEN 'description' THEN r.description ELSE r.gross END
          WHEN 'payment' THEN r.paid_on WHEN 'direction' THEN r.direction WHEN 'treatment' THEN r.code END AS was,
        CASE WHEN c.kind = 'payment' THEN r.payment_status END AS was_status,
        CASE WHEN c.kind <> 'payment' THEN c.value WHEN c.value = 'invoice_date' THEN r.invoice_date WHEN c.value NOT IN ('not_paid', 'unknown') THEN c.value END AS wanted,
        CASE WHEN c.kind = 'payment' THEN CASE WHEN c.value = 'not_paid' THEN 'unpaid' WHEN c.value = 'unknown' THEN 'unknown'
          WHEN c.value = 'invoice_date' AND r.invoice_date IS NULL THEN NULL ELSE 'paid' END END AS wanted_status
      FROM replay r JOIN chg c ON c.id = r.id AND c.place = r.place + 1))
)
"""


def _replayed(select: str) -> str:
    return with_ctes(DOCS, _REPLAY).replace("WITH", "WITH RECURSIVE", 1) + select


@query(
    "changes_applied",
    _replayed(
        """SELECT id, trashed AS is_deleted, description, CAST(gross AS DOUBLE) AS gross_amount_original, payment_status,
  paid_on AS payment_date, direction, by_hand AS chosen_by_hand, CASE WHEN by_hand THEN code END AS chosen_treatment, lifecycle
FROM replay QUALIFY row_number() OVER (PARTITION BY id ORDER BY place DESC) = 1"""
    ),
)
def changes_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifecycle = F.when(F.col("outcome").isin("purged", "deleted", "restored"), F.col("outcome")).otherwise("kept")
    return flat(
        changed_documents(spark, sf_dir).select(
            "id",
            F.col("deleted_at").isNotNull().alias("is_deleted"),
            "description",
            "gross_amount_original",
            "payment_status",
            "payment_date",
            "direction",
            F.col("manual_override").alias("chosen_by_hand"),
            F.when(F.col("manual_override"), F.col("vat_treatment_code")).alias("chosen_treatment"),
            lifecycle.alias("lifecycle"),
        )
    )


@query(
    "change_fates",
    _replayed(
        """SELECT id, change_id, kind, fate FROM replay WHERE place > 0
UNION ALL SELECT id, change_id, kind, 'unknown_document' FROM chg WHERE id NOT IN (SELECT id FROM docs)"""
    ),
)
def change_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(resolved_changes(spark, sf_dir).select("id", "change_id", "kind", "fate"))


@query(
    "change_rejects",
    _replayed(
        """SELECT fate AS reason, kind, count(*) AS changes FROM (SELECT kind, fate FROM replay WHERE place > 0
UNION ALL SELECT kind, 'unknown_document' FROM chg WHERE id NOT IN (SELECT id FROM docs)) WHERE fate <> 'live' GROUP BY ALL"""
    ),
)
def change_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = changes.rejected_changes(resolved_changes(spark, sf_dir))
    return flat(rejects.groupBy("reason", "kind").agg(F.count("*").alias("changes")))


@query("change_outcomes")
def change_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.lifecycle_counts(changed_documents(spark, sf_dir))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ledger.with_settings(
        books.documents(spark, sf_dir), books.stored_settings(spark, sf_dir).select("tenant_id", "vat_method")
    ).withColumn("manual_override", F.lit(False))
    resolved = cut_lineage(changes.resolve(docs, change_table(spark, sf_dir)))  # read by the state and by the audit
    return changes.audit_rows(resolved, changes.apply_changes(docs, resolved))


@query(
    "change_audit",
    _replayed(
        """SELECT id AS document_id, change_id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS "at",
  CASE kind WHEN 'patch' THEN 'manual_correction' WHEN 'payment' THEN 'payment_date_change' WHEN 'direction' THEN 'direction_change'
    WHEN 'treatment' THEN 'tax_classification_change' WHEN 'purge' THEN 'hard_delete' ELSE kind END AS event_type,
  CASE kind WHEN 'patch' THEN '{"field":"' || field || '"' || COALESCE(',"value":"' || was || '"', '') || '}'
    WHEN 'payment' THEN '{' || COALESCE('"payment_date":"' || was || '",', '') || '"payment_status":"' || was_status || '"}'
    WHEN 'direction' THEN '{"direction":"' || was || '"}' WHEN 'treatment' THEN '{"vat_treatment_code":"' || was || '"}' END AS previous_value,
  CASE kind WHEN 'patch' THEN '{"field":"' || field || '","value":"' || wanted || '"}'
    WHEN 'payment' THEN '{' || COALESCE('"payment_date":"' || wanted || '",', '') || '"payment_status":"' || wanted_status || '"}'
    WHEN 'direction' THEN '{"direction":"' || wanted || '"}' WHEN 'treatment' THEN '{"vat_treatment_code":"' || wanted || '"}'
    WHEN 'delete' THEN '{"trashed":true}' END AS next_value
FROM replay WHERE fate = 'live' AND kind <> 'confirm'"""
    ),
)
def change_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows but for confirmations, which rest on the issues of the whole document."""
    return flat(_audit(spark, sf_dir).filter("event_type <> 'confirm'"))


@query("change_confirmations")
def change_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_audit(spark, sf_dir).filter("event_type = 'confirm'").drop("change_id"))


@query(
    "audit_trail",
    """SELECT 'O' || (event_id // 2) AS document_id, event_id, event_type,
  row_number() OVER (PARTITION BY event_id // 2 ORDER BY ts, event_id) AS step FROM events""",
)
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = books.table(spark, sf_dir, "events").selectExpr(
        "concat('O', event_id DIV 2) AS document_id", "event_id", "event_type", "ts AS created_at"
    )
    return flat(changes.audit_trail(events).select("document_id", "event_id", "event_type", "step"))


@query(
    "current_versions",
    """SELECT 'U' || user_id AS id, arg_max(event_type, ts) AS state, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY 1""",
)
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = books.table(spark, sf_dir, "events").selectExpr(
        "concat('U', user_id) AS id", "event_type AS state", "CAST(ts AS TIMESTAMP) AS updated_at"
    )
    return flat(changes.latest_versions(versions))


@query(
    "settings_diff",
    with_ctes(SETTINGS)
    + """SELECT tenant_id, field, previous_value, next_value FROM (
  SELECT tenant_id, 'vat_method' AS field, vat_method AS previous_value, CASE WHEN tenant_id % 2 = 0 THEN 'soll' ELSE vat_method END AS next_value FROM stored_settings
  UNION ALL SELECT tenant_id, 'church_tax', church_tax, 'none' FROM stored_settings) WHERE previous_value <> next_value""",
)
def settings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = books.settings(spark, sf_dir)
    wanted = stored.withColumns(
        {
            "vat_method": F.when(F.col("tenant_id") % 2 == 0, "soll").otherwise(F.col("vat_method")),
            "church_tax": F.lit("none"),
        }
    )
    return flat(changes.settings_diff(stored, wanted))


@query(
    "reextract_merge",
    with_ctes(DOCS)
    + """SELECT id, CASE WHEN k % 5 = 0 THEN description ELSE 'read again' END AS description,
  CAST(CASE WHEN k % 7 = 0 THEN net_amount_original ELSE base_net + 1 END AS DOUBLE) AS net_amount_original,
  concat_ws('|', CASE WHEN k % 5 <> 0 THEN 'description' END, CASE WHEN k % 7 <> 0 THEN 'netAmountOriginal' END) AS changed_fields,
  'needs_review' AS review_status
FROM docs WHERE NOT is_deleted AND review_status <> 'confirmed' AND k % 11 <> 0""",
)
def reextract_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = books.documents(spark, sf_dir)
    k = F.col("k")
    fresh = docs.select(
        "id",
        # some readings were made from an older version of the document
        F.when(k % 11 == 0, F.col("updated_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("updated_at")).alias("read_at"),
        F.lit("read again").alias("description"),
        (F.col("base_net") + 1).cast("decimal(18,2)").alias("net_amount_original"),
        "field_confidence",
        "issues",
    )
    edits = F.array_compact(
        F.array(F.when(k % 5 == 0, F.lit("description")), F.when(k % 7 == 0, F.lit("netAmountOriginal")))
    )
    audit = docs.select(F.col("id").alias("document_id"), F.explode(edits).alias("field")).select(
        "document_id",
        F.lit("manual_correction").alias("event_type"),
        F.lit("user").alias("source"),
        F.to_json(F.struct("field")).alias("next_value"),
    )
    merged = changes.merge_reextraction(docs, fresh, audit)
    return flat(merged.select("id", "description", "net_amount_original", "changed_fields", "review_status"))


@query(
    "reextract_dependents",
    with_ctes(
        DOCS,
        RATES,
        """
merged AS (
  SELECT *, CASE WHEN k % 9 = 0 AND k % 5 <> 0 THEN 'USD' ELSE original_currency END AS currency,
    CASE WHEN k % 7 = 0 THEN net_amount_original ELSE base_net + 1 END AS net, COALESCE(invoice_date, DATE '2024-03-10') AS day,
    k % 10 = 0 AND exchange_rate_to_eur IS NOT NULL AS by_hand
  FROM docs WHERE NOT is_deleted AND review_status <> 'confirmed' AND k % 11 <> 0
),
daily AS (
  SELECT m.id, CASE WHEN r.rate_date >= m.day - 7 THEN r.rate END AS rate
  FROM merged m ASOF LEFT JOIN daily_rates r ON m.currency = r.currency AND m.day >= r.rate_date
),
rated AS (
  SELECT m.*, CASE WHEN by_hand THEN exchange_rate_to_eur WHEN m.currency <> 'EUR' THEN COALESCE(o.rate, d.rate) END AS rate
  FROM merged m LEFT JOIN daily d USING (id)
  LEFT JOIN monthly_rates o ON o.currency = m.currency AND o.rate_date = CAST(date_trunc('month', m.day) AS DATE)
)""",
    )
    + """SELECT id, currency AS original_currency, CAST(rate AS DOUBLE) AS rate_to_eur,
  CAST(CASE WHEN currency = 'EUR' THEN net ELSE ROUND(CAST(net AS DECIMAL(26,2)) * rate, 2) END AS DOUBLE) AS net_amount_eur,
  CAST(document_date + 30 AS VARCHAR) AS due_date, CASE WHEN k % 6 = 0 THEN vat_treatment_code END AS chosen_code,
  COALESCE(currency <> 'EUR', FALSE) AND rate IS NULL AS rate_missing FROM rated""",
)
def reextract_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New readings with another currency or amount: rates, EUR amounts, dates and chosen treatments."""
    k = F.col("k")
    docs = ledger.with_settings(
        books.documents(spark, sf_dir), books.stored_settings(spark, sf_dir).select("tenant_id", "vat_method")
    ).withColumns(
        {
            "manual_override": k % 6 == 0,
            "due_date": F.lit(None).cast("date"),
            "exchange_rate_source": F.when((k % 10 == 0) & F.col("exchange_rate_to_eur").isNotNull(), "manual"),
        }
    )
    fresh = docs.select(
        "id", "vat_rates",
        F.when(k % 11 == 0, F.col("updated_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("updated_at")).alias("read_at"),
        (F.col("base_net") + 1).cast("decimal(18,2)").alias("net_amount_original"),
        F.when(k % 9 == 0, "USD").otherwise(F.col("original_currency")).alias("original_currency"),
        F.date_add("document_date", 30).alias("due_date"), "field_confidence",
        F.filter("issues", lambda i: i["code"] != "missing_exchange_rate").alias("issues"),
    )
    edits = F.array_compact(F.array(F.when(k % 5 == 0, "originalCurrency"), F.when(k % 7 == 0, "netAmountOriginal")))
    audit = docs.select(F.col("id").alias("document_id"), F.explode(edits).alias("field")).select(
        "document_id", F.lit("manual_correction").alias("event_type"), F.lit("user").alias("source"),
        F.to_json(F.struct("field")).alias("next_value"),
    )
    done = changes.reextract(docs, fresh, audit, books.exchange_rates(spark, sf_dir), F.lit("2024-03-10").cast("date"))
    return flat(
        done.select(
            "id", "original_currency", F.col("exchange_rate_to_eur").alias("rate_to_eur"), "net_amount_eur", "due_date",
            F.when(F.col("manual_override"), F.col("vat_treatment_code")).alias("chosen_code"),
            F.array_contains("review_reasons", "missing_exchange_rate").alias("rate_missing"),
        )
    )


@query(
    "changes_rates",
    with_ctes(
        DOCS,
        RATES,
        """
patched AS (
  SELECT *, COALESCE(invoice_date, DATE '2024-03-10') AS day, CASE WHEN k % 2 = 0 THEN 'GBP' ELSE 'USD' END AS currency,
    COALESCE(original_currency, '') <> CASE WHEN k % 2 = 0 THEN 'GBP' ELSE 'USD' END AS moved
  FROM docs WHERE direction = 'income' AND NOT is_deleted
),
daily AS (
  SELECT p.id, CASE WHEN r.rate_date >= p.day - 7 THEN r.rate END AS rate
  FROM patched p ASOF LEFT JOIN daily_rates r ON p.currency = r.currency AND p.day >= r.rate_date
),
rated AS (
  SELECT p.*, CASE WHEN NOT moved THEN exchange_rate_to_eur ELSE COALESCE(exchange_rate_to_eur, o.rate, d.rate) END AS rate
  FROM patched p LEFT JOIN daily d USING (id)
  LEFT JOIN monthly_rates o ON o.currency = p.currency AND o.rate_date = CAST(date_trunc('month', p.day) AS DATE)
)""",
    )
    + """SELECT id, currency AS original_currency, CAST(rate AS DOUBLE) AS rate_to_eur,
  CAST(CASE WHEN NOT moved THEN net_amount_eur ELSE ROUND(CAST(net_amount_original AS DECIMAL(26,2)) * rate, 2) END AS DOUBLE) AS net_amount_eur FROM rated""",
)
def changes_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new currency for every income document; those without a rate get the official one."""
    docs = ledger.with_settings(
        books.documents(spark, sf_dir).where("direction = 'income' AND deleted_at IS NULL"),
        books.stored_settings(spark, sf_dir).select("tenant_id", "vat_method"),
    )
    feed = docs.selectExpr(
        "id", "k AS change_id", "created_at AS at", "'patch' AS kind", "'originalCurrency' AS field", "IF(k % 2 = 0, 'GBP', 'USD') AS value"
    )
    done = changes.apply_changes(docs, feed, books.exchange_rates(spark, sf_dir), F.lit("2024-03-10").cast("date"))
    return flat(done.select("id", "original_currency", F.col("exchange_rate_to_eur").alias("rate_to_eur"), "net_amount_eur"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers written from the documents: right in other notation, wrong, or unreadable."""
    docs = books.documents(spark, sf_dir)
    answer = F.expr(
        """CASE WHEN k % 17 = 0 THEN 'no json' ELSE concat('Sure: {"fields":{"invoiceNumber":{"agrees":false,"suggested":"re ', k,
             '","confidence":"high"},"netAmountOriginal":{"agrees":false,"suggested":"',
             IF(k % 2 = 0, translate(format_number(base_net, 2), ',.', '.,'), '0,01'), ' EUR","confidence":"', IF(k % 3 = 0, 'low', 'medium'),
             '"},"description":{"agrees":true,"suggested":null},"dueDate":{"agrees":"yes"}}} done') END"""
    )
    return docs.select(F.col("id").alias("document_id"), verdicts.parse_output(answer).alias("fields")).filter(
        F.col("fields").isNotNull()
    )


def _confidence_sql(index: int) -> str:
    return f"CAST(CASE WHEN (k + {index}) % 12 = 0 THEN 0 ELSE (55 + (k * 3 + {index * 7}) % 45) * 0.01 END AS DECIMAL(4,2))"


@query(
    "verdict_merge",
    with_ctes(
        DOCS,
        f"""
judged AS (
  SELECT *, {_confidence_sql(0)} AS c_number, {_confidence_sql(14)} AS c_net, {_confidence_sql(12)} AS c_text,
    invoice_number IS NULL AS number_wrong,
    net_amount_original IS NULL OR (k % 2 = 1 AND base_net <> CAST(0.01 AS DECIMAL(18,2))) AS net_wrong, k % 3 = 0 AS net_unsure
  FROM docs WHERE k % 17 <> 0
)""",
    )
    + """SELECT id,
  number_wrong OR (net_wrong AND NOT net_unsure) OR c_number < 0.92 AND NOT number_wrong OR c_number > 0.55 AND number_wrong
    OR NOT net_unsure AND CASE WHEN net_wrong THEN c_net > 0.55 ELSE c_net < 0.85 END OR (description IS NOT NULL AND c_text < 0.85) AS changed,
  CAST(number_wrong::INT + net_wrong::INT AS BIGINT) AS disagreements,
  concat_ws('|', CASE WHEN k % 37 = 0 THEN 'conflicting_totals:grossAmount' END,
    CASE WHEN has_missing_rate THEN 'missing_exchange_rate:exchangeRateToEur' END, CASE WHEN k % 14 = 0 THEN 'unclear_business_status:recipientIsBusiness' END,
    CASE WHEN k % 15 = 0 THEN 'ambiguous_date_format:invoiceDate' END, CASE WHEN k % 16 = 0 THEN 'missing_description:description' END,
    CASE WHEN k % 18 = 0 THEN 'unclear_recipient_country:recipientCountryCode' END, CASE WHEN k % 61 = 0 THEN 'llm_disagreement:currency' END,
    CASE WHEN number_wrong THEN 'llm_disagreement:invoiceNumber' END, CASE WHEN net_wrong AND NOT net_unsure THEN 'llm_disagreement:netAmountOriginal' END) AS issues
FROM judged""",
)
def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "invoiceNumber": "invoice_number", "netAmountOriginal": "net_amount_original", "description": "description",
    }
    merged = verdicts.merge(books.documents(spark, sf_dir), _verdicts(spark, sf_dir), columns)
    codes = F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["field"]))
    return flat(merged.select("id", "changed", "disagreements", codes.alias("issues")))


@query(
    "verdict_disagreements",
    with_ctes(DOCS)
    + """SELECT id, CAST(CASE WHEN k % 67 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 109 <> 0 AND k % 2 = 0 THEN 0 ELSE CASE WHEN k % 109 = 0 THEN 1 WHEN base_net = CAST(0.01 AS DECIMAL(18,2)) THEN 0 ELSE 1 END END AS BIGINT) AS disagreements
FROM docs WHERE k % 17 <> 0""",
)
def verdict_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_merge(spark, sf_dir).select("id", "disagreements")
