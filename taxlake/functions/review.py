"""Review rules: attention tiers, resolved issues, core issues, field evidence.

Everything works on the small per-document arrays and maps, inside one row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxlake.functions.rates import is_iso_currency

# --- fixed values ----------------------------------------------------------------------------
FIELD_ALIASES = {
    "currency": "originalCurrency",
    "netAmount": "netAmountOriginal",
    "vatAmount": "vatAmountOriginal",
    "grossAmount": "grossAmountOriginal",
    "vatTreatment": "vatTreatmentCode",
}
TAX_RELEVANT_CODES = (
    "missing_exchange_rate", "non_iso_currency", "possible_duplicate", "refund_detected",
    "possibly_not_invoice", "unclear_business_status", "unclear_recipient_country",
)
TAX_RELEVANT_FIELDS = (
    "invoiceNumber", "invoiceDate", "originalCurrency", "netAmountOriginal", "vatAmountOriginal",
    "grossAmountOriginal", "exchangeRateToEur",
)
CORE_FIELDS = (
    "invoiceDate", "originalCurrency", "grossAmountOriginal", "netAmountOriginal", "vatAmountOriginal",
)
CORE_THRESHOLD = Decimal("0.85")
SUPPORTING_THRESHOLD = Decimal("0.65")
TOTALS_TOLERANCE = Decimal("0.02")
LEVELS = ("confirmed", "ok", "minor", "warning", "critical")
# --- end of fixed values ----------------------------------------------------------------------

# document field -> column of the documents table
FIELD_COLUMNS = {
    "invoiceNumber": "invoice_number",
    "invoiceDate": "invoice_date",
    "serviceDateFrom": "service_date_from",
    "serviceDateTo": "service_date_to",
    "paymentDate": "payment_date",
    "dueDate": "due_date",
    "issuerName": "issuer_name",
    "issuerCountryCode": "issuer_country_code",
    "issuerVatId": "issuer_vat_id",
    "recipientName": "recipient_name",
    "recipientCountryCode": "recipient_country_code",
    "recipientVatId": "recipient_vat_id",
    "recipientIsBusiness": "recipient_is_business",
    "description": "description",
    "originalCurrency": "original_currency",
    "netAmountOriginal": "net_amount_original",
    "vatAmountOriginal": "vat_amount_original",
    "grossAmountOriginal": "gross_amount_original",
    "exchangeRateToEur": "exchange_rate_to_eur",
    "vatTreatmentCode": "vat_treatment_code",
}

ISSUE_TYPE = "struct<code:string,severity:string,message_key:string,field:string,params:map<string,string>>"


def canonical_field(field: Column) -> Column:
    chain = F
    for alias, name in FIELD_ALIASES.items():
        chain = chain.when(field == alias, F.lit(name))
    return chain.otherwise(field)


def confidence_keys(field: str) -> list[str]:
    """The canonical key and its alias, as both can occur in a confidence map."""
    name = FIELD_ALIASES.get(field, field)
    return [name] + [alias for alias, target in FIELD_ALIASES.items() if target == name and alias != "vatTreatment"]


def confidence_for(confidence: Column, field: str) -> Column:
    """Highest confidence under any of the field's keys; null when there is none."""
    values = [F.try_element_at(confidence, F.lit(key)) for key in confidence_keys(field)]
    return F.greatest(*values) if len(values) > 1 else values[0]


def _at_least(value: Column, limit: Decimal) -> Column:
    return F.coalesce(value >= F.lit(limit), F.lit(False))


def issue_rank(issue: Column, has_rate: Column, date_confidence: Column) -> Column:
    """0 nothing, 1 minor, 2 warning, 3 critical."""
    code, severity = issue["code"], issue["severity"]
    named = canonical_field(F.coalesce(F.try_element_at(issue["params"], F.lit("field")), issue["field"], F.lit("")))
    return (
        F.when(code == "missing_exchange_rate", F.when(has_rate, 0).otherwise(3))
        .when(severity == "critical", 3)
        .when(severity == "info", 0)
        .when((code == "ambiguous_date_format") & _at_least(date_confidence, CORE_THRESHOLD), 0)
        .when((code == "non_iso_currency") & has_rate, 0)
        .when(code == "llm_disagreement", F.when(named.isin(*TAX_RELEVANT_FIELDS), 2).otherwise(1))
        .when(code.isin(*TAX_RELEVANT_CODES), 2)
        .otherwise(1)
    )


def foreign_without_rate() -> Column:
    foreign = F.upper(F.trim("original_currency")) != "EUR"
    return F.coalesce(foreign, F.lit(False)) & F.col("exchange_rate_to_eur").isNull()


def missing_required() -> Column:
    """Fields a document cannot be counted without."""
    return F.array_compact(
        F.array(
            F.when(F.col("invoice_date").isNull(), F.lit("invoiceDate")),
            F.when(F.col("original_currency").isNull(), F.lit("originalCurrency")),
            F.when(
                F.col("gross_amount_original").isNull() & F.col("net_amount_original").isNull(),
                F.lit("grossAmountOriginal"),
            ),
            F.when(foreign_without_rate(), F.lit("exchangeRateToEur")),
        )
    )


def totals_gap() -> Column:
    """|net + vat - gross|, null unless all three are known."""
    return F.abs(F.col("net_amount_original") + F.col("vat_amount_original") - F.col("gross_amount_original"))


def with_attention(documents: DataFrame) -> DataFrame:
    """Add ``attention`` struct(level, fields): the one status of a document and of its fields."""
    confidence = F.col("field_confidence")
    has_rate = F.col("exchange_rate_to_eur").isNotNull()
    date_confidence = confidence_for(confidence, "invoiceDate")
    finding = "array<struct<field:string,rank:int>>"

    issues = F.filter(
        F.transform(
            "issues",
            lambda i: F.struct(
                canonical_field(F.coalesce(F.try_element_at(i["params"], F.lit("field")), i["field"])).alias("field"),
                issue_rank(i, has_rate, date_confidence).alias("rank"),
            ),
        ),
        lambda f: f["rank"] > 0,
    ).cast(finding)
    missing = F.transform(
        F.col("_missing"), lambda f: F.struct(f.alias("field"), F.lit(3).alias("rank"))
    ).cast(finding)
    classification = F.col("vat_classification")
    needs_confirmation = F.coalesce(classification["requires_confirmation"], F.lit(False))
    unsure = (classification["confidence"] == "low") | (classification["code"] == "UNKNOWN_REVIEW")
    vat = F.when(
        needs_confirmation,
        F.array(
            F.struct(
                F.lit("vatTreatmentCode").alias("field"),
                F.when(F.coalesce(unsure, F.lit(False)), 2).otherwise(1).alias("rank"),
            )
        ).cast(finding),
    ).otherwise(F.array().cast(finding))

    gross_sure = _at_least(confidence_for(confidence, "grossAmountOriginal"), CORE_THRESHOLD)
    parts_sure = _at_least(confidence_for(confidence, "netAmountOriginal"), CORE_THRESHOLD) & _at_least(
        confidence_for(confidence, "vatAmountOriginal"), CORE_THRESHOLD
    )
    consistent = F.coalesce(totals_gap() <= F.lit(TOTALS_TOLERANCE), F.lit(False))

    def scan(entry: Column) -> Column:
        field, value = canonical_field(entry["key"]), entry["value"]
        core = field.isin(*CORE_FIELDS)
        pinned = (
            F.when(field.isin("netAmountOriginal", "vatAmountOriginal"), gross_sure)
            .when(field == "grossAmountOriginal", parts_sure)
            .otherwise(False)
        )
        forgiven = (value >= F.lit(SUPPORTING_THRESHOLD)) & consistent & pinned
        rank = (
            F.when(value <= 0, 0)
            .when(core & (value < F.lit(CORE_THRESHOLD)) & ~forgiven, 2)
            .when(~core & (value < F.lit(SUPPORTING_THRESHOLD)), 1)
            .otherwise(0)
        )
        return F.struct(field.alias("field"), rank.alias("rank"))

    doubts = F.filter(
        F.transform(F.map_entries(confidence), scan), lambda f: f["rank"] > 0
    ).cast(finding)

    staged = (
        documents.withColumn("_missing", missing_required())
        .withColumn("_findings", F.concat(issues, missing, vat, doubts))
        .withColumn(
            "_rate_blocks",
            (~has_rate & F.exists("issues", lambda i: i["code"] == "missing_exchange_rate"))
            | F.array_contains("_missing", "exchangeRateToEur"),
        )
    )
    done = (F.col("review_status") == "confirmed") & ~F.col("_rate_blocks")
    highest = F.greatest(
        F.coalesce(F.array_max(F.transform("_findings", lambda f: f["rank"])), F.lit(0)),
        F.when(F.col("review_status") == "failed", 3)
        .when(F.col("review_status") == "processing", 1)
        .otherwise(0),
    )
    level = F.when(done, F.lit("confirmed")).otherwise(
        F.element_at(F.array(*[F.lit(name) for name in LEVELS[1:]]), highest + 1)
    )
    staged = staged.withColumn(
        "_named", F.filter("_findings", lambda f: F.coalesce(f["field"], F.lit("")) != "")
    )
    fields = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform("_named", lambda f: f["field"])),
            lambda name: F.struct(
                name,
                F.element_at(
                    F.array(F.lit("minor"), F.lit("warning"), F.lit("critical")),
                    F.array_max(F.transform(F.filter("_named", lambda f: f["field"] == name), lambda f: f["rank"])),
                ),
            ),
        )
    )
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return staged.withColumn(
        "attention",
        F.struct(level.alias("level"), F.when(done, nothing).otherwise(fields).alias("fields")),
    ).drop("_missing", "_findings", "_named", "_rate_blocks")


def _present(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column).cast("string") != "")


def issue_resolved(issue: Column, columns: list[str]) -> Column:
    """Do the document's current values settle an issue?"""
    code = issue["code"]
    totals = (code == "conflicting_totals") | code.contains("inconsistent") | code.contains("mismatch")
    currency = F.upper(F.trim("original_currency"))
    field = canonical_field(F.coalesce(issue["field"], F.lit("")))
    named = F
    for name, column in FIELD_COLUMNS.items():
        if column in columns:
            named = named.when(field == name, _present(column))
    resolved = (
        F.when(totals, F.coalesce(totals_gap() <= F.lit(TOTALS_TOLERANCE), F.lit(True)))
        .when(code == "missing_invoice_date", F.col("invoice_date").isNotNull())
        .when(code == "missing_invoice_number", F.col("invoice_number").isNotNull())
        .when(code.isin("missing_currency", "unknown_currency"), F.col("original_currency").isNotNull())
        .when(
            code.isin("missing_amount", "missing_amounts"),
            F.col("gross_amount_original").isNotNull() | F.col("net_amount_original").isNotNull(),
        )
        .when(code == "missing_gross_amount", F.col("gross_amount_original").isNotNull())
        .when(code == "missing_net_amount", F.col("net_amount_original").isNotNull())
        .when(code == "missing_vat_amount", F.col("vat_amount_original").isNotNull())
        .when(
            code == "missing_exchange_rate",
            currency.eqNullSafe("EUR") | F.col("exchange_rate_to_eur").isNotNull(),
        )
        .when(code == "non_iso_currency", F.coalesce(is_iso_currency(F.col("original_currency")), F.lit(False)))
        .when(code.isin("missing_issuer", "missing_issuer_name"), F.col("issuer_name").isNotNull())
        .when(code.isin("missing_recipient", "missing_recipient_name"), F.col("recipient_name").isNotNull())
        .when(
            code.isin("llm_disagreement", "rename_failed", "ocr_failed", "ocr_partial", "duplicate_detected"),
            F.lit(False),
        )
        .otherwise(named.otherwise(False))
    )
    return F.coalesce(resolved, F.lit(False))


def drop_resolved(documents: DataFrame) -> DataFrame:
    """Remove issues the current values settle; recompute the review reasons."""
    columns = documents.columns
    kept = F.filter("issues", lambda i: ~issue_resolved(i, columns))
    return documents.withColumn("issues", kept).withColumn("review_reasons", reasons())


def reasons() -> Column:
    return F.array_distinct(F.transform("issues", lambda i: i["code"]))


def core_issues(documents: DataFrame) -> DataFrame:
    """Make sure every core problem has a critical issue; recompute the review reasons."""
    columns = documents.columns
    rules = [
        (F.col("invoice_date").isNull(), "missing_invoice_date", "invoiceDate"),
        (F.col("original_currency").isNull(), "unknown_currency", "currency"),
        (
            F.col("gross_amount_original").isNull() & F.col("net_amount_original").isNull(),
            "missing_amount",
            "grossAmount",
        ),
        (foreign_without_rate(), "missing_exchange_rate", "exchangeRateToEur"),
        (F.coalesce(totals_gap() > F.lit(TOTALS_TOLERANCE), F.lit(False)), "conflicting_totals", "grossAmount"),
    ]
    settled = F.filter(
        "issues", lambda i: ~((i["code"] == "missing_exchange_rate") & issue_resolved(i, columns))
    )
    staged = documents.withColumn("issues", settled).withColumn(
        "_codes", F.transform("issues", lambda i: i["code"])
    )

    def raised(issue: Column, index: Column) -> Column:
        result = issue
        for broken, code, field in rules:
            first = broken & (issue["code"] == code) & (F.array_position("_codes", code) == index + 1)
            critical = issue.withField("severity", F.lit("critical")).withField(
                "field", F.coalesce(issue["field"], F.lit(field))
            )
            result = F.when(first & (issue["severity"] != "critical"), critical).otherwise(result)
        return result

    def fresh(broken: Column, code: str, field: str) -> Column:
        issue = F.struct(
            F.lit(code).alias("code"),
            F.lit("critical").alias("severity"),
            F.lit(f"issues.{code}").alias("message_key"),
            F.lit(field).alias("field"),
            F.lit(None).cast("map<string,string>").alias("params"),
        ).cast(ISSUE_TYPE)
        return F.when(broken & ~F.array_contains("_codes", code), issue)

    added = F.array_compact(F.array(*[fresh(*rule) for rule in rules]))
    return (
        staged.withColumn("issues", F.concat(F.transform("issues", raised), added))
        .drop("_codes")
        .withColumn("review_reasons", reasons())
    )


def has_critical() -> Column:
    return F.exists("issues", lambda i: i["severity"] == "critical")


def drop_field_evidence(documents: DataFrame, changed: Column) -> DataFrame:
    """Forget confidence and disagreements of edited fields (``changed``: canonical names)."""

    def touched(field: Column) -> Column:
        return F.coalesce(F.array_contains(changed, canonical_field(field)), F.lit(False))

    result = documents.withColumns(
        {
            "field_confidence": F.map_filter("field_confidence", lambda k, _: ~touched(k)),
            "issues": F.filter(
                "issues",
                lambda i: ~((i["code"] == "llm_disagreement") & touched(F.coalesce(i["field"], F.lit("")))),
            ),
        }
    )
    if "verdicts" in documents.columns:
        result = result.withColumn("verdicts", F.map_filter("verdicts", lambda k, _: ~touched(k)))
    return result


def document_confidence(confidence: Column) -> Column:
    """Mean over all field confidences, zeros included, three decimals."""
    values = F.map_values(confidence)
    total = F.aggregate(
        values, F.lit(Decimal("0.00")).cast("decimal(10,2)"), lambda acc, v: (acc + v).cast("decimal(10,2)")
    )
    return F.round(total / F.nullif(F.size(values).cast("decimal(4,0)"), F.lit(Decimal(0))), 3)


def intake_reasons(classification_confirms: Column) -> Column:
    """Distinct issue codes of a new document, plus the unconfirmed classification."""
    return F.when(
        classification_confirms, F.array_append(reasons(), F.lit("vat_classification_unconfirmed"))
    ).otherwise(reasons())
