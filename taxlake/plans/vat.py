"""VAT classification and the treatment dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxlake.functions.vat import LEGAL_FORMS, SHORT_LEGAL_FORMS, SPECIAL_TOPICS, TREATMENTS
from taxlake.operators import classification, ledger
from taxlake.plans import books
from taxlake.plans.catalog import flat, query
from taxlake.plans.oracle_base import DOCS, SETTINGS, with_ctes

_EU = "('AT','BE','BG','HR','CY','CZ','DK','EE','FI','FR','DE','GR','HU','IE','IT','LV','LT','LU','MT','NL','PL','PT','RO','SK','SI','ES','SE')"

_TOPIC_SQL = ", ".join(
    "CASE WHEN regexp_matches(description, '(?i)"
    + pattern
    + f"') THEN 'special_rule_{topic}' END"
    for topic, pattern in SPECIAL_TOPICS.items()
)

_DETECT = f"""
v0 AS (
  SELECT d.*, vat_method, list_filter(vat_rates, lambda l: l.rate > 0 AND l.vat > 0) AS pos FROM docs d JOIN settings USING (tenant_id)
),
v1 AS (
  SELECT *, list_filter(pos, lambda l: l.rate IN (7, 19)) AS ger,
    COALESCE(net_amount_original > 0 AND vat_amount_original > 0, FALSE) AS stated
  FROM v0
),
v2 AS (
  SELECT *, len(ger) > 0 AS has_ger,
    (len(pos) > 0 OR COALESCE(vat_amount_original > 0, FALSE)) AS charged,
    len(list_filter(ger, lambda l: l.rate = 19)) > 0 AND len(list_filter(ger, lambda l: l.rate = 7)) > 0 AS mixed,
    list_sum(list_transform(list_filter(ger, lambda l: l.rate = 19), lambda l: l.net)) AS net19,
    list_sum(list_transform(list_filter(ger, lambda l: l.rate = 7), lambda l: l.net)) AS net7,
    list_sum(list_transform(ger, lambda l: l.vat)) AS line_vat,
    len(list_filter(ger, lambda l: abs(l.vat - l.net * l.rate * CAST(0.01 AS DECIMAL(4,2))) > GREATEST(CAST(0.02 AS DECIMAL(6,4)), l.net * CAST(0.01 AS DECIMAL(4,2))))) = 0 AS consistent,
    len(list_filter(pos, lambda l: l.rate NOT IN (7, 19))) > 0 AS foreign_line,
    CASE WHEN stated AND abs(vat_amount_original - net_amount_original * CAST(0.19 AS DECIMAL(4,2))) <= net_amount_original * CAST(0.005 AS DECIMAL(4,3)) THEN 19
         WHEN stated AND abs(vat_amount_original - net_amount_original * CAST(0.07 AS DECIMAL(4,2))) <= net_amount_original * CAST(0.005 AS DECIMAL(4,3)) THEN 7 END AS ratio_rate
  FROM v1
),
v3 AS (
  SELECT *,
    CASE WHEN NOT has_ger THEN ratio_rate
         WHEN NOT mixed THEN CASE WHEN ger[1].net <= -1 THEN 19 ELSE ger[1].rate END
         WHEN ger[1].rate = 7 THEN CASE WHEN net19 > net7 THEN 19 ELSE 7 END
         ELSE CASE WHEN net7 > net19 THEN 7 ELSE 19 END END AS rate,
    CASE WHEN has_ger THEN NOT mixed AND consistent ELSE ratio_rate IS NOT NULL END AS plausible,
    foreign_line OR (NOT has_ger AND stated AND ratio_rate IS NULL) AS foreign_rate,
    upper(trim(recipient_country_code)) AS rcountry, upper(trim(issuer_country_code)) AS icountry,
    CASE WHEN regexp_matches(upper(recipient_vat_id), '^[A-Z]{{2}}') THEN substr(upper(recipient_vat_id), 1, 2) END AS rprefix,
    CASE WHEN regexp_matches(upper(issuer_vat_id), '^[A-Z]{{2}}') THEN substr(upper(issuer_vat_id), 1, 2) END AS iprefix,
    COALESCE(recipient_is_business, FALSE) AS is_biz, COALESCE(length(trim(recipient_vat_id)) > 0, FALSE) AS has_id,
    COALESCE(regexp_matches(recipient_name, '(?i)\\b({LEGAL_FORMS})([^a-z]|$)') OR regexp_matches(recipient_name, '(^|\\s)({SHORT_LEGAL_FORMS})(\\s|$|,)'), FALSE) AS legal,
    concat_ws('|', {_TOPIC_SQL}) AS topics
  FROM v2
),
v4 AS (
  SELECT *, is_biz OR has_id OR legal AS evidence, rate IS NOT NULL AND charged AS german,
    COALESCE(CAST(vat_amount_original AS DECIMAL(18,2)), CAST(line_vat AS DECIMAL(18,2)), CAST(ROUND(net_amount_original * rate * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))) AS ger_amount
  FROM v3
)"""

_INCOME = """
ruled AS (
  SELECT *, CASE
    WHEN vat_method = 'kleinunternehmer' THEN 'small'
    WHEN vat_exempt AND charged THEN 'exempt_conflict'
    WHEN rcountry = 'DE' OR (rcountry IS NULL AND (COALESCE(rprefix, '') = 'DE' OR german)) THEN
      CASE WHEN german THEN 'domestic' WHEN foreign_rate THEN 'domestic_foreign' WHEN reverse_charge THEN 'domestic_rc' ELSE 'domestic_exempt' END
    WHEN rcountry IN {eu} THEN
      CASE WHEN charged THEN 'eu_charged' WHEN evidence AND service_likely THEN 'eu_b2b' WHEN evidence THEN 'eu_goods' ELSE 'eu_consumer' END
    WHEN rcountry IS NOT NULL THEN CASE WHEN charged THEN 'third_charged' ELSE 'third' END
    ELSE 'no_country' END AS rule,
    is_biz AND service_likely AND topics = '' AS third_clean,
    COALESCE(rcountry = 'DE', FALSE) AND plausible AND NOT mixed AS clean
  FROM v4 WHERE direction = 'income'
)
SELECT id,
  CASE rule WHEN 'small' THEN 'KLEINUNTERNEHMER' WHEN 'domestic' THEN CASE rate WHEN 19 THEN 'DE_DOMESTIC_19' ELSE 'DE_DOMESTIC_7' END
    WHEN 'domestic_exempt' THEN 'DE_DOMESTIC_0_EXEMPT' WHEN 'eu_b2b' THEN 'EU_B2B_REVERSE_CHARGE_REVENUE'
    WHEN 'third' THEN 'THIRD_COUNTRY_B2B_SERVICE' ELSE 'UNKNOWN_REVIEW' END AS code,
  CAST(CASE rule WHEN 'domestic' THEN rate WHEN 'domestic_exempt' THEN 0 END AS VARCHAR) AS german_vat_rate,
  CASE WHEN rule = 'domestic' THEN CAST(ger_amount AS DOUBLE) WHEN rule IN ('small','domestic_exempt','eu_b2b','third') THEN CAST(0 AS DOUBLE) END AS german_vat_amount,
  CASE rule WHEN 'small' THEN '§ 19 Abs. 1 UStG' WHEN 'domestic' THEN CASE rate WHEN 19 THEN '§ 12 Abs. 1 UStG' ELSE '§ 12 Abs. 2 UStG' END
    WHEN 'domestic_exempt' THEN '§ 4 UStG' WHEN 'eu_b2b' THEN '§ 3a Abs. 2 UStG; Art. 196 MwStSystRL' WHEN 'third' THEN '§ 3a Abs. 2 UStG' END AS legal_basis,
  CASE WHEN rule = 'small' THEN 'high' WHEN rule = 'domestic' THEN CASE WHEN clean THEN 'high' ELSE 'medium' END
    WHEN rule = 'eu_b2b' THEN CASE WHEN has_id THEN 'high' ELSE 'medium' END
    WHEN rule = 'third' AND third_clean THEN 'high'
    WHEN rule = 'third' AND COALESCE(recipient_is_business, TRUE) AND service_likely AND evidence THEN 'medium' ELSE 'low' END AS confidence,
  CASE rule WHEN 'small' THEN charged WHEN 'domestic' THEN NOT clean WHEN 'eu_b2b' THEN NOT has_id WHEN 'third' THEN NOT third_clean ELSE TRUE END AS requires_confirmation,
  CASE rule WHEN 'small' THEN concat_ws('|', 'small_business_scheme', CASE WHEN charged THEN 'vat_contradicts_scheme' END)
    WHEN 'exempt_conflict' THEN 'exempt_wording_with_vat|signals_conflict'
    WHEN 'domestic' THEN 'german_vat_shown|' || CASE WHEN rcountry = 'DE' THEN 'recipient_in_germany' ELSE 'german_vat_suggests_domestic' END
    WHEN 'domestic_foreign' THEN 'foreign_rate_domestic_recipient'
    WHEN 'domestic_rc' THEN 'reverse_charge_domestic_recipient|domestic_reverse_charge_not_covered'
    WHEN 'domestic_exempt' THEN 'domestic_without_vat|needs_exemption_reason'
    WHEN 'eu_charged' THEN 'vat_charged_to_eu_recipient|consumer_sale_or_error'
    WHEN 'eu_b2b' THEN concat_ws('|', 'recipient_in_eu', CASE WHEN has_id THEN 'vat_id_provided' ELSE 'vat_id_missing' END, 'eu_reverse_charge_rule', CASE WHEN reverse_charge THEN 'reverse_charge_wording' END)
    WHEN 'eu_goods' THEN 'eu_business_no_service|goods_not_classified'
    WHEN 'eu_consumer' THEN 'eu_recipient_not_business|consumer_rules'
    WHEN 'third_charged' THEN 'vat_charged_outside_eu|conflicts_with_location'
    WHEN 'third' THEN concat_ws('|', 'recipient_outside_eu', CASE WHEN is_biz THEN 'business_confirmed' WHEN evidence THEN 'business_likely' END, CASE WHEN service_likely THEN 'general_b2b_rule' END)
    ELSE 'recipient_country_unknown' END AS reasons,
  CASE rule WHEN 'small' THEN CASE WHEN charged THEN 'vat_stated_by_mistake' ELSE '' END
    WHEN 'exempt_conflict' THEN 'vat_charged_or_exempt'
    WHEN 'domestic' THEN concat_ws('|', CASE WHEN rcountry IS NULL THEN 'is_recipient_in_germany' END, CASE WHEN NOT plausible AND NOT mixed THEN 'vat_does_not_match_rate' END, CASE WHEN mixed THEN 'several_vat_rates' END)
    WHEN 'domestic_foreign' THEN 'which_rate_and_country' WHEN 'domestic_rc' THEN 'domestic_reverse_charge_applies'
    WHEN 'domestic_exempt' THEN 'which_exemption' WHEN 'eu_charged' THEN 'business_or_consumer'
    WHEN 'eu_b2b' THEN CASE WHEN has_id THEN '' ELSE 'what_is_the_vat_id' END
    WHEN 'eu_goods' THEN 'service_or_goods_eu' WHEN 'eu_consumer' THEN 'is_recipient_business_eu' WHEN 'third_charged' THEN 'why_vat_charged'
    WHEN 'third' THEN concat_ws('|', CASE WHEN NOT is_biz THEN 'is_recipient_business' END, CASE WHEN NOT service_likely THEN 'service_or_goods' END, NULLIF(topics, ''))
    ELSE 'which_recipient_country' END AS questions
FROM ruled""".replace("{eu}", _EU)

_EXPENSE = """
ruled AS (
  SELECT *, vat_method = 'kleinunternehmer' AS small, plausible AND NOT mixed AS clean,
    COALESCE(iprefix = 'EU', FALSE) OR oss AS one_stop,
    COALESCE(iprefix <> 'DE' AND iprefix <> 'EU' AND CASE iprefix WHEN 'EL' THEN 'GR' ELSE iprefix END IN {eu}, FALSE) AS eu_id,
    (icountry IS NOT NULL AND icountry <> 'DE') OR (icountry IS NULL AND iprefix IS NOT NULL AND iprefix <> 'DE') AS abroad,
    (icountry IS NOT NULL AND icountry = 'DE') OR (icountry IS NULL AND iprefix IS NOT NULL AND iprefix = 'DE') AS home,
    COALESCE(vat_amount_original = 0, FALSE) OR vat_exempt AS no_vat
  FROM v4 WHERE direction = 'expense'
),
ruled2 AS (
  SELECT *, CASE WHEN german AND small THEN 'ger_small' WHEN german AND COALESCE(iprefix, '') = 'DE' THEN 'ger_de' WHEN german THEN 'ger_other'
    WHEN foreign_rate THEN 'foreign' WHEN small_business THEN 'supplier_small' WHEN abroad AND service_likely THEN '13b' WHEN abroad THEN 'goods'
    WHEN home AND no_vat AND reverse_charge THEN 'home_rc' WHEN home AND no_vat THEN 'home_no_vat' ELSE 'none' END AS rule,
    reverse_charge AND eu_id AS strong
  FROM ruled
)
SELECT id,
  CASE WHEN rule IN ('ger_small','foreign','supplier_small','home_no_vat') THEN 'DE_EXPENSE_NO_INPUT_VAT' WHEN rule IN ('ger_de','ger_other') THEN 'DE_EXPENSE_INPUT_VAT'
    WHEN rule = '13b' THEN 'EXPENSE_REVERSE_CHARGE_13B' ELSE 'UNKNOWN_REVIEW' END AS code,
  CAST(CASE WHEN rule IN ('ger_de','ger_other') THEN rate WHEN rule = '13b' THEN 19 END AS VARCHAR) AS german_vat_rate,
  CASE WHEN rule IN ('ger_small','foreign','supplier_small','home_no_vat','home_rc') THEN CAST(0 AS DOUBLE) WHEN rule IN ('ger_de','ger_other') THEN CAST(ger_amount AS DOUBLE)
    WHEN rule = '13b' THEN CAST(ROUND(CAST(COALESCE(net_amount_original, gross_amount_original) AS DECIMAL(28,2)) * CAST(0.19 AS DECIMAL(4,2)), 2) AS DOUBLE) END AS german_vat_amount,
  CASE rule WHEN 'ger_small' THEN '§ 19 Abs. 1 UStG' WHEN 'supplier_small' THEN '§ 19 Abs. 1 UStG' WHEN 'ger_de' THEN '§ 15 Abs. 1 UStG' WHEN 'ger_other' THEN '§ 15 Abs. 1 UStG'
    WHEN '13b' THEN '§ 13b UStG' WHEN 'home_no_vat' THEN '§ 15 Abs. 1 Satz 1 Nr. 1 UStG' END AS legal_basis,
  CASE WHEN rule IN ('ger_small','supplier_small','home_no_vat') THEN 'high' WHEN rule = 'ger_de' THEN CASE WHEN clean THEN 'high' ELSE 'medium' END
    WHEN rule IN ('ger_other','foreign') THEN 'medium' WHEN rule = '13b' THEN CASE WHEN strong THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence,
  CASE WHEN rule IN ('ger_small','supplier_small','home_no_vat') THEN FALSE WHEN rule = 'ger_de' THEN NOT clean WHEN rule = '13b' THEN NOT strong OR small ELSE TRUE END AS requires_confirmation,
  CASE rule WHEN 'ger_small' THEN 'german_vat_shown|small_business_no_deduction' WHEN 'ger_de' THEN 'german_vat_from_german_supplier|input_vat_deductible'
    WHEN 'ger_other' THEN 'german_vat_shown|' || CASE WHEN one_stop THEN 'supplier_one_stop_shop' WHEN iprefix IS NOT NULL THEN 'supplier_not_german_registered' ELSE 'supplier_vat_id_missing' END
    WHEN 'foreign' THEN 'foreign_vat|foreign_vat_not_deductible' WHEN 'supplier_small' THEN 'supplier_small_business|no_vat_no_deduction'
    WHEN '13b' THEN concat_ws('|', 'supplier_abroad_no_vat', 'recipient_owes_vat', CASE WHEN reverse_charge THEN 'reverse_charge_wording' END, CASE WHEN small THEN 'owed_without_deduction' ELSE 'owed_and_deductible' END)
    WHEN 'goods' THEN 'supplier_abroad_no_service|goods_not_classified' WHEN 'home_rc' THEN 'german_supplier_reverse_charge|domestic_reverse_charge_separate'
    WHEN 'home_no_vat' THEN 'german_supplier_no_vat|no_vat_no_deduction' ELSE 'no_usable_vat_information' END AS reasons,
  CASE rule WHEN 'ger_de' THEN CASE WHEN clean THEN '' ELSE 'vat_does_not_match_rate' END WHEN 'ger_other' THEN 'german_vat_id_on_invoice' WHEN 'foreign' THEN 'which_country_vat'
    WHEN '13b' THEN concat_ws('|', CASE WHEN NOT reverse_charge THEN 'reverse_charge_referenced' END, CASE WHEN NOT eu_id THEN 'regular_eu_vat_id' END)
    WHEN 'goods' THEN 'goods_from_abroad' WHEN 'home_rc' THEN 'domestic_reverse_charge_applies' WHEN 'none' THEN 'which_rate_and_supplier' ELSE '' END AS questions
FROM ruled2""".replace("{eu}", _EU)


def _classified(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    docs = books.documents(spark, sf_dir).filter(F.col("direction") == direction)
    rows = ledger.with_settings(docs, books.stored_settings(spark, sf_dir).select("tenant_id", "vat_method"))
    return flat(
        classification.classify(rows)
        .select("id", "vat_classification.*")
        .withColumn("german_vat_rate", F.col("german_vat_rate").cast("string"))
    )


@query("vat_classify_income", with_ctes(DOCS, SETTINGS, _DETECT, _INCOME.split(")\nSELECT id", 1)[0] + ")") + "SELECT id" + _INCOME.split(")\nSELECT id", 1)[1])
def vat_classify_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "income")


@query("vat_classify_expense", with_ctes(DOCS, SETTINGS, _DETECT, _EXPENSE.split(")\nSELECT id", 1)[0] + ")") + "SELECT id" + _EXPENSE.split(")\nSELECT id", 1)[1])
def vat_classify_expense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "expense")


_CATALOG_SQL = "catalog(code, label_de, label_en, legal_basis) AS (VALUES " + ", ".join(
    f"('{code}', '{de}', '{en}', " + (f"'{basis}'" if basis else "CAST(NULL AS VARCHAR)") + ")"
    for code, (de, en, basis, _) in TREATMENTS.items()
) + ")"


@query(
    "treatment_usage",
    with_ctes(DOCS, _CATALOG_SQL)
    + """SELECT direction, code, label_de, label_en, legal_basis, COUNT(*) AS documents,
  CASE WHEN code = 'UNKNOWN_REVIEW' THEN FALSE WHEN direction = 'expense' THEN code IN ('DE_EXPENSE_INPUT_VAT','DE_EXPENSE_NO_INPUT_VAT','EXPENSE_REVERSE_CHARGE_13B')
    ELSE code NOT IN ('DE_EXPENSE_INPUT_VAT','DE_EXPENSE_NO_INPUT_VAT','EXPENSE_REVERSE_CHARGE_13B') END AS applicable
FROM docs JOIN catalog ON vat_treatment_code = code WHERE NOT is_deleted GROUP BY ALL""",
)
def treatment_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (
        books.documents(spark, sf_dir)
        .filter(F.col("deleted_at").isNull())
        .groupBy("direction", F.col("vat_treatment_code").alias("code"))
        .agg(F.count("*").alias("documents"))
    )
    catalog = classification.treatment_table(spark).withColumnRenamed("direction", "suits")
    return flat(
        counts.join(catalog, "code").select(
            "direction", "code", "label_de", "label_en", "legal_basis", "documents",
            F.coalesce(F.col("suits") == F.col("direction"), F.lit(False)).alias("applicable"),
        )
    )
