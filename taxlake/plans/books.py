"""Books derived from the driver's tables: one income document per order, one expense
document per (order, supplier), plus the settings, rates and changes that go with them.

Every attribute is an expression over the given rows, so all of it grows with the tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxlake.functions.money import MONEY, RATE
from taxlake.session import cut_lineage

SHIFT_MONTHS = 312  # 26 years: puts the order dates into 2021-2027


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _country(nationkey: str) -> str:
    return f"element_at(array('DE', 'DE', 'FR', 'US', 'GB'), CAST({nationkey} % 5 AS INT) + 1)"


def _income(spark: SparkSession, sf_dir: str) -> DataFrame:
    parties = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS party_key", "c_name AS party", f"{_country('c_nationkey')} AS party_country"
    )
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "concat('O', o_orderkey) AS id",
            "o_orderkey AS k",
            "'income' AS direction",
            "o_custkey AS party_key",
            "CAST(o_totalprice AS DECIMAL(18,2)) AS base_net",
            f"add_months(CAST(o_orderdate AS DATE), {SHIFT_MONTHS}) AS document_date",
            "o_orderstatus AS state",
        )
        .join(parties, "party_key")
    )


def _expense(spark: SparkSession, sf_dir: str) -> DataFrame:
    parties = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS party_key", "s_name AS party", f"{_country('s_nationkey')} AS party_country"
    )
    amount = "CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(6,2)) - CAST(l_discount AS DECIMAL(6,2)))"
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(
            F.expr(f"CAST(round(sum({amount}), 2) AS DECIMAL(18,2))").alias("base_net"),
            F.expr(f"add_months(CAST(min(l_shipdate) AS DATE), {SHIFT_MONTHS})").alias("document_date"),
            F.max("l_returnflag").alias("flag"),
        )
        .selectExpr(
            "concat('L', l_orderkey, '-', l_suppkey) AS id",
            "l_orderkey AS k",
            "'expense' AS direction",
            "l_suppkey AS party_key",
            "base_net",
            "document_date",
            "CASE flag WHEN 'R' THEN 'F' WHEN 'A' THEN 'P' ELSE 'O' END AS state",
        )
        .join(parties, "party_key")
    )


CONFIDENCE_FIELDS = [
    "invoiceNumber", "invoiceDate", "serviceDateFrom", "serviceDateTo", "dueDate", "paymentDate",
    "issuerName", "issuerCountryCode", "issuerVatId", "recipientName", "recipientCountryCode",
    "recipientVatId", "description", "currency", "netAmount", "vatAmount", "grossAmount",
]

LINE_TYPE = "array<struct<rate:decimal(5,2),net:decimal(18,2),vat:decimal(18,2),gross:decimal(18,2)>>"


def _line(rate: int, extra: str = "0") -> str:
    vat = f"CAST(round(base_net * {rate} * 0.01BD, 2) + {extra} AS DECIMAL(18,2))"
    return (
        f"named_struct('rate', CAST({rate} AS DECIMAL(5,2)), 'net', base_net, 'vat', {vat}, "
        f"'gross', CAST(base_net + {vat} AS DECIMAL(18,2)))"
    )


def _issue(code: str, severity: str, field: str) -> str:
    return (
        f"named_struct('code', '{code}', 'severity', '{severity}', 'message_key', 'issues.{code}', "
        f"'field', '{field}', 'params', CAST(NULL AS MAP<STRING,STRING>))"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table. Catalyst prunes every column a query does not use."""
    raw = _income(spark, sf_dir).unionByName(_expense(spark, sf_dir))
    step1 = raw.selectExpr(
        "*",
        "CAST(k % 8 AS INT) AS tenant_id",
        "IF(k % 97 <> 0, document_date, NULL) AS invoice_date",
        "CASE state WHEN 'F' THEN 'paid' WHEN 'O' THEN 'unpaid' ELSE 'unknown' END AS payment_status",
        "IF(state = 'F' AND k % 11 <> 0, date_add(document_date, CAST(k % 45 AS INT)), NULL) AS payment_date",
        "IF(k % 59 <> 0, party_country, NULL) AS country",
        """CASE WHEN k % 83 = 0 THEN NULL WHEN k % 71 = 0 AND party_country = 'US' THEN 'USDT'
             WHEN party_country = 'US' THEN 'USD' WHEN party_country = 'GB' THEN 'GBP' ELSE 'EUR' END AS original_currency""",
        "CASE WHEN party_country = 'DE' AND k % 4 = 0 THEN 7 WHEN party_country = 'DE' THEN 19 ELSE 0 END AS vat_rate",
        "concat(party, element_at(array(' GmbH', ' AG', ' Ltd', '', ' e.K.'), CAST(party_key % 5 AS INT) + 1)) AS party_name",
    ).selectExpr("*", "CAST(round(base_net * vat_rate * 0.01BD, 2) AS DECIMAL(18,2)) AS base_vat")
    step2 = step1.selectExpr(
        "*",
        "IF(k % 109 <> 0, base_net, NULL) AS net_amount_original",
        "IF(k % 101 <> 0, base_vat, NULL) AS vat_amount_original",
        "IF(k % 103 <> 0, CAST(base_net + base_vat + IF(k % 107 = 0, 1, 0) AS DECIMAL(18,2)), NULL) AS gross_amount_original",
        """CAST(CASE WHEN k % 43 = 0 THEN NULL WHEN original_currency = 'USD' THEN 0.9BD
             WHEN original_currency = 'GBP' THEN 1.15BD END AS DECIMAL(18,10)) AS exchange_rate_to_eur""",
        """CASE WHEN k % 23 = 0 THEN concat('EU', lpad(party_key, 9, '0'))
             WHEN party_country = 'DE' AND k % 2 = 0 THEN concat('DE', lpad(party_key, 9, '0'))
             WHEN party_country = 'FR' AND k % 3 <> 0 THEN concat('FR', lpad(party_key, 11, '0')) END AS vat_id""",
        "CAST(document_date AS TIMESTAMP) + make_dt_interval(0, 0, 0, k % 1000) AS created_at",
        "original_currency IS NOT NULL AND original_currency <> 'EUR' AS is_foreign",
    )

    def eur(name: str) -> str:
        amount = f"{name}_amount_original"
        return (
            f"IF(original_currency = 'EUR', {amount}, "
            f"CAST(round({amount} * exchange_rate_to_eur, 2) AS DECIMAL(18,2))) AS {name}_amount_eur"
        )

    confidence = ", ".join(
        f"CAST(IF((k + {i}) % 12 = 0, 0, (55 + (k * 3 + {i * 7}) % 45) * 0.01BD) AS DECIMAL(4,2))"
        for i in range(len(CONFIDENCE_FIELDS))
    )
    names = ", ".join(f"'{f}'" for f in CONFIDENCE_FIELDS)
    return step2.selectExpr(
        "id", "k", "tenant_id", "direction", "party_key", "base_net", "vat_rate", "document_date",
        "sha2(concat_ws('|', direction, k, party_key), 256) AS sha256",
        "concat('scan_', k, '.pdf') AS original_filename",
        "IF(k % 67 <> 0, concat('RE-', k), NULL) AS invoice_number",
        "invoice_date", "payment_date", "payment_status",
        "IF(direction = 'income', 'Studio Nord', party_name) AS issuer_name",
        "IF(direction = 'income', 'DE', country) AS issuer_country_code",
        "IF(direction = 'expense', vat_id, NULL) AS issuer_vat_id",
        "IF(direction = 'income', party_name, 'Studio Nord') AS recipient_name",
        "IF(direction = 'income', country, 'DE') AS recipient_country_code",
        "IF(direction = 'income', vat_id, NULL) AS recipient_vat_id",
        "IF(k % 6 = 0, NULL, k % 6 <> 1) AS recipient_is_business",
        """IF(k % 61 <> 0, concat_ws(' ', element_at(array('Konferenz und Seminar', 'Software development',
             'Transport und Versand', 'Catering 50%_Buffet', 'Beratung', 'Streaming Abo', 'Hosting'),
             CAST(k % 7 AS INT) + 1), k), NULL) AS description""",
        "original_currency", "net_amount_original", "vat_amount_original", "gross_amount_original",
        "exchange_rate_to_eur", eur("net"), eur("vat"), eur("gross"),
        f"""CASE WHEN vat_rate = 0 AND k % 26 = 5 THEN array({_line(20)})
             WHEN vat_rate = 0 OR k % 10 = 0 THEN CAST(array() AS {LINE_TYPE})
             WHEN k % 9 = 0 THEN array({_line(7)}, {_line(19)})
             WHEN k % 33 = 0 THEN array({_line(19, "5")})
             WHEN vat_rate = 7 THEN array({_line(7)})
             ELSE array({_line(19)}) END AS vat_rates""",
        """CASE WHEN k % 53 = 0 THEN 'UNKNOWN_REVIEW'
             WHEN direction = 'income' AND k % 47 = 0 THEN 'DE_DOMESTIC_0_EXEMPT'
             WHEN direction = 'income' AND k % 8 = 2 AND vat_rate > 0 THEN 'KLEINUNTERNEHMER'
             WHEN direction = 'income' AND vat_rate = 19 THEN 'DE_DOMESTIC_19'
             WHEN direction = 'income' AND vat_rate = 7 THEN 'DE_DOMESTIC_7'
             WHEN direction = 'income' AND party_country = 'FR' THEN 'EU_B2B_REVERSE_CHARGE_REVENUE'
             WHEN direction = 'income' THEN 'THIRD_COUNTRY_B2B_SERVICE'
             WHEN vat_rate > 0 THEN 'DE_EXPENSE_INPUT_VAT'
             WHEN k % 3 <> 0 THEN 'EXPENSE_REVERSE_CHARGE_13B'
             ELSE 'DE_EXPENSE_NO_INPUT_VAT' END AS vat_treatment_code""",
        "year(invoice_date) AS tax_period_year",
        "quarter(invoice_date) AS tax_period_quarter",
        "month(invoice_date) AS tax_period_month",
        """named_struct('reverse_charge', party_country <> 'DE' AND k % 3 = 0, 'vat_exempt', k % 17 = 0,
             'small_business', k % 19 = 0, 'oss', k % 23 = 0, 'service_likely', k % 5 <> 0) AS signals""",
        f"map_from_arrays(array({names}), array({confidence})) AS field_confidence",
        f"""array_compact(array(
             IF(k % 37 = 0, {_issue("conflicting_totals", "critical", "grossAmount")}, NULL),
             IF(k % 43 = 0 AND is_foreign, {_issue("missing_exchange_rate", "critical", "exchangeRateToEur")}, NULL),
             IF(k % 14 = 0, {_issue("unclear_business_status", "warning", "recipientIsBusiness")}, NULL),
             IF(k % 15 = 0, {_issue("ambiguous_date_format", "warning", "invoiceDate")}, NULL),
             IF(k % 16 = 0, {_issue("missing_description", "warning", "description")}, NULL),
             IF(k % 18 = 0, {_issue("unclear_recipient_country", "info", "recipientCountryCode")}, NULL),
             IF(k % 61 = 0, {_issue("llm_disagreement", "warning", "currency")}, NULL))) AS issues""",
        """CASE WHEN k % 13 = 0 THEN 'needs_review' WHEN k % 29 = 0 THEN 'failed'
             WHEN k % 31 = 0 THEN 'processing' ELSE 'confirmed' END AS review_status""",
        "IF(k % 41 = 0, created_at, NULL) AS deleted_at",
        "created_at",
        "created_at AS updated_at",
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings: one row per tenant; tenant 7 has none, so its defaults apply."""
    t = F.col("tenant_id")

    def pick(index: Column, values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    return (
        table(spark, sf_dir, "orders")
        .select((F.col("o_orderkey") % 8).cast("int").alias("tenant_id"))
        .distinct()
        .filter(t != 7)
        .select(
            "tenant_id",
            pick(t % 4, ["ist", "soll", "kleinunternehmer", "unsure"]).alias("vat_method"),
            pick(t % 3, ["euer", "accrual", "unsure"]).alias("income_tax_method"),
            pick(t % 3, ["monthly", "quarterly", "yearly"]).alias("vat_filing_frequency"),
            pick(t % 2, ["single", "joint"]).alias("assessment_type"),
            pick(t % 3, ["none", "rate8", "rate9"]).alias("church_tax"),
            (t * 1000).cast(MONEY).alias("other_taxable_income"),
            F.when(t % 2 == 0, F.lit(Decimal("0.00"))).otherwise(t * 500).cast(MONEY).alias("deductible_contributions"),
            (t * 250).cast(MONEY).alias("income_tax_prepayments"),
            F.when(t == 3, F.lit(False)).when(t != 5, F.lit(True)).alias("include_solidarity_surcharge"),
        )
    )


def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``settings``, written: as they are derived from the orders, Spark takes them for as large as these.

    Where they meet the documents themselves they are then broadcast; else all documents would be dealt to the few tenants.
    """
    return cut_lineage(settings(spark, sf_dir))


def exchange_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rates for days 1-15 of each month that has orders, monthly ones for even months."""
    days = (
        table(spark, sf_dir, "orders")
        .select(F.add_months(F.col("o_orderdate").cast("date"), SHIFT_MONTHS).alias("rate_date"))
        .distinct()
    )
    quotes = F.explode(
        F.array(
            F.struct(F.lit("USD").alias("currency"), F.lit(Decimal("0.90")).cast(RATE).alias("level")),
            F.struct(F.lit("GBP").alias("currency"), F.lit(Decimal("1.15")).cast(RATE).alias("level")),
        )
    )
    daily = (
        days.filter(F.dayofmonth("rate_date") <= 15)
        .select("rate_date", quotes.alias("q"))
        .select(
            "q.currency",
            "rate_date",
            (F.col("q.level") + F.dayofmonth("rate_date") * F.lit(Decimal("0.0010")) + F.month("rate_date") * F.lit(Decimal("0.0001")))
            .cast(RATE)
            .alias("rate_to_eur"),
            F.lit("ECB").alias("source"),
        )
    )
    monthly = (
        days.select(F.trunc("rate_date", "MM").cast("date").alias("rate_date"))
        .distinct()
        .filter(F.month("rate_date") % 2 == 0)
        .select("rate_date", quotes.alias("q"))
        .select(
            "q.currency",
            "rate_date",
            (F.col("q.level") + F.lit(Decimal("0.05")) + F.month("rate_date") * F.lit(Decimal("0.001"))).cast(RATE).alias("rate_to_eur"),
            F.concat(F.lit("BMF USt-Umrechnungskurs "), F.date_format("rate_date", "yyyy-MM")).alias("source"),
        )
    )
    return daily.unionByName(monthly)
