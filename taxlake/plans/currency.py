"""Rate lookups and EUR amounts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxlake.operators import currency
from taxlake.plans import books
from taxlake.plans.catalog import flat, query
from taxlake.plans.oracle_base import DOCS, RATES, with_ctes

TODAY = "2024-03-10"


def _rate_text() -> Column:
    """Receipt wording with a printed rate for some documents, built from the row itself."""
    k, cur = F.col("k"), F.col("original_currency")
    digits = F.lpad((k % 100).cast("string"), 2, "0")
    return (
        F.when(k % 29 == 0, F.concat(F.lit("Charged using 1 "), cur, F.lit(" = 0.9"), digits, F.lit(" EUR today")))
        .when(k % 31 == 0, F.concat(F.lit("Kurs: 1,00 EUR = 1,25 "), cur, F.lit(".")))
        .when(k % 37 == 0, F.concat(F.lit("Not a rate: 11 "), cur, F.lit(" = 9 EUR")))
        .otherwise(F.lit("no rate here"))
    )


_FOREIGN = """
foreign_docs AS (
  SELECT *, COALESCE(invoice_date, DATE '2024-03-10') AS day FROM docs WHERE original_currency <> 'EUR'
),
latest_daily AS (
  SELECT d.id, r.rate, r.rate_date, r.source
  FROM foreign_docs d ASOF LEFT JOIN daily_rates r ON d.original_currency = r.currency AND d.day >= r.rate_date
),
official_daily AS (
  SELECT d.id, a.rate, a.rate_date, a.source FROM foreign_docs d JOIN latest_daily a USING (id) WHERE a.rate_date >= d.day - 7
),
official_monthly AS (
  SELECT d.id, m.rate, m.rate_date, m.source FROM foreign_docs d
  JOIN monthly_rates m ON m.currency = d.original_currency AND m.rate_date = CAST(date_trunc('month', d.day) AS DATE)
)"""

_RESOLVED = """
resolved AS (
  SELECT d.*,
    CASE WHEN k % 29 = 0 THEN CAST('0.9' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS DECIMAL(18,10))
         WHEN k % 31 = 0 THEN CAST(0.8 AS DECIMAL(18,10))
         ELSE COALESCE(m.rate, a.rate) END AS rate,
    CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN day ELSE COALESCE(m.rate_date, a.rate_date) END AS rate_date,
    CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN 'document' ELSE COALESCE(m.source, a.source) END AS source
  FROM foreign_docs d LEFT JOIN official_monthly m USING (id) LEFT JOIN official_daily a USING (id)
)"""


def _foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.documents(spark, sf_dir).filter(F.col("original_currency") != "EUR")


def _day() -> Column:
    return F.coalesce("invoice_date", F.lit(TODAY).cast("date"))


@query(
    "rate_asof",
    with_ctes(DOCS, RATES, _FOREIGN)
    + "SELECT id, original_currency, CAST(day AS VARCHAR) AS day, CAST(a.rate AS DOUBLE) AS rate_to_eur, CAST(a.rate_date AS VARCHAR) AS rate_date FROM foreign_docs LEFT JOIN official_daily a USING (id)",
)
def rate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _foreign(spark, sf_dir).select("id", "original_currency", _day().alias("day"))
    calendar = currency.daily_calendar(books.exchange_rates(spark, sf_dir)).withColumnRenamed("currency", "original_currency")
    return flat(
        docs.join(calendar, ["original_currency", "day"], "left").select(
            "id", "original_currency", "day", "rate_to_eur", "rate_date"
        )
    )


@query(
    "rate_monthly",
    with_ctes(DOCS, RATES)
    + """SELECT d.id, d.original_currency, CAST(m.rate AS DOUBLE) AS rate_to_eur, m.source FROM docs d
LEFT JOIN monthly_rates m ON m.currency = d.original_currency AND m.rate_date = CAST(date_trunc('month', COALESCE(d.invoice_date, DATE '2024-03-10')) AS DATE)
WHERE d.original_currency <> 'EUR'""",
)
def rate_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _foreign(spark, sf_dir).select("id", "original_currency", F.trunc(_day(), "MM").alias("month"))
    monthly = currency.monthly_rates(books.exchange_rates(spark, sf_dir)).withColumnRenamed("currency", "original_currency")
    return flat(
        docs.join(monthly, ["original_currency", "month"], "left").select("id", "original_currency", "rate_to_eur", "source")
    )


def _resolved(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    return currency.resolve_rates(
        docs.withColumn("text", _rate_text()),
        books.exchange_rates(spark, sf_dir),
        F.lit(TODAY).cast("date"),
        "text",
    )


@query(
    "rate_resolved",
    with_ctes(DOCS, RATES, _FOREIGN, _RESOLVED)
    + "SELECT id, CAST(rate AS DOUBLE) AS rate_to_eur, CAST(rate_date AS VARCHAR) AS rate_date, source, rate IS NULL AS rate_missing FROM resolved",
)
def rate_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_resolved(spark, sf_dir, _foreign(spark, sf_dir)).select("id", "rate.*", "rate_missing"))


@query(
    "eur_amounts",
    with_ctes(DOCS, RATES, _FOREIGN, _RESOLVED)
    + """SELECT d.id,
  CAST(CASE WHEN d.original_currency = 'EUR' THEN d.net_amount_original ELSE ROUND(CAST(d.net_amount_original AS DECIMAL(26,2)) * r.rate, 2) END AS DOUBLE) AS net_amount_eur,
  CAST(CASE WHEN d.original_currency = 'EUR' THEN d.vat_amount_original ELSE ROUND(CAST(d.vat_amount_original AS DECIMAL(26,2)) * r.rate, 2) END AS DOUBLE) AS vat_amount_eur,
  CAST(CASE WHEN d.original_currency = 'EUR' THEN d.gross_amount_original ELSE ROUND(CAST(d.gross_amount_original AS DECIMAL(26,2)) * r.rate, 2) END AS DOUBLE) AS gross_amount_eur
FROM docs d LEFT JOIN resolved r USING (id)""",
)
def eur_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = _resolved(spark, sf_dir, books.documents(spark, sf_dir))
    return flat(
        currency.with_eur_amounts(resolved).select("id", "net_amount_eur", "vat_amount_eur", "gross_amount_eur")
    )


@query(
    "rates_inserted",
    with_ctes(
        RATES,
        """stored AS (SELECT * FROM daily_rates WHERE month(rate_date) <> 5),
incoming AS (
  SELECT currency, rate_date, rate, source FROM daily_rates
  UNION ALL SELECT currency, rate_date, rate + 1, 'manual' FROM daily_rates WHERE day(rate_date) = 1
)""",
    )
    + """SELECT currency, CAST(rate_date AS VARCHAR) AS rate_date, source, CAST(rate AS DOUBLE) AS rate_to_eur FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.currency = i.currency AND s.rate_date = i.rate_date AND s.source = i.source)""",
)
def rates_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = books.exchange_rates(spark, sf_dir).filter(F.col("source") == "ECB")
    stored = daily.filter(F.month("rate_date") != 5)
    manual = daily.filter(F.dayofmonth("rate_date") == 1).select(
        F.lower("currency").alias("currency"),
        "rate_date",
        (F.col("rate_to_eur") + F.lit(Decimal(1))).cast("decimal(18,10)").alias("rate_to_eur"),
        F.lit("manual").alias("source"),
    )
    return flat(currency.new_rates(stored, daily.unionByName(manual)))
