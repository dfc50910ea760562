"""Exchange rates as set-based joins: one calendar row per currency and day.

The as-of lookup becomes an equi-join because every observation is written out for the days it
is valid on. The calendar grows with currencies x days, not with documents, and is joined without
a hint, so Spark broadcasts it only while it is small. A currency's window holds its observation
days, a number bounded by the calendar.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxlake.functions.money import convert
from taxlake.functions.rates import DAILY_SOURCE, is_iso_currency, is_monthly_source, printed_rate

MAX_DAYS_BACK = 7


def _first_inserted(rates: DataFrame, keys: list[Column]) -> DataFrame:
    """One rate per key: the first inserted when the table knows the order, else by date."""
    order = [c for c in ("inserted_at", "rate_date", "source") if c in rates.columns]
    best = F.min_by(F.struct("rate_to_eur", "rate_date", "source"), F.struct(*order))
    return rates.groupBy(*keys).agg(best.alias("best"))


def daily_calendar(rates: DataFrame, any_source: bool = False, days_back: int = MAX_DAYS_BACK) -> DataFrame:
    """(currency, day) -> latest observation at most ``days_back`` days old."""
    daily = rates if any_source else rates.filter(F.col("source") == DAILY_SOURCE)
    unique = _first_inserted(
        daily, [F.upper("currency").alias("currency"), F.col("rate_date").alias("day")]
    )
    following = F.lead("day").over(W.partitionBy("currency").orderBy("day"))
    until = F.least(F.date_add("day", days_back), F.date_sub(following, 1))
    return unique.withColumn("until", until).select(
        "currency",
        F.explode(F.sequence("day", "until")).alias("day"),
        "best.rate_to_eur",
        "best.rate_date",
        "best.source",
    )


def monthly_rates(rates: DataFrame) -> DataFrame:
    """(currency, month) -> official monthly rate."""
    return _first_inserted(
        rates.filter(is_monthly_source(F.col("source"))),
        [F.upper("currency").alias("currency"), F.trunc("rate_date", "MM").alias("month")],
    ).select("currency", "month", "best.rate_to_eur", "best.rate_date", "best.source")


def rate_calendar(rates: DataFrame, any_source: bool = False) -> DataFrame:
    """(currency, day) -> the official rate: monthly where published, else daily."""
    monthly = monthly_rates(rates).select(
        "currency",
        F.explode(F.sequence("month", F.last_day("month"))).alias("day"),
        "rate_to_eur", "rate_date", "source",
        F.lit(0).alias("rank"),
    )
    daily = daily_calendar(rates, any_source).withColumn("rank", F.lit(1))
    return (
        monthly.unionByName(daily)
        .groupBy("currency", "day")
        .agg(F.min_by(F.struct("rate_to_eur", "rate_date", "source"), "rank").alias("official"))
        .select("currency", "day", "official")
    )


def resolve_rates(documents: DataFrame, rates: DataFrame, today: Column, text: str | None = None) -> DataFrame:
    """Add ``rate`` struct(rate_to_eur, rate_date, source), ``rate_needed`` and ``rate_missing``.

    Printed on the document first, then monthly, then daily. Only foreign ISO currencies look at
    the calendar; every other row carries a null key and never meets a calendar row.
    """
    currency = F.upper("original_currency")
    foreign = F.coalesce(currency != "EUR", F.lit(False))
    day = F.coalesce("invoice_date", today)
    printed = printed_rate(F.col(text)) if text else F.lit(None).cast("struct<currency:string,rate_to_eur:decimal(18,10)>")
    keyed = documents.withColumns({"_day": day, "_printed": printed}).withColumns(
        {
            "_printed": F.when(F.col("_printed.currency") == currency, F.col("_printed")),
        }
    ).withColumn(
        "_currency", F.when(foreign & is_iso_currency(currency) & F.col("_printed").isNull(), currency)
    )
    calendar = rate_calendar(rates).withColumnsRenamed({"currency": "_currency", "day": "_day"})
    joined = keyed.join(calendar, ["_currency", "_day"], "left")
    from_document = F.struct(
        F.col("_printed.rate_to_eur").alias("rate_to_eur"),
        F.col("_day").alias("rate_date"),
        F.lit("document").alias("source"),
    )
    rate = F.when(foreign & F.col("_printed").isNotNull(), from_document).otherwise(F.col("official"))
    return (
        joined.withColumn("rate", rate)
        .withColumns({"rate_needed": foreign, "rate_missing": foreign & F.col("rate").isNull()})
        .drop("_day", "_currency", "_printed", "official")
    )


def with_eur_amounts(documents: DataFrame) -> DataFrame:
    """EUR amounts from the originals: EUR copies, other currencies need ``rate``, else null."""
    is_eur = F.upper("original_currency") == "EUR"
    return documents.withColumns(
        {
            f"{name}_amount_eur": F.when(is_eur, F.col(f"{name}_amount_original")).otherwise(
                convert(F.col(f"{name}_amount_original"), F.col("rate.rate_to_eur"))
            )
            for name in ("net", "vat", "gross")
        }
    )


def new_rates(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rates whose (currency, date, source) is not stored yet; currency upper-cased."""
    keys = ["currency", "rate_date", "source"]
    fresh = _first_inserted(
        incoming.withColumn("currency", F.upper("currency")), [F.col(c) for c in keys]
    ).select(*keys, "best.rate_to_eur")
    return fresh.join(existing.select(*keys), keys, "left_anti")


def from_units_per_eur(units: Column) -> Column:
    """EUR per unit from units per EUR."""
    return (F.lit(Decimal(1)) / units).cast("decimal(18,10)")
