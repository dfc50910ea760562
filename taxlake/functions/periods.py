"""Tax periods: which date a document counts for, and how firmly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_iso_date(text: Column) -> Column:
    """True for ``YYYY-MM-DD`` text naming a real day in the years 1900-2200."""
    day = F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), "yyyy-MM-dd")
    return F.coalesce(day.isNotNull() & F.year(day).between(1900, 2200), F.lit(False))


def date_in_period(day: Column, year: Column, quarter: Column, month: Column) -> Column:
    """Month decides when given, else quarter, else the year alone; null date is outside."""
    inside = (F.year(day) == year) & F.coalesce(
        F.month(day) == month, F.quarter(day) == quarter, F.lit(True)
    )
    return F.coalesce(day.isNotNull() & inside, F.lit(False))


def recognition(
    invoice_date: Column, payment_date: Column, payment_status: Column, method: Column
) -> Column:
    """Income-tax recognition as struct(date, definitive, reason)."""

    def outcome(day: Column, definitive: bool, reason: str) -> Column:
        return F.struct(
            day.alias("date"), F.lit(definitive).alias("definitive"), F.lit(reason).alias("reason")
        )

    nothing = F.lit(None).cast("date")
    cash = (
        F.when(
            (payment_status == "paid") & payment_date.isNotNull(),
            outcome(payment_date, True, "recognized_payment_date"),
        )
        .when(payment_status == "unpaid", outcome(nothing, False, "not_yet_paid"))
        .when(invoice_date.isNotNull(), outcome(invoice_date, False, "payment_date_missing"))
        .otherwise(outcome(nothing, False, "no_date"))
    )
    accrual = F.when(
        invoice_date.isNotNull(), outcome(invoice_date, True, "recognized_invoice_date")
    ).otherwise(outcome(nothing, False, "no_date"))
    unsure = F.when(
        invoice_date.isNotNull(), outcome(invoice_date, False, "method_unsure")
    ).otherwise(outcome(nothing, False, "no_date"))
    return F.when(method == "euer", cash).when(method == "accrual", accrual).otherwise(unsure)


def vat_assignment(invoice_date: Column, payment_date: Column, vat_method: Column) -> Column:
    """VAT date as struct(date, definitive): invoice first for 'soll', else payment first."""
    by_invoice = vat_method == "soll"
    governing = F.when(by_invoice, invoice_date).otherwise(payment_date)
    fallback = F.when(by_invoice, payment_date).otherwise(invoice_date)
    return F.struct(
        F.coalesce(governing, fallback).alias("date"), governing.isNotNull().alias("definitive")
    )


def demote(bucket: Column, definitive: Column) -> Column:
    """A confirmed document with an uncertain date is only provisional."""
    return F.when((bucket == "confirmed") & ~definitive, F.lit("provisional")).otherwise(bucket)


def period_label(day: Column, grain: str) -> Column:
    """``2024``, ``2024-Q3`` or ``2024-07``."""
    if grain == "year":
        return F.date_format(day, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))
    return F.date_format(day, "yyyy-MM")


def period_labels(day: Column) -> Column:
    """The three periods a date belongs to, as array<struct<grain, period>>."""
    return F.array(
        *[
            F.struct(F.lit(grain).alias("grain"), period_label(day, grain).alias("period"))
            for grain in ("year", "quarter", "month")
        ]
    )


def filing_period(today: Column, frequency: Column) -> Column:
    """The filing period that holds ``today``: struct(year, quarter, month)."""
    return F.struct(
        F.year(today).alias("year"),
        F.when(frequency != "yearly", F.quarter(today)).alias("quarter"),
        F.when(frequency == "monthly", F.month(today)).alias("month"),
    )


def assigned_period(invoice_date: Column) -> Column:
    """Stored document period, from the invoice date alone."""
    return F.struct(
        F.year(invoice_date).alias("year"),
        F.quarter(invoice_date).alias("quarter"),
        F.month(invoice_date).alias("month"),
    )
