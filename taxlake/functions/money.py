"""Exact money arithmetic: DECIMAL(18,2) amounts, DECIMAL(18,10) rates, one rounder."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
RATE = "decimal(18,10)"


def money(value: Column) -> Column:
    """Cast to money. Casting from double rounds half away from zero at the cent."""
    return value.cast(MONEY)


def round_money(value: Column) -> Column:
    """Round to cents, half away from zero."""
    return F.round(value, 2).cast(MONEY)


def truncate_money(value: Column) -> Column:
    """Drop everything below the cent; negative input counts as zero."""
    cents = F.floor(F.greatest(value, F.lit(Decimal("0.00"))) * F.lit(100))
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def net_of(net_eur: Column, gross_eur: Column) -> Column:
    """Net in EUR; a document without net counts with its gross."""
    return F.coalesce(net_eur, gross_eur, F.lit(Decimal("0.00"))).cast(MONEY)


def gross_of(net_eur: Column, vat_eur: Column, gross_eur: Column) -> Column:
    """Gross in EUR; rebuilt from net + vat, else net, when it is not stated."""
    return F.coalesce(
        gross_eur, round_money(net_eur + vat_eur), net_eur, F.lit(Decimal("0.00"))
    ).cast(MONEY)


def convert(amount: Column, rate_to_eur: Column) -> Column:
    """Amount in another currency to EUR cents; null when either side is null."""
    return round_money(amount.cast(MONEY) * rate_to_eur.cast(RATE))


def reverse_charge_owed(net_eur: Column) -> Column:
    """19 % owed by the recipient on the net amount (a missing net counts as zero)."""
    return round_money(F.coalesce(net_eur, F.lit(Decimal("0.00"))) * F.lit(Decimal("0.19")))
