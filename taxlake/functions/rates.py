"""Currencies and rates printed on documents."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxlake.functions.money import RATE

# --- fixed values ----------------------------------------------------------------------------
ISO_4217 = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP "
    "BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR "
    "FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES "
    "KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR "
    "MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF "
    "SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS "
    "UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XCG XDR XOF "
    "XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWG"
).split()
QUOTED_ASSETS = ("BTC", "ETH", "USDC", "USDT")
DAILY_SOURCE = "ECB"
MONTHLY_SOURCE = "BMF USt-Umrechnungskurs"
PRINTED_RATE = (
    r"(^|[^0-9.,])1(?:[.,]0{1,2})?\s*([A-Za-z]{3,6})(?![A-Za-z])\s*=\s*"
    r"([0-9]+(?:[.,][0-9]+)?)\s*([A-Za-z]{3,6})(?![A-Za-z])"
)
# --- end of fixed values ----------------------------------------------------------------------


def is_iso_currency(code: Column) -> Column:
    return F.upper(F.trim(code)).isin(*ISO_4217)


def is_monthly_source(source: Column) -> Column:
    return (source == MONTHLY_SOURCE) | source.startswith(MONTHLY_SOURCE + " ")


def printed_rate(text: Column) -> Column:
    """First usable rate written on a document: struct(currency, rate_to_eur), else null."""

    def group(index: int) -> Column:
        return F.regexp_extract_all(text, F.lit(PRINTED_RATE), F.lit(index))

    matches = F.arrays_zip(
        F.transform(group(2), F.upper).alias("base"),
        F.transform(
            group(3), lambda v: F.translate(v, ",", ".").try_cast("decimal(28,10)")
        ).alias("value"),
        F.transform(group(4), F.upper).alias("quote"),
    )

    def quotable(code: Column) -> Column:
        return (code != "EUR") & (is_iso_currency(code) | code.isin(*QUOTED_ASSETS))

    rates = F.transform(
        F.filter(matches, lambda m: m["value"] > 0),
        lambda m: F.when(
            (m["quote"] == "EUR") & quotable(m["base"]),
            F.struct(m["base"].alias("currency"), m["value"].try_cast(RATE).alias("rate_to_eur")),
        ).when(
            (m["base"] == "EUR") & quotable(m["quote"]),
            F.struct(
                m["quote"].alias("currency"),
                (F.lit(Decimal(1)) / m["value"]).try_cast(RATE).alias("rate_to_eur"),
            ),
        ),
    )
    return F.try_element_at(F.array_compact(rates), F.lit(1))
