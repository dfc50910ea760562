"""Income tax, solidarity surcharge and church tax over a tariff row.

All arithmetic is decimal: a double that lands just under a whole euro would floor wrongly.
The functions expect the tariff columns named in ``TARIFF_COLUMNS`` next to the income.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxlake.functions.money import MONEY, truncate_money

# --- fixed values: published tariff parameters per assessment year -------------------------
# year, version, basic allowance, zone 2/3/4 upper bounds, a2, b2, a3, b3, c3,
# rate4, sub4, rate5, sub5, surcharge threshold (single assessment)
TARIFFS = [
    (2022, "2022.1", 10347, 14926, 58596, 277825, "1088.67", "1400", "206.43", "2397", "869.32",
     "0.42", "9336.45", "0.45", "17671.20", 16956),
    (2023, "2023.1", 10908, 15999, 62809, 277825, "979.18", "1400", "192.59", "2397", "966.53",
     "0.42", "9972.98", "0.45", "18307.73", 17543),
    (2024, "2024.1", 11784, 17005, 66760, 277825, "954.80", "1400", "181.19", "2397", "991.21",
     "0.42", "10636.31", "0.45", "18971.06", 18130),
    (2025, "2025.1", 12096, 17443, 68480, 277825, "932.30", "1400", "176.64", "2397", "1015.13",
     "0.42", "10911.92", "0.45", "19246.67", 19950),
    (2026, "2026.1", 12348, 17799, 69878, 277825, "914.51", "1400", "173.10", "2397", "1034.87",
     "0.42", "11135.63", "0.45", "19470.38", 20350),
]
SURCHARGE_RATE = "0.055"
SURCHARGE_MITIGATION_RATE = "0.119"
# --- end of fixed values --------------------------------------------------------------------

PARAM_COLUMNS = (
    "allowance", "zone2_end", "zone3_end", "zone4_end",
    "a2", "b2", "a3", "b3", "c3", "rate4", "sub4", "rate5", "sub5",
)
SURCHARGE_COLUMNS = ("threshold_single", "threshold_joint", "soli_rate", "mitigation_rate")
TARIFF_COLUMNS = PARAM_COLUMNS + SURCHARGE_COLUMNS

_TEN_THOUSANDTH = Decimal("0.0001")


def _steps(income: Column, start: Column, end: Column) -> Column:
    """Income above ``start`` in units of 10 000, held inside the zone so it stays small."""
    inside = F.least(F.greatest(income.cast("decimal(14,0)"), start), end)
    return ((inside - start) * F.lit(_TEN_THOUSANDTH)).cast("decimal(9,4)")


def tariff_amount(income: Column) -> Column:
    """Tax on a whole-euro income before the final rounding down."""
    x = income.cast("decimal(14,0)")
    y = _steps(x, F.col("allowance"), F.col("zone2_end"))
    z = _steps(x, F.col("zone2_end"), F.col("zone3_end"))
    exact = "decimal(30,12)"
    return (
        F.when(x <= F.col("allowance"), F.lit(Decimal(0)).cast(exact))
        .when(x <= F.col("zone2_end"), ((F.col("a2") * y + F.col("b2")) * y).cast(exact))
        .when(
            x <= F.col("zone3_end"),
            ((F.col("a3") * z + F.col("b3")) * z + F.col("c3")).cast(exact),
        )
        .when(x <= F.col("zone4_end"), (F.col("rate4") * x - F.col("sub4")).cast(exact))
        .otherwise((F.col("rate5") * x - F.col("sub5")).cast(exact))
    )


def marginal_rate(income: Column) -> Column:
    """Share of the next euro that goes to tax, as a fraction."""
    x = income.cast("decimal(14,0)")
    y = _steps(x, F.col("allowance"), F.col("zone2_end"))
    z = _steps(x, F.col("zone2_end"), F.col("zone3_end"))
    scale = F.lit(_TEN_THOUSANDTH)
    exact = "decimal(24,12)"
    return (
        F.when(x <= F.col("allowance"), F.lit(Decimal(0)).cast(exact))
        .when(
            x <= F.col("zone2_end"), ((F.col("a2") * y * 2 + F.col("b2")) * scale).cast(exact)
        )
        .when(
            x <= F.col("zone3_end"), ((F.col("a3") * z * 2 + F.col("b3")) * scale).cast(exact)
        )
        .when(x <= F.col("zone4_end"), F.col("rate4").cast(exact))
        .otherwise(F.col("rate5").cast(exact))
    )


def annual_tax(
    taxable_income: Column, assessment: Column, church_tax: Column, include_soli: Column
) -> Column:
    """All yearly tax figures as one struct."""
    zve = F.greatest(F.floor(taxable_income.cast("decimal(20,2)")), F.lit(0)).cast("decimal(14,0)")
    joint = assessment == "joint"
    tariff_income = F.when(joint, F.floor(zve * F.lit(Decimal("0.5")))).otherwise(zve).cast(
        "decimal(14,0)"
    )
    share = F.floor(tariff_amount(tariff_income)).cast("decimal(14,0)")
    tax = F.when(joint, share * 2).otherwise(share).cast(MONEY)

    threshold = F.when(joint, F.col("threshold_joint")).otherwise(F.col("threshold_single"))
    soli = F.when(
        include_soli & (tax > threshold),
        truncate_money(
            F.least(
                (F.col("soli_rate") * tax).cast("decimal(24,6)"),
                (F.col("mitigation_rate") * (tax - threshold)).cast("decimal(24,6)"),
            )
        ),
    ).otherwise(F.lit(Decimal("0.00")).cast(MONEY))

    church_rate = (
        F.when(church_tax == "rate8", F.lit(Decimal("0.08")))
        .when(church_tax == "rate9", F.lit(Decimal("0.09")))
        .otherwise(F.lit(Decimal("0.00")))
    )
    church = F.round(tax * church_rate, 2).cast(MONEY)
    average = F.when(
        zve > 0, F.round(tax.cast("decimal(18,2)") * 100 / F.nullif(zve, F.lit(Decimal(0))), 2)
    ).otherwise(F.lit(Decimal("0.00")))
    return F.struct(
        tax.alias("income_tax"),
        soli.alias("solidarity_surcharge"),
        church.alias("church_tax"),
        (tax + soli + church).cast(MONEY).alias("total"),
        F.round(marginal_rate(tariff_income) * 100, 2).cast("decimal(9,2)").alias("marginal_rate_percent"),
        average.cast("decimal(9,2)").alias("average_rate_percent"),
    )
