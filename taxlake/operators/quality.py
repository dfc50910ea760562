"""Row checks that return error codes, and the split into valid and rejected rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxlake.functions.periods import valid_iso_date
from taxlake.functions.tariff import PARAM_COLUMNS, SURCHARGE_COLUMNS

_TEN_THOUSAND = Decimal("0.0001")


def _no(value: str) -> Column:
    return F.lit(Decimal(value))


def _errors(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks]))


def _any_missing(columns) -> Column:
    missing = F.lit(False)
    for column in columns:
        missing = missing | F.col(column).isNull() | F.isnan(F.col(column).cast("double"))
    return missing


def tariff_errors() -> Column:
    """Error codes of a tariff row; continuity is only judged when the basics hold."""
    c = F.col
    basics = _errors(
        [
            ("basic_allowance_out_of_range", ~c("allowance").between(10000, 25000)),
            (
                "boundaries_not_ascending",
                ~((c("allowance") < c("zone2_end")) & (c("zone2_end") < c("zone3_end")) & (c("zone3_end") < c("zone4_end"))),
            ),
            (
                "non_positive_parameter",
                (c("a2") <= 0) | (c("a3") <= 0) | (c("c3") <= 0) | (c("sub4") <= 0) | (c("sub5") <= 0),
            ),
            ("entry_rate_not_near_14_percent", ~c("b2").between(1200, 1600)),
            ("zone4_rate_not_near_42_percent", ~c("rate4").between(_no("0.40"), _no("0.44"))),
            ("zone5_rate_not_near_45_percent", ~c("rate5").between(_no("0.43"), _no("0.48"))),
            ("top_rate_not_above_zone4_rate", c("rate5") <= c("rate4")),
        ]
    )
    y = ((c("zone2_end") - c("allowance")) * F.lit(_TEN_THOUSAND)).cast("decimal(10,4)")
    z = ((c("zone3_end") - c("zone2_end")) * F.lit(_TEN_THOUSAND)).cast("decimal(10,4)")
    two = _no("2")
    steps = _errors(
        [
            ("discontinuous_at_zone2_end", F.abs((c("a2") * y + c("b2")) * y - c("c3")) > two),
            (
                "discontinuous_at_zone3_end",
                F.abs((c("a3") * z + c("b3")) * z + c("c3") - (c("rate4") * c("zone3_end") - c("sub4"))) > two,
            ),
            (
                "discontinuous_at_zone4_end",
                F.abs((c("rate4") * c("zone4_end") - c("sub4")) - (c("rate5") * c("zone4_end") - c("sub5"))) > two,
            ),
            (
                "zone3_exit_rate_mismatch",
                F.abs((c("a3") * z * 2 + c("b3")) * F.lit(_TEN_THOUSAND) - c("rate4")) > _no("0.02"),
            ),
        ]
    )
    return (
        F.when(_any_missing(PARAM_COLUMNS), F.array(F.lit("non_finite_parameter")))
        .when(F.size(basics) > 0, basics)
        .otherwise(steps)
    )


def soli_errors() -> Column:
    """Error codes of a surcharge row."""
    c = F.col
    whole = lambda name: c(name) == F.floor(c(name))
    return F.when(
        _any_missing(SURCHARGE_COLUMNS), F.array(F.lit("non_finite_parameter"))
    ).otherwise(
        _errors(
            [
                ("single_threshold_out_of_range", ~(whole("threshold_single") & c("threshold_single").between(10000, 100000))),
                ("joint_threshold_out_of_range", ~(whole("threshold_joint") & c("threshold_joint").between(20000, 200000))),
                ("joint_threshold_not_double", c("threshold_joint") != c("threshold_single") * 2),
                ("rate_out_of_range", ~c("soli_rate").between(_no("0.04"), _no("0.07"))),
                ("mitigation_rate_out_of_range", ~c("mitigation_rate").between(_no("0.08"), _no("0.18"))),
                ("mitigation_rate_not_above_rate", c("mitigation_rate") <= c("soli_rate")),
            ]
        )
    )


def label_ok(label: Column) -> Column:
    text = F.trim(label)
    return F.coalesce((F.length(text) <= 40) & text.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"), F.lit(False))


def year_ok(year: Column) -> Column:
    return F.coalesce(year.between(2000, 2100), F.lit(False))


def split_overrides(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) override rows; a bad year or label counts as an error too."""
    checked = rows.withColumn(
        "errors",
        F.concat(
            F.array_compact(
                F.array(
                    F.when(~year_ok(F.col("year")), F.lit("invalid_year")),
                    F.when(~label_ok(F.col("label")), F.lit("invalid_source_label")),
                )
            ),
            errors,
        ),
    )
    fine = F.size("errors") == 0
    return checked.filter(fine).drop("errors"), checked.filter(~fine)


@dataclass
class RowContract:
    """What incoming rows must satisfy."""

    lengths: dict[str, int] = field(default_factory=dict)
    dates: list[str] = field(default_factory=list)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    positive: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)


def row_violations(contract: RowContract) -> Column:
    """Names of the columns that break the contract; nulls are allowed everywhere."""
    checks = []
    for name in contract.dates:
        checks.append((name, F.col(name).isNotNull() & ~valid_iso_date(F.col(name))))
    for name, allowed in contract.enums.items():
        checks.append((name, F.coalesce(~F.col(name).isin(*allowed), F.lit(False))))
    for name, limit in contract.lengths.items():
        checks.append((name, F.coalesce(F.length(name) > limit, F.lit(False))))
    for name in contract.positive:
        checks.append((name, F.coalesce(F.col(name) <= 0, F.lit(False))))
    for name, (low, high) in contract.ranges.items():
        checks.append((name, F.coalesce(~F.col(name).between(low, high), F.lit(False))))
    return _errors(checks)


def quarantine(rows: DataFrame, contract: RowContract) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined with a ``violations`` column)."""
    checked = rows.withColumn("violations", row_violations(contract))
    fine = F.size("violations") == 0
    return checked.filter(fine).drop("violations"), checked.filter(~fine)
