"""Tariff dimension, year resolution and the income-tax estimate."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxlake.functions.money import MONEY
from taxlake.functions.tariff import (
    PARAM_COLUMNS,
    SURCHARGE_COLUMNS,
    SURCHARGE_MITIGATION_RATE,
    SURCHARGE_RATE,
    TARIFF_COLUMNS,
    TARIFFS,
    annual_tax,
)
from taxlake.operators.ledger import BUCKETS, _bucket_sums, recognized_cube, with_settings

FIRST_YEAR, LAST_YEAR = 1900, 2200  # years a valid date can have

_WHOLE = ("allowance", "zone2_end", "zone3_end", "zone4_end", "threshold_single", "threshold_joint")


def _param_type(name: str) -> str:
    if name in _WHOLE:
        return "decimal(8,0)"
    if name in ("rate4", "rate5", "soli_rate", "mitigation_rate"):
        return "decimal(6,4)"
    return "decimal(10,4)"


def tariff_table(spark: SparkSession) -> DataFrame:
    """One row per built-in assessment year."""
    rows = []
    for year, version, *params in TARIFFS:
        *tariff, threshold = params
        rows.append(
            (year, version, *[str(p) for p in tariff], str(threshold), str(threshold * 2),
             SURCHARGE_RATE, SURCHARGE_MITIGATION_RATE)
        )
    schema = "year int, version string, " + ", ".join(f"{c} string" for c in TARIFF_COLUMNS)
    return spark.createDataFrame(rows, schema).select(
        "year", "version", *[F.col(c).cast(_param_type(c)).alias(c) for c in TARIFF_COLUMNS]
    )


def resolve_tariffs(
    built_in: DataFrame,
    tariff_overrides: DataFrame | None = None,
    soli_overrides: DataFrame | None = None,
) -> DataFrame:
    """The tariff of every year 1900-2200, so that callers resolve a year with an equi-join.

    An override beats the built-in row of its year and adds ``+label`` to the version. Surcharge
    rules resolve on their own; a year without any takes the closest earlier ones and says so in
    the version. Every table here holds one row per assessment year, at most 301 rows.
    """
    everything = W.partitionBy(F.lit(1))

    # surcharge rules per candidate year
    soli = built_in.select("year", *SURCHARGE_COLUMNS, F.lit(None).cast("string").alias("label"))
    if soli_overrides is not None:
        fresh = soli_overrides.select(
            "year", *[F.col(c).cast(_param_type(c)).alias(c) for c in SURCHARGE_COLUMNS], "label"
        )
        soli = soli.join(fresh, "year", "left_anti").unionByName(fresh)
    soli = _spread(
        soli.withColumn("soli_year", F.col("year")).withColumn(
            "first_year", F.min("year").over(everything)
        )
    ).select(
        "year",
        *SURCHARGE_COLUMNS,
        F.when(
            F.col("year") == F.col("soli_year"),
            F.coalesce(F.concat(F.lit("+"), F.col("label")), F.lit("")),
        )
        .otherwise(
            F.concat_ws(
                "-", F.lit("+solzg-fallback"), F.col("soli_year").cast("string"), F.col("label")
            )
        )
        .alias("soli_suffix"),
    )

    # tariff parameters per candidate year
    tariffs = built_in.select("year", "version", *PARAM_COLUMNS)
    first_built_in = F.min(F.when(F.col("built_in"), F.col("year"))).over(everything)
    tariffs = tariffs.withColumn("built_in", F.lit(True))
    if tariff_overrides is not None:
        fresh = (
            tariff_overrides.select(
                "year", *[F.col(c).cast(_param_type(c)).alias(c) for c in PARAM_COLUMNS], "label"
            )
            .join(built_in.select("year", F.col("version").alias("base_version")), "year", "left")
            .withColumn(
                "version",
                F.concat(
                    F.coalesce("base_version", F.concat(F.col("year").cast("string"), F.lit(".0"))),
                    F.lit("+"),
                    F.col("label"),
                ),
            )
            .withColumn("built_in", F.col("base_version").isNotNull())
            .drop("label", "base_version")
        )
        tariffs = tariffs.join(fresh, "year", "left_anti").unionByName(fresh)
    engines = tariffs.withColumn("first_year", first_built_in).join(soli, "year").withColumn(
        "version", F.concat("version", "soli_suffix")
    )
    return _spread(engines.withColumn("tariff_year", F.col("year"))).select(
        "year",
        "tariff_year",
        "version",
        (F.col("year") == F.col("tariff_year")).alias("exact_year_match"),
        *TARIFF_COLUMNS,
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Each row covers its year up to the next one; ``first_year`` also covers all before."""
    by_year = W.partitionBy(F.lit(1)).orderBy("year")
    lowest = F.min("year").over(W.partitionBy(F.lit(1)))
    until = F.coalesce(F.lead("year").over(by_year) - 1, F.lit(LAST_YEAR))
    spans = rows.withColumns({"until": until, "lowest": lowest}).withColumn(
        "years",
        F.concat(
            F.when(
                (F.col("year") == F.col("first_year")) & (F.col("lowest") > FIRST_YEAR),
                F.sequence(F.lit(FIRST_YEAR), F.col("lowest") - 1),
            ).otherwise(F.array().cast("array<int>")),
            F.sequence("year", "until"),
        ),
    )
    return spans.withColumn("year", F.explode("years")).drop("until", "lowest", "first_year", "years")


def taxpayer_tax(taxpayers: DataFrame, tariffs: DataFrame, keep: list | None = None) -> DataFrame:
    """Yearly tax of taxpayers(year, taxable_income, assessment_type, church_tax,
    include_solidarity_surcharge). ``keep`` lists the taxpayer columns to carry along."""
    joined = taxpayers.join(tariffs, "year", "left").withColumn(
        "t",
        annual_tax(
            F.col("taxable_income"),
            F.col("assessment_type"),
            F.col("church_tax"),
            F.col("include_solidarity_surcharge"),
        ),
    )
    carried = keep or [c for c in taxpayers.columns if c != "church_tax"]
    return joined.select(*carried, "version", "exact_year_match", "tariff_year", "t.*")


def income_tax_estimate(
    cube: DataFrame, settings: DataFrame, tariffs: DataFrame, as_of: str | None = None
) -> DataFrame:
    """Estimate per tenant and year. Build the cube with the same ``as_of``."""
    rows = recognized_cube(cube, settings)
    income = F.col("direction") == "income"
    as_of_year = int(as_of[:4]) if as_of else None
    recognized = F.col("month").isNotNull()
    counts_in = recognized & ((F.year("month") != as_of_year) | ~F.col("after_as_of")) if as_of else recognized

    # one pass over the cube: a row counts in its year of recognition, and shows the years of its dates, also
    # where nothing is recognized; rows without recognition come together under a null year
    def tag(when: Column, year: Column, counted: bool) -> Column:
        return F.when(when, F.struct(year.alias("year"), F.lit(counted).alias("counted")))

    tags = F.array_compact(
        F.array(
            tag(counts_in, F.year("month"), True),
            tag(~recognized, F.lit(None).cast("int"), True),
            *[tag(F.col(d).isNotNull(), F.year(d), False) for d in ("invoice_month", "payment_month")],
        )
    )
    tagged = rows.withColumn("tag", F.explode(F.array_distinct(tags))).withColumns({"year": F.col("tag.year"), "counted": F.col("tag.counted")})

    def counted(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("counted") & condition, F.col("n"))), F.lit(0))

    yearly = tagged.groupBy("tenant_id", "year").agg(
        *_bucket_sums(F.col("counted") & income, "income"),
        *_bucket_sums(F.col("counted") & ~income, "expenses"),
        counted(F.col("bucket") == "excluded").alias("excluded_count"),
        counted(F.col("bucket") == "provisional").alias("provisional_count"),
        counted(F.col("payment_date_missing")).alias("payment_dates_missing"),
        counted(F.col("base_bucket") == "excluded").alias("base_excluded"),
    )
    undated = F.coalesce(F.max(F.when(F.col("year").isNull(), F.col("base_excluded"))).over(W.partitionBy("tenant_id")), F.lit(0))
    figures = (
        yearly.withColumn("undated", undated)
        .where("year is not null")
        .withColumn("excluded_count", F.col("excluded_count") + F.col("undated"))
        .drop("undated", "base_excluded")
    )
    figures = with_settings(figures, settings)

    annualized = (F.col("year") == as_of_year) if as_of else F.lit(False)
    months = F.when(annualized, F.lit(int(as_of[5:7]) if as_of else 12)).otherwise(F.lit(12))
    recorded = (
        F.col("income_confirmed") + F.col("income_provisional")
        - F.col("expenses_confirmed") - F.col("expenses_provisional")
    ).cast(MONEY)
    figures = (
        figures.withColumn("recorded_profit", recorded)
        .withColumn("is_annualized", annualized)
        .withColumn("projection_months", months)
        # divide last: 12 / 7 has no exact decimal form
        .withColumn(
            "estimated_profit",
            F.round(F.col("recorded_profit") * 12 / F.col("projection_months").cast("decimal(2,0)"), 2).cast(MONEY),
        )
        .withColumn(
            "estimated_taxable_income",
            F.greatest(
                F.lit(Decimal("0.00")),
                F.col("estimated_profit") + F.col("other_taxable_income") - F.col("deductible_contributions"),
            ).cast(MONEY),
        )
    )
    taxed = figures.join(tariffs, "year", "left").withColumn(
        "t",
        annual_tax(
            F.col("estimated_taxable_income"),
            F.col("assessment_type"),
            F.col("church_tax"),
            F.col("include_solidarity_surcharge"),
        ),
    )
    reserve = F.greatest(
        F.lit(Decimal("0.00")),
        F.col("t.income_tax") + F.col("t.solidarity_surcharge") + F.col("t.church_tax")
        - F.col("income_tax_prepayments"),
    ).cast(MONEY)
    method = F.col("income_tax_method")
    assumptions = F.array_compact(
        F.array(
            F.when(method == "euer", F.lit("cash_basis"))
            .when(method == "accrual", F.lit("accrual_basis"))
            .otherwise(F.lit("method_not_set")),
            F.when(F.col("vat_method") == "kleinunternehmer", F.lit("gross_amounts")).otherwise(F.lit("net_amounts")),
            F.when(~F.col("exact_year_match"), F.lit("tariff_year_fallback")),
            F.when(F.col("church_tax") != "none", F.lit("church_tax_simplified")),
            F.when(F.col("include_solidarity_surcharge"), F.lit("surcharge_simplified")),
        )
    )
    incomplete = F.array_compact(
        F.array(
            F.when(F.col("payment_dates_missing") > 0, F.lit("payment_dates_missing")),
            F.when(F.col("excluded_count") > 0, F.lit("documents_excluded")),
            F.when(F.col("deductible_contributions") == 0, F.lit("no_deductible_contributions")),
        )
    )
    final = (method != "unsure") & (F.col("provisional_count") == 0) & (F.size(incomplete) == 0)
    sides = [f"{side}_{b}" for side in ("income", "expenses") for b in BUCKETS]
    return taxed.select(
        "tenant_id",
        "year",
        *sides,
        "recorded_profit",
        "estimated_profit",
        "other_taxable_income",
        "deductible_contributions",
        "estimated_taxable_income",
        F.col("t.income_tax").alias("estimated_income_tax"),
        F.col("t.solidarity_surcharge").alias("solidarity_surcharge"),
        F.col("t.church_tax").alias("church_tax_amount"),
        "church_tax",
        "include_solidarity_surcharge",
        F.col("income_tax_prepayments").alias("prepayments"),
        reserve.alias("suggested_reserve"),
        F.col("version").alias("engine_version"),
        "exact_year_match",
        assumptions.alias("assumptions"),
        incomplete.alias("incomplete_items"),
        "payment_dates_missing",
        "excluded_count",
        "provisional_count",
        "is_annualized",
        "projection_months",
        (F.lit(12) / F.col("projection_months")).alias("projection_factor"),
        (F.col("is_annualized") | ~final).alias("is_estimate_only"),
    )
