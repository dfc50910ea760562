"""Buckets, the ledger cube and everything summed from it.

One scan collapses the documents into a cube of monthly sums. Settings are joined to the cube,
never to the documents, so a tenant with a third of all rows is folded on the map side and the
settings join only sees its few thousand cube rows. Months are exact parts of quarters and years,
so longer periods are rolled up from the monthly result instead of expanding the documents.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxlake.functions.money import MONEY, gross_of, net_of, reverse_charge_owed
from taxlake.functions.periods import (
    demote,
    period_labels,
    recognition,
    vat_assignment,
)

BUCKETS = ("confirmed", "provisional", "excluded")

# --- fixed values: defaults of an account without stored settings ---------------------------
DEFAULT_SETTINGS = {
    "vat_method": "unsure",
    "vat_filing_frequency": "quarterly",
    "income_tax_method": "unsure",
    "assessment_type": "single",
    "church_tax": "none",
    "other_taxable_income": Decimal("0.00"),
    "deductible_contributions": Decimal("0.00"),
    "income_tax_prepayments": Decimal("0.00"),
    "include_solidarity_surcharge": True,
}
# --- end of fixed values --------------------------------------------------------------------


def _zero() -> Column:
    return F.lit(Decimal("0.00")).cast(MONEY)


def with_settings(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """Left join on the tenant; absent values take their defaults.

    No broadcast hint: the planner broadcasts the settings only while they are small enough.
    """
    joined = rows.join(settings, "tenant_id", "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in DEFAULT_SETTINGS.items()
         if name in settings.columns}
    )


def has_issue(code: str) -> Column:
    return F.exists("issues", lambda i: i["code"] == code)


def rate_missing() -> Column:
    """A foreign currency is set but no rate is known."""
    foreign = F.upper(F.trim("original_currency")) != "EUR"
    return F.coalesce(foreign, F.lit(False)) & F.col("exchange_rate_to_eur").isNull()


def base_bucket() -> Column:
    """confirmed / provisional / excluded of a document; null when it is deleted."""
    critical = F.exists("issues", lambda i: i["severity"] == "critical")
    not_eur = ~F.upper(F.trim("original_currency")).eqNullSafe("EUR")
    stored_missing = not_eur & F.col("exchange_rate_to_eur").isNull() & has_issue("missing_exchange_rate")
    blocked = critical | rate_missing() | stored_missing | (F.col("review_status") == "failed")
    return (
        F.when(F.col("deleted_at").isNotNull(), F.lit(None))
        .when(blocked, F.lit("excluded"))
        .when(F.col("review_status") == "confirmed", F.lit("confirmed"))
        .when(F.col("review_status") == "needs_review", F.lit("provisional"))
        .otherwise(F.lit("excluded"))
    )


def ledger_rows(documents: DataFrame) -> DataFrame:
    """Narrow projection of the active documents: only what the summaries read."""
    return documents.filter(F.col("deleted_at").isNull()).select(
        "tenant_id",
        "id",
        "direction",
        "vat_treatment_code",
        "payment_status",
        "invoice_date",
        "payment_date",
        base_bucket().alias("base_bucket"),
        (F.col("review_status") == "needs_review").alias("needs_review"),
        rate_missing().alias("rate_missing"),
        net_of(F.col("net_amount_eur"), F.col("gross_amount_eur")).alias("net"),
        F.coalesce("vat_amount_eur", _zero()).alias("vat"),
        gross_of(F.col("net_amount_eur"), F.col("vat_amount_eur"), F.col("gross_amount_eur")).alias("gross"),
        reverse_charge_owed(F.col("net_amount_eur")).alias("owed"),
    )


def ledger_cube(documents: DataFrame, as_of: str | None = None) -> DataFrame:
    """Monthly sums per tenant. ``as_of`` adds flags that tell later dates apart."""
    rows = ledger_rows(documents)

    def after(day: str) -> Column:
        return F.coalesce(F.col(day) > F.lit(as_of).cast("date"), F.lit(False)) if as_of else F.lit(False)

    keys = {
        "invoice_month": F.trunc("invoice_date", "MM"),
        "payment_month": F.trunc("payment_date", "MM"),
        "invoice_after": after("invoice_date"),
        "payment_after": after("payment_date"),
    }
    return rows.groupBy(
        "tenant_id", "direction", "vat_treatment_code", "payment_status", "base_bucket",
        "needs_review", "rate_missing", *[c.alias(n) for n, c in keys.items()],
    ).agg(
        F.count("*").alias("n"),
        F.sum("net").alias("net"),
        F.sum("vat").alias("vat"),
        F.sum("gross").alias("gross"),
        F.sum("owed").alias("owed"),
    )


#: Keys and sums of the cube. All sums are additive, so a stored cube is kept up to date by differences.
CUBE_KEYS = (
    "tenant_id", "direction", "vat_treatment_code", "payment_status", "base_bucket", "needs_review", "rate_missing",
    "invoice_month", "payment_month", "invoice_after", "payment_after",
)
CUBE_SUMS = ("n", "net", "vat", "gross", "owed")
#: Types of a stored cube.
CUBE = (
    "tenant_id int, direction string, vat_treatment_code string, payment_status string, base_bucket string, "
    "needs_review boolean, rate_missing boolean, invoice_month date, payment_month date, invoice_after boolean, "
    "payment_after boolean, n bigint, net decimal(28,2), vat decimal(28,2), gross decimal(28,2), owed decimal(28,2)"
)


def _as_stored(cube: DataFrame) -> DataFrame:
    return cube.select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.split(" ") for c in CUBE.split(", "))])


def merged_cube(*parts: DataFrame) -> DataFrame:
    """One cube from several, also from differences; keys without any document left are gone."""
    rows = _as_stored(parts[0])
    for part in parts[1:]:
        rows = rows.unionByName(_as_stored(part))
    sums = rows.groupBy(*CUBE_KEYS).agg(*[F.sum(c).alias(c) for c in CUBE_SUMS])
    return _as_stored(sums.where(" or ".join(f"{c} <> 0" for c in CUBE_SUMS)))


def cube_changes(old: DataFrame, new: DataFrame, as_of: str | None = None) -> DataFrame:
    """What a change of documents adds to the cube: their old versions with a minus, the new ones with a plus.

    Reads the changed documents only; merged into the cube of the old documents it gives that of the new ones.
    """
    gone = ledger_cube(old, as_of)
    return merged_cube(gone.withColumns({c: -F.col(c) for c in CUBE_SUMS}), ledger_cube(new, as_of))


# --- value added tax ------------------------------------------------------------------------

VAT_LINES = (
    "output_vat", "input_vat", "reverse_charge_vat", "reverse_charge_input_vat",
    "domestic_taxable_revenue", "eu_reverse_charge_revenue",
    "third_country_non_taxable_revenue", "tax_exempt_revenue",
)


def _vat_line_amounts() -> dict[str, tuple[Column, Column]]:
    """Per line: when a row belongs to it, and the amount it adds."""
    income = F.col("direction") == "income"
    code = F.col("vat_treatment_code")
    taxed = F.col("vat_method") != "kleinunternehmer"
    domestic = income & code.isin("DE_DOMESTIC_19", "DE_DOMESTIC_7")
    owed_by_us = ~income & (code == "EXPENSE_REVERSE_CHARGE_13B")
    net, vat, owed = F.col("net"), F.col("vat"), F.col("owed")
    return {
        "output_vat": (domestic & taxed, vat),
        "input_vat": (~income & (code == "DE_EXPENSE_INPUT_VAT") & taxed, vat),
        "reverse_charge_vat": (owed_by_us, owed),
        "reverse_charge_input_vat": (owed_by_us & taxed, owed),
        "domestic_taxable_revenue": (domestic | (income & (code == "KLEINUNTERNEHMER")), net),
        "eu_reverse_charge_revenue": (income & (code == "EU_B2B_REVERSE_CHARGE_REVENUE"), net),
        "third_country_non_taxable_revenue": (income & (code == "THIRD_COUNTRY_B2B_SERVICE"), net),
        "tax_exempt_revenue": (income & (code == "DE_DOMESTIC_0_EXEMPT"), net),
    }


def _vat_columns() -> list[str]:
    return [f"{line}_{bucket}" for line in VAT_LINES for bucket in BUCKETS]


def vat_summary(
    cube: DataFrame, settings: DataFrame, grains: tuple[str, ...] = ("year", "quarter", "month")
) -> DataFrame:
    """VAT lines per tenant and period in three buckets, payable amount and review counters."""
    assigned = (
        with_settings(cube, settings.select("tenant_id", "vat_method"))
        .withColumn("assigned", vat_assignment(F.col("invoice_month"), F.col("payment_month"), F.col("vat_method")))
        .filter(F.col("assigned.date").isNotNull())
        .withColumn("bucket", demote(F.col("base_bucket"), F.col("assigned.definitive")))
    )
    sums = []
    for line, (belongs, amount) in _vat_line_amounts().items():
        for bucket in BUCKETS:
            sums.append(
                F.coalesce(F.sum(F.when(belongs & (F.col("bucket") == bucket), amount)), F.lit(0))
                .cast(MONEY)
                .alias(f"{line}_{bucket}")
            )
    open_rows = F.col("base_bucket") == "provisional"
    income = F.col("direction") == "income"
    monthly = assigned.groupBy("tenant_id", F.col("assigned.date").alias("month")).agg(
        *sums,
        F.coalesce(F.sum(F.when(open_rows, F.col("n"))), F.lit(0)).alias("documents_needing_review"),
        F.coalesce(F.sum(F.when(open_rows & income, F.col("gross"))), F.lit(0)).cast(MONEY).alias("revenue_needing_review"),
        F.coalesce(F.sum(F.when(open_rows & ~income, F.col("gross"))), F.lit(0)).cast(MONEY).alias("expenses_needing_review"),
    )
    measures = [*_vat_columns(), "revenue_needing_review", "expenses_needing_review"]
    rolled = roll_up(monthly, "month", grains).agg(
        *[F.sum(c).cast(MONEY).alias(c) for c in measures],
        F.sum("documents_needing_review").alias("documents_needing_review"),
    )

    def counted(line: str) -> Column:
        return F.col(f"{line}_confirmed") + F.col(f"{line}_provisional")

    payable = (
        counted("output_vat") + counted("reverse_charge_vat")
        - counted("input_vat") - counted("reverse_charge_input_vat")
    )
    return rolled.withColumn("estimated_payable", payable.cast(MONEY))


def roll_up(monthly: DataFrame, month: str, grains: tuple[str, ...]):
    """Group a monthly table by tenant and the wanted period grains."""
    labels = F.filter(period_labels(F.col(month)), lambda p: p["grain"].isin(*grains))
    return (
        monthly.withColumn("p", F.explode(labels))
        .withColumns({"grain": F.col("p.grain"), "period": F.col("p.period")})
        .groupBy("tenant_id", "grain", "period")
    )


def vat_contributions(documents: DataFrame, settings: DataFrame) -> DataFrame:
    """Which document adds what to which VAT line: the trace behind every total.

    A row per document and line instead of id lists, so no list grows with a period.
    """
    assigned = (
        with_settings(ledger_rows(documents), settings.select("tenant_id", "vat_method"))
        .withColumn("assigned", vat_assignment(F.col("invoice_date"), F.col("payment_date"), F.col("vat_method")))
        .filter(F.col("assigned.date").isNotNull())
    )
    lines = F.array_compact(
        F.array(
            *[
                F.when(belongs, F.struct(F.lit(line).alias("line"), amount.cast(MONEY).alias("amount")))
                for line, (belongs, amount) in _vat_line_amounts().items()
            ]
        )
    )
    return assigned.select(
        "tenant_id",
        F.col("assigned.date").alias("assigned_date"),
        demote(F.col("base_bucket"), F.col("assigned.definitive")).alias("bucket"),
        "id",
        F.explode(lines).alias("l"),
    ).select("tenant_id", "assigned_date", "bucket", "id", "l.line", "l.amount")


def changed_contributions(stored: DataFrame, touched: DataFrame, contributed: DataFrame) -> DataFrame:
    """Contributions after a change: those of the ``touched`` documents (id) give way to the ones ``contributed`` anew."""
    return stored.join(touched.select("id"), "id", "left_anti").unionByName(contributed)


# --- recognition based figures --------------------------------------------------------------

def recognized_cube(cube: DataFrame, settings: DataFrame) -> DataFrame:
    """Cube rows with their income-tax recognition month, bucket and value."""
    rows = with_settings(cube, settings.select("tenant_id", "vat_method", "income_tax_method")).withColumn(
        "recognized",
        recognition(
            F.col("invoice_month"), F.col("payment_month"), F.col("payment_status"), F.col("income_tax_method")
        ),
    )
    by_payment = F.col("recognized.reason") == "recognized_payment_date"
    return rows.select(
        "*",
        F.col("recognized.date").alias("month"),
        demote(F.col("base_bucket"), F.col("recognized.definitive")).alias("bucket"),
        F.when(F.col("vat_method") == "kleinunternehmer", F.col("gross")).otherwise(F.col("net")).alias("value"),
        F.when(by_payment, F.col("payment_after")).otherwise(F.col("invoice_after")).alias("after_as_of"),
        (
            (F.col("recognized.reason") == "payment_date_missing")
            & F.col("income_tax_method").isin("euer", "unsure")
        ).alias("payment_date_missing"),
    )


def _bucket_sums(condition: Column, name: str) -> list[Column]:
    return [
        F.coalesce(F.sum(F.when(condition & (F.col("bucket") == b), F.col("value"))), F.lit(0))
        .cast(MONEY)
        .alias(f"{name}_{b}")
        for b in BUCKETS
    ]


def overview(
    cube: DataFrame,
    settings: DataFrame,
    vat: DataFrame,
    tax: DataFrame,
    grains: tuple[str, ...] = ("year", "quarter", "month"),
) -> DataFrame:
    """Revenue, expenses, profit, VAT payable, tax reserve and open-work counters per period.

    Documents without a recognition date need attention in every period of their tenant, but
    never add to a sum. ``vat`` and ``tax`` are the VAT summary and the income-tax estimate.
    """
    rows = recognized_cube(cube, settings)
    income = F.col("direction") == "income"

    def counters() -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(F.col("needs_review"), F.col("n"))), F.lit(0)).alias("documents_needing_review"),
            F.coalesce(F.sum(F.when(F.col("payment_date_missing"), F.col("n"))), F.lit(0)).alias("payment_dates_missing"),
            F.coalesce(F.sum(F.when(F.col("rate_missing"), F.col("n"))), F.lit(0)).alias("exchange_rates_missing"),
        ]

    counter_names = ["documents_needing_review", "payment_dates_missing", "exchange_rates_missing"]
    sum_names = [f"{side}_{b}" for side in ("revenue", "expenses") for b in BUCKETS]
    monthly = (
        rows.filter(F.col("month").isNotNull())
        .groupBy("tenant_id", "month")
        .agg(*_bucket_sums(income, "revenue"), *_bucket_sums(~income, "expenses"), *counters())
    )
    undated = (
        rows.filter(F.col("month").isNull()).groupBy("tenant_id").agg(*counters())
        .select("tenant_id", *[F.col(c).alias(f"undated_{c}") for c in counter_names])
    )
    # every period the tenant has any dated document in, also those without recognized ones
    months = cube.select(
        "tenant_id", F.explode(F.array("invoice_month", "payment_month")).alias("month")
    ).filter(F.col("month").isNotNull()).distinct()
    rolled = roll_up(months.join(monthly, ["tenant_id", "month"], "left"), "month", grains).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast(MONEY).alias(c) for c in sum_names],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counter_names],
    )
    profit = (
        F.col("revenue_confirmed") + F.col("revenue_provisional")
        - F.col("expenses_confirmed") - F.col("expenses_provisional")
    )
    return (
        rolled.join(undated, "tenant_id", "left")
        .withColumns({c: F.col(c) + F.coalesce(F.col(f"undated_{c}"), F.lit(0)) for c in counter_names})
        .drop(*[f"undated_{c}" for c in counter_names])
        .withColumn("profit", profit.cast(MONEY))
        .withColumn("year", F.substring("period", 1, 4).cast("int"))
        .join(
            vat.select("tenant_id", "grain", "period", F.col("estimated_payable").alias("vat_payable")),
            ["tenant_id", "grain", "period"],
            "left",
        )
        .join(tax.select("tenant_id", "year", "suggested_reserve"), ["tenant_id", "year"], "left")
        .withColumn("vat_payable", F.coalesce("vat_payable", _zero()))
        .drop("year")
    )


def monthly_series(cube: DataFrame, settings: DataFrame) -> DataFrame:
    """Twelve rows per tenant and year; months without counted documents are zero."""
    rows = recognized_cube(cube, settings).filter(F.col("month").isNotNull())
    income = F.col("direction") == "income"
    counted = F.col("bucket") != "excluded"
    sums = rows.groupBy("tenant_id", "month").agg(
        F.coalesce(F.sum(F.when(counted & income, F.col("value"))), F.lit(0)).cast(MONEY).alias("revenue"),
        F.coalesce(F.sum(F.when(counted & ~income, F.col("value"))), F.lit(0)).cast(MONEY).alias("expenses"),
    )
    # the twelve months of a year are filled from the year's own rows: no calendar join needed
    by_year = sums.groupBy("tenant_id", F.year("month").alias("year")).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.month("month"), F.struct("revenue", "expenses")))
        ).alias("months")
    )
    zero = _zero()
    return by_year.select(
        "tenant_id", "year", "months", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    ).select(
        "tenant_id",
        "year",
        "month",
        F.coalesce(F.try_element_at("months", F.col("month"))["revenue"], zero).alias("revenue"),
        F.coalesce(F.try_element_at("months", F.col("month"))["expenses"], zero).alias("expenses"),
    )


def recognized_contributions(documents: DataFrame, settings: DataFrame) -> DataFrame:
    """Which document adds what to income or expenses, with its recognition date and bucket."""
    rows = with_settings(
        ledger_rows(documents), settings.select("tenant_id", "vat_method", "income_tax_method")
    ).withColumn(
        "recognized",
        recognition(F.col("invoice_date"), F.col("payment_date"), F.col("payment_status"), F.col("income_tax_method")),
    )
    return rows.filter(F.col("recognized.date").isNotNull()).select(
        "tenant_id",
        "id",
        "direction",
        F.col("recognized.date").alias("recognition_date"),
        F.col("recognized.reason").alias("reason"),
        demote(F.col("base_bucket"), F.col("recognized.definitive")).alias("bucket"),
        F.when(F.col("vat_method") == "kleinunternehmer", F.col("gross")).otherwise(F.col("net")).alias("amount"),
    )

