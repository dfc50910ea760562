"""The period report as one long table of metrics instead of prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxlake.operators.ledger import roll_up


def _long(df: DataFrame, keys: list[Column], metrics: list[tuple[str, str, Column]]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(bucket).alias("bucket"),
                value.cast("decimal(18,2)").alias("value"),
            )
            for metric, bucket, value in metrics
        ]
    )
    return (
        df.select(*keys, F.explode(cells).alias("m"))
        .select("tenant_id", "period", "m.metric", "m.bucket", "m.value")
        .filter(F.col("value").isNotNull())
    )


def period_metrics(vat: DataFrame, tax: DataFrame, cube: DataFrame) -> DataFrame:
    """metrics(tenant, period, metric, bucket, value); optional lines only when they apply."""
    vat_metrics = [
        (line, bucket, F.col(f"{line}_{bucket}"))
        for line in ("output_vat", "input_vat", "reverse_charge_vat")
        for bucket in ("confirmed", "provisional")
    ] + [
        ("estimated_payable", "total", F.col("estimated_payable")),
        ("documents_needing_review", "total", F.col("documents_needing_review")),
        (
            "amount_needing_review",
            "total",
            F.col("revenue_needing_review") + F.col("expenses_needing_review"),
        ),
    ]
    tax_metrics = [
        (side, bucket, F.col(f"{side}_{bucket}"))
        for side in ("income", "expenses")
        for bucket in ("confirmed", "provisional")
    ] + [
        ("recorded_profit_to_date", "total", F.when(F.col("is_annualized"), F.col("recorded_profit"))),
        ("estimated_profit", "total", F.col("estimated_profit")),
        ("estimated_taxable_income", "total", F.col("estimated_taxable_income")),
        ("estimated_income_tax", "total", F.col("estimated_income_tax")),
        (
            "solidarity_surcharge",
            "total",
            F.when(F.col("include_solidarity_surcharge"), F.col("solidarity_surcharge")),
        ),
        ("church_tax", "total", F.when(F.col("church_tax") != "none", F.col("church_tax_amount"))),
        ("prepayments", "total", F.when(F.col("prepayments") != 0, F.col("prepayments"))),
        ("suggested_reserve", "total", F.col("suggested_reserve")),
    ]
    # membership of a document in a period goes by its invoice date, not by recognition
    monthly = cube.filter(F.col("invoice_month").isNotNull()).groupBy("tenant_id", "invoice_month").agg(
        F.sum("n").alias("n")
    )
    members = roll_up(monthly, "invoice_month", ("year", "quarter", "month")).agg(F.sum("n").alias("n"))
    by_year = [F.col("tenant_id"), F.col("year").cast("string").alias("period")]
    by_period = [F.col("tenant_id"), F.col("period")]
    return (
        _long(vat, by_period, vat_metrics)
        .unionByName(_long(tax, by_year, tax_metrics))
        .unionByName(_long(members, by_period, [("documents_in_period", "total", F.col("n"))]))
    )
